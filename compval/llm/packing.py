"""Best-fit packing of token sequences, bulk-synchronous.

Documents' tokens are cut into pieces of at most `limit`; whole ones fill sequences of their own. The other pieces are
range-sorted by length. Equal pieces are interchangeable, and so are equal gaps, so both are held as runs: a piece is
known by its length and its rank within it, a run of gaps by its first sequence and their number.

As many sequences are opened as the tokens need at least. Windows of lengths, the longest first, are then matched in
rounds. A round is a job over the range-sorted runs of gaps and of the window's pieces: every partition sweeps its
range from large to small and gives each piece its successor, the smallest gap left that holds it; pieces that want one
gap are in conflict, which goes by rank: the longer first, then the lower rank. As many equal pieces as a gap holds stay
together. The gaps are updated, and the next round begins. Where nothing moved, ranges are widened up to one, and then
the next window follows; what no gap holds in the end opens further sequences.

The driver holds counts by length (at most `limit`), rows by partition, and the plan's lines, none of which grows with
the corpus but the rows by partition; the pieces find their line by length and rank. Nothing is grouped by length, so a
length that a third of all pieces share is a run like any other. Null texts are empty; an empty text is its closing id
alone. Repeated rows are packed as rows of their own. Null ids sort first and come back as null. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from compval.llm import bpe
from compval.llm.common import documents, dropped, rows_out, slices, written

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, closing: int = 0) -> DataFrame:
    """Each document's ids and a closing id, cut into pieces of at most limit. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([closing], "<u4").tobytes()
        for b in slices(batches):
            cols: list[list] = [[] for _ in range(5)]
            for doc, ids in zip(b.column(0).to_pylist(), bpe.id_bytes(b.column(1).to_pylist(), tokenizer)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for c, x in zip(cols, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES)], schema=PIECES)

    return documents(docs).mapInArrow(run, PIECES_DDL)


#: Runs of a round: gaps (size, first sequence, number), pieces (length, first rank, number), and lines of the plan
#: (length, first rank, number, first sequence, offset): pieces of these ranks stand there in sequences one after the other.
GAP, PIECE, LINE = 0, 1, 2
RUNS = pa.schema([("kind", pa.int32()), ("size", pa.int64()), ("first", pa.int64()), ("number", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())])
RUNS_DDL = "kind int, size long, first long, number long, sequence long, offset long"


def sweep(runs: Iterator[tuple[int, int, int, int]], limit: int) -> Iterator[tuple[int, ...]]:
    """Over runs (kind, size, first, number) from large to small, gaps before pieces of their size: lines of the plan, and
    the runs that are left."""
    gaps: list[list[int]] = []  # those met, the smallest last
    for kind, size, first, number in runs:
        if kind == GAP:
            gaps.append([size, first, number])
            continue
        while number and gaps:
            gap, sequence, held = gaps[-1]
            each = min(gap // size, number)
            whole = min(held, number // each)
            for i in range(each):
                yield LINE, size, first, whole, sequence, limit - gap + i * size
                first += whole
            number -= each * whole
            if gap > each * size:
                yield GAP, gap - each * size, sequence, whole, 0, 0
            if whole == held:
                gaps.pop()
            else:
                gaps[-1][1:] = sequence + whole, held - whole
        if number:
            yield PIECE, size, first, number, 0, 0
    for gap, sequence, held in gaps:
        yield GAP, gap, sequence, held, 0, 0


def _round(runs: DataFrame, parts: int, limit: int) -> DataFrame:
    """One sweep over each of `parts` ranges of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        yield rows_out(RUNS, list(sweep(rows, limit)))

    order = [F.desc("size"), F.asc("kind"), F.asc("first")]
    ranged = runs.coalesce(1) if parts == 1 else runs.repartitionByRange(parts, F.desc("size"))
    return ranged.sortWithinPartitions(*order).select("kind", "size", "first", "number").mapInArrow(run, RUNS_DDL)


def best_fit(spark: SparkSession, counts: dict[int, int], limit: int = 2048, windows: int = 32, runs_a_task: int = 1 << 13) -> list[tuple[int, int, int, int, int]]:
    """The plan for `counts` pieces by length: lines (length, first rank, number, first sequence, offset)."""
    counts = {n: c for n, c in counts.items() if c}
    tokens, over_half = sum(n * c for n, c in counts.items()), sum(c for n, c in counts.items() if 2 * n > limit)
    opened = max(-(-tokens // limit), over_half)
    plan = [(limit, 0, counts[limit], 0, 0)] if counts.get(limit) else []
    done = counts.pop(limit, 0)
    rows = [(GAP, limit, done, opened - done, 0, 0)] if opened > done else []
    # Windows of about equal numbers of pieces; the first is of those that no two of fit one sequence.
    small, at = sum(c for n, c in counts.items() if 2 * n <= limit), 0
    window: dict[int, list[tuple]] = {}
    for n in sorted(counts, reverse=True):
        number = -1 if 2 * n > limit else windows * at // small
        at += counts[n] if 2 * n <= limit else 0
        window.setdefault(number, []).append((PIECE, n, 0, counts[n], 0, 0))
    todo = [window[k] for k in sorted(window)]
    rounds: list[DataFrame] = []
    state, size, left = None, 0, 0  # the runs after the last round, about their number, and the tokens of pieces among them
    while todo or left:
        if todo:
            rows += todo.pop(0)
        else:  # no gap holds what is left
            more = -(-left // limit)
            rows.append((GAP, limit, opened, more, 0, 0))
            opened += more
        runs, parts = spark.createDataFrame(pa.Table.from_batches([rows_out(RUNS, rows)])), max(1, -(-(size + len(rows)) // runs_a_task))
        if state is not None:
            runs = state.unionByName(runs)
        rows = []
        while True:
            seen = Observation()
            kinds = {k: F.sum(F.when(F.col("kind") == k, x).otherwise(0)).alias(f"k{k}") for k, x in ((LINE, F.lit(1)), (PIECE, F.col("size") * F.col("number")))}
            rounds.append(written(_round(runs, parts, limit).observe(seen, F.count("*").alias("n"), *kinds.values()), "round"))
            moved, left, size = (seen.get[x] or 0 for x in (f"k{LINE}", f"k{PIECE}", "n"))
            state = runs = rounds[-1].where(F.col("kind") != LINE)
            if not left or (not moved and parts == 1):
                break
            if not moved:
                parts = max(1, parts // 4)
    if rounds:
        every = reduce(DataFrame.unionByName, rounds).where(F.col("kind") == LINE)
        plan += [tuple(r) for r in every.select("size", "first", "number", "sequence", "offset").collect()]
        dropped(spark, every)
    return plan


PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def packed(parts: DataFrame, limit: int = 2048) -> DataFrame:
    """parts (rows of pieces()) with sequence_id and offset."""
    spark = parts.sparkSession
    rows = written(parts, "pieces")
    order = [F.desc("length"), F.asc("doc_id"), F.asc("piece")]
    place = F.monotonically_increasing_id()  # the partition above 33 bits for the row within it
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    ranged = written(ranged.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place").bitwiseAND((1 << 33) - 1)), "ranged")
    counts = {r["length"]: r["count"] for r in ranged.groupBy("length").count().collect()}
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[p] for p in sorted(sizes))]).tolist()))
    first, at = {}, 0
    for n in sorted(counts, reverse=True):
        first[n], at = at, at + counts[n]
    plan: dict[int, list] = {}
    for line in best_fit(spark, counts, limit):
        plan.setdefault(line[0], []).append(line[1:])
    tables = {n: np.array(sorted(lines), np.int64) for n, lines in plan.items()}
    shared = spark.sparkContext.broadcast((before, first, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first, tables = shared.value
        for b in batches:
            length, place, part = (b.column(i).to_numpy() for i in (3, 5, 6))
            place = place + np.array([before[p] for p in part.tolist()], np.int64)
            seq, off = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rank = place[at] - first[n]
                t = tables[n]
                line = t[np.searchsorted(t[:, 0], rank, "right") - 1]
                seq[at], off[at] = line[:, 2] + rank - line[:, 0], line[:, 3]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema=PLACED)

    return ranged.mapInArrow(run, f"{PIECES_DDL}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, closing: int = 0) -> DataFrame:
    return packed(pieces(docs, tokenizer, limit, closing), limit)
