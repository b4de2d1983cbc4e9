"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block by block. A round counts scores by a digit of their binary form,
from the highest digit down: each task keeps, for each query, only the top buckets that hold its k best so far, which
is all that can decide where the kth value lies. Summed over tasks, the counts name the bucket of each query's kth
value, and the next round looks inside it, until buckets are single scores. A last pass keeps what scores above the kth
value, and of its ties the smallest ids. No task emits over k rows a query and round, whatever the number of copies.

Queries are taken in blocks of `block` by id, so what the driver holds and broadcasts is bounded by block x dimension.
Vectors are scaled and floored to integers; vectors that are null, or hold null or non-finite components, take no part,
nor do rows with a null id. Only vectors of equal length are compared. A candidate with a query's own id is no answer
to it; repeated rows are each a candidate, and each a query. Fewer than k candidates are all returned. Scores are exact
over the whole range of a long; components and scores beyond it are held at its ends. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compval.llm.common import fresh_path

EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id (long) and vec (array of long, floor(scale * x)) of the rows that take part."""
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("vec"))


@dataclass
class Block:
    """Queries of one length: ids, vectors, and where the kth value of each is known to lie."""

    ids: np.ndarray
    vecs: np.ndarray
    prefix: np.ndarray  # the digits of the kth score that are known
    need: np.ndarray  # how many of the k answers lie within that prefix
    all_in: np.ndarray  # fewer than k candidates: every one is an answer
    number: np.ndarray  # of the query within its block


def _largest(x: np.ndarray) -> float:
    """The largest magnitude; the least long has no positive twin, so no absolute value is taken."""
    return max(float(x.max()), -float(x.min())) if x.size else 0.0


def _scores(block: Block, vecs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products, and which of them count: all but a query's with its own id."""
    if _largest(block.vecs) * _largest(vecs) * max(1, vecs.shape[1]) < EXACT:
        out = (block.vecs.astype(float) @ vecs.astype(float).T).astype(np.int64)
    else:
        out = np.clip(block.vecs.astype(object) @ vecs.astype(object).T, LEAST, MOST).astype(np.int64)
    fine = np.ones(out.shape, bool)
    for j in np.flatnonzero(np.isin(ids, block.ids)).tolist():
        fine[block.ids == ids[j], j] = False
    return out, fine


def _parts(batch: pa.RecordBatch, queries: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, vectors, ids) of a batch, in pieces whose score matrix stays within 2 million cells."""
    ids, held = batch.column(0).to_numpy(), batch.column(1)
    sizes = np.diff(held.offsets.to_numpy())
    values, first = held.values.to_numpy(), held.offsets.to_numpy()[:-1]
    step = max(16, 2_000_000 // max(1, queries))
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            yield n, values[first[r][:, None] + np.arange(n)], ids[r]


def _trim(q: np.ndarray, v: np.ndarray, c: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums counts of equal (query, value) and keeps, by query, the top values up to its need."""
    order = np.lexsort((~v, q))
    q, v, c = q[order], v[order], c[order]
    head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])) if len(q) else np.empty(0, int)
    if len(head):
        c = np.add.reduceat(c, head)
        q, v = q[head], v[head]
        before = np.cumsum(c) - c
        first = np.searchsorted(q, q)
        keep = before - before[first] < need[q]
        q, v, c = q[keep], v[keep], c[keep]
    return q, v, c


def _histogram(blocks: dict[int, Block], shift: int, known: int | None):
    """Counts of the scores' values at `shift`, of scores that share their query's prefix (at the shift `known`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: [np.empty(0, np.int64)] * 3 for n in blocks}
        floor = {n: np.full(len(b.ids), LEAST, np.int64) for n, b in blocks.items()}
        for batch in batches:
            for n, vecs, ids in _parts(batch, max((len(b.ids) for b in blocks.values()), default=1)):
                if n not in blocks:
                    continue
                b = blocks[n]
                s, ok = _scores(b, vecs, ids)
                v = s >> shift
                ok &= v >= floor[n][:, None]
                if known is not None:
                    ok &= (s >> known) == b.prefix[:, None]
                q, j = np.nonzero(ok)
                if not len(q):
                    continue
                q, v, c = _trim(*(np.concatenate([x, y]) for x, y in zip(held[n], (q, v[q, j], np.ones(len(q), np.int64)))), b.need)
                held[n] = [q, v, c]
                total = np.bincount(q, c, len(b.ids))
                full = np.flatnonzero(total >= b.need)
                last = np.searchsorted(q, full, "right") - 1
                floor[n][full] = v[last]
        cols = [np.concatenate([blocks[n].number[q] for n, (q, _, _) in held.items()] or [np.empty(0, np.int64)]), *(np.concatenate([h[i] for h in held.values()] or [np.empty(0, np.int64)]) for i in (1, 2))]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["q", "v", "c"])

    return run


def _answers(blocks: dict[int, Block], k: int):
    """A task's best: all scores above the kth value, and the ties with the smallest ids, k at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: [np.empty(0, np.int64)] * 3 for n in blocks}
        for batch in batches:
            for n, vecs, ids in _parts(batch, max((len(b.ids) for b in blocks.values()), default=1)):
                if n not in blocks:
                    continue
                b = blocks[n]
                s, ok = _scores(b, vecs, ids)
                q, j = np.nonzero(ok & (s >= np.where(b.all_in, LEAST, b.prefix)[:, None]))
                q, v, i = (np.concatenate([x, y]) for x, y in zip(held[n], (q, s[q, j], ids[j])))
                order = np.lexsort((i, ~v, q))
                q, v, i = q[order], v[order], i[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                held[n] = [q[keep], v[keep], i[keep]]
        for n, (q, v, i) in held.items():
            b = blocks[n]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (b.number[q], b.ids[q], i, v)], names=["q", "query_id", "vec_id", "score"])

    return run


def _search(block: list[tuple[int, list[int]]], candidates: DataFrame, k: int, digit: int) -> DataFrame:
    spark = candidates.sparkSession
    by: dict[int, list[int]] = {}
    for number, (_, vec) in enumerate(block):
        by.setdefault(len(vec), []).append(number)
    blocks = {}
    for n, numbers in by.items():
        size = len(numbers)
        vecs = np.array([block[i][1] for i in numbers], np.int64).reshape(size, n)
        blocks[n] = Block(np.array([block[i][0] for i in numbers], np.int64), vecs, np.zeros(size, np.int64), np.full(size, k, np.int64), np.zeros(size, bool), np.array(numbers, np.int64))
    shifts = [*range(_span(blocks, candidates) - digit, 0, -digit), 0]  # of signed numbers, so their order stays
    known = None
    for shift in shifts:
        shared = spark.sparkContext.broadcast(blocks)
        run = lambda batches, s=shared, a=shift, b=known: _histogram(s.value, a, b)(batches)
        counts = candidates.mapInArrow(run, "q long, v long, c long").groupBy("q", "v").agg(F.sum("c").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("q").orderBy(F.desc("v")))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in counts.withColumn("upto", upto).where(F.col("upto") - F.col("c") < k).collect():
            found.setdefault(r["q"], []).append((r["v"], r["c"], r["upto"]))
        for b in blocks.values():
            for i, number in enumerate(b.number.tolist()):
                rows = sorted(found.get(number, []), reverse=True)
                hit = next((x for x in rows if x[2] >= b.need[i]), None)
                if hit is None:
                    b.all_in[i] = True
                elif not b.all_in[i]:
                    b.prefix[i], b.need[i] = hit[0], b.need[i] - (hit[2] - hit[1])
        known = shift
        shared.unpersist()
    shared = spark.sparkContext.broadcast(blocks)
    out = candidates.mapInArrow(lambda batches: _answers(shared.value, k)(batches), "q long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _span(blocks: dict[int, Block], candidates: DataFrame) -> int:
    """Binary digits below which scores may differ: above them there is the sign alone."""
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    most = candidates.agg(F.max(norm).alias("n")).first()["n"] or 0.0
    own = max((float((b.vecs.astype(float) ** 2).sum(axis=1).max(initial=0)) for b in blocks.values()), default=0.0)
    return min(63, (int(min((most * own) ** 0.5 * 1.001, 2.0**63)) + 2).bit_length())


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, block: int = 4096, digit: int = 12) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long): each query's k highest inner products, ties to smaller ids.
    candidates and queries have vec_id and embedding."""
    spark = candidates.sparkSession
    found = quantised(candidates, scale)
    path = fresh_path(spark, "topk")
    held: list[tuple[int, list[int]]] = []

    def flush() -> None:
        _search(held, found, k, digit).write.mode("append").parquet(path)
        held.clear()

    for r in quantised(queries, scale).orderBy("vec_id").toLocalIterator():
        held.append((r["vec_id"], r["vec"]))
        if len(held) == block:
            flush()
    schema = "query_id long, rank int, vec_id long, score long"
    if held:
        flush()
    else:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
