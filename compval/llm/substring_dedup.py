"""Exact substring deduplication by blockwise suffix sorting.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a document of smaller id, or earlier in
the same one. That takes the order of suffixes by their first LENGTH bytes, among equal ones by place; all but the first
of each class of equal ones mark what they cover.

1.  Buckets. The suffix at i belongs to the bucket of its anchor: the GRAM bytes of least hash that start within i's
    first LENGTH - GRAM + 1 bytes (the first of equal ones). The anchor depends on those LENGTH bytes alone, so equal
    strings fall into the same bucket at the same distance from their anchors. Consecutive suffixes with one anchor are
    a run, and a run's text is at most twice LENGTH bytes. A run whose text equals an earlier run's is marked as a whole.
    Equal runs are summed up before the shuffle; in the bucket they stand side by side, in order of place.
2.  Blocks. What is left are buckets with several different run texts. Only for these the text is fetched, and one block
    of buckets at a time is sorted. Within a bucket all texts are aligned at their anchors, so suffixes that can tie have
    the same distance from it, and a cover of every STEP-th position is a difference cover for them: the cover's
    positions are ranked first, by doubling, and a suffix is then known by the bytes up to its next cover position, the
    rank there, and the bytes after the ranked length. Long ties cost no comparison beyond that, and memory is bounded
    by the block.
3.  A bucket of more than `most` different texts is not held in one place: each of its suffixes becomes a row, keyed by
    128 bits of hash, whose earliest place is a partial minimum, joined back where AQE can split it.

Texts are taken as UTF-8, null texts as empty. Documents shorter than LENGTH lose nothing. Repeated rows (one id, one
text) are the same place and get the same result; where rows share an id but not the text, marks of either count for
both. Null ids sort first and come back as null; rows with a null id are one document if their texts are equal. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import documents, map_text, rows_out, slices, spare, text_hash, written

LENGTH, GRAM, STEP = 100, 32, 8
#: Suffixes of a run: as many as an anchor has places before it.
REACH = LENGTH - GRAM + 1
#: Bytes that are hashed at once; positions within them take the low bits of a key.
PART, LOW = 1 << 19, np.uint64(20)

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_TEXT = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_POWER: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        n = max(n, 2 * PART)
        _POWER[:] = [np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWER


def _gram_hash(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, step, base = _BYTE[text], 1, _BASE
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        step, base = 2 * step, base * base % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one anchor: (number of the text, first suffix, number of suffixes, distance of the first from
    the anchor, anchor's hash, hash of the run's text). Texts have up to PART bytes in all, or are a single one."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    text = np.frombuffer(b"".join(texts), np.uint8)
    count = np.maximum(size - LENGTH + 1, 0)
    if not count.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = _gram_hash(text)
    least = (h >> LOW << LOW) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= REACH:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if REACH > step:
        least = np.minimum(least[: step - REACH], least[REACH - step :])
    start = end - size
    some = np.flatnonzero(count)
    edge = np.zeros(len(text) + 1, np.int8)
    edge[start[some]] += 1
    edge[start[some] + count[some]] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8)[: len(least)])
    anchor = (least[at] & np.uint64((1 << int(LOW)) - 1)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, n, anchor = at[head], np.diff(np.append(head, len(at))), anchor[head]
    power, unpower = _powers(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_TEXT[text] * power[: len(text)], out=total[1:])
    back = anchor - first
    whole = (total[first + n - 1 + LENGTH] - total[first]) * unpower[first] + (back * 128 + n).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    doc = np.searchsorted(end, first, "right")
    return doc, first - start[doc], n, back, h[anchor], whole


def _parts(docs: list[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of documents: (doc_id, first suffix, suffixes, distance, anchor's hash, text's hash)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        doc, first, n, back, h, whole = runs_of([t for _, _, t in held])
        ids, at = np.array([d for d, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64)
        return ids[doc], at[doc] + first, n, back, h, whole

    for doc, text in docs:
        for at in range(0, max(1, len(text) - LENGTH + 1), PART - LENGTH):
            part = text[at : at + PART - 1]
            if held and size + len(part) > PART:
                yield flush()
                held, size = [], 0
            held.append((doc, at, part))
            size += len(part)
    if held:
        yield flush()


RUNS = pa.schema([("anchor", pa.int64()), ("text", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
#: place holds the first suffix above 14 bits, its distance from the anchor above 7, and the number of suffixes; that of
#: a mark (text 0) holds the first suffix above 32 bits and the number.
RUNS_DDL = "anchor long, text long, doc_id long, place long"
#: Runs that a task holds before it passes them on.
HELD = 1 << 17


def _unrepeated(doc: np.ndarray, place: np.ndarray, h: np.ndarray, whole: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of equal runs the first, and marks (doc, first, n) of the others; the same place read twice is no repeat."""
    order = np.lexsort((place, doc, whole, h))
    doc, place, h, whole = doc[order], place[order], h[order], whole[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (whole[1:] == whole[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] = same[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    head = np.flatnonzero(~same)
    model = np.repeat(head, np.diff(np.append(head, len(h))))
    again = same & ~twice & ((doc != doc[model]) | (place != place[model]))
    return tuple(x[head] for x in (doc, place, h, whole)), (doc[again], place[again] >> 14, place[again] & 127)


def _merged(doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks of one document that meet or overlap as one."""
    if not len(doc):
        return doc, first, n
    order = np.lexsort((first, doc))
    doc, first, end = doc[order], first[order], (first + n)[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(end + (number << 33)) - (number << 33)  # the furthest end so far within the document
    head = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (first[1:] > reach[:-1])]))
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], first[head], reach[last] - first[head]


def bucket_runs(docs: DataFrame) -> DataFrame:
    """Runs by anchor; of equal ones that meet in a task the first, while the others leave as marks (text 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, marked, size = [], [], 0

        def out() -> pa.RecordBatch:
            (doc, place, h, whole), found = _unrepeated(*(np.concatenate(x) for x in zip(*runs)))
            d, first, n = _merged(*(np.concatenate(x) for x in zip(*marked, found)))
            deal = d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # marks are dealt by document
            cols = ((h, deal), (whole, np.zeros(len(d), np.uint64)), (doc, d), (place, (first << 32) | n))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x.view(np.int64), y.view(np.int64)])) for x, y in cols], schema=RUNS)

        for b in slices(batches):
            for doc, first, n, back, h, whole in _parts([(d, t.encode()) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]):
                kept, found = _unrepeated(doc, (first << 14) | (back << 7) | n, h, whole | np.uint64(1))
                runs.append(kept)
                marked.append(_merged(*found))
                size += len(kept[0]) + len(marked[-1][0])
                if size > HELD:
                    yield out()
                    runs, marked, size = [], [], 0
        if runs:
            yield out()

    return docs.mapInArrow(run, RUNS_DDL)


def settle_runs(runs: DataFrame) -> DataFrame:
    """One row for each marked run (text 0) and for each first run of its text in a bucket with several texts. Buckets
    are read as a sorted stream, so none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, int] | None = None  # the last row read
        only: tuple[int, int, int, int] | None = None  # the first text of a bucket that has had no second yet
        for b in batches:
            anchor, text, doc, place = (c.to_numpy() for c in b.columns)
            if not len(anchor):
                continue
            mark = text == 0
            before_a = np.concatenate([[last[0] if last else 0], anchor[:-1]])
            before_t = np.concatenate([[last[1] if last else 0], text[:-1]])
            same_a = anchor == before_a
            if last is None:
                same_a[0] = False
            # Marks have text 0; other texts are odd. A mark may share a bucket's number by chance, so it breaks no run.
            same_t = same_a & (text == before_t)
            before_d = np.concatenate([[last[2] if last else 0], doc[:-1]])
            before_p = np.concatenate([[last[3] if last else 0], place[:-1]])
            repeat = ~mark & same_t & ~((doc == before_d) & (place == before_p))
            head = ~mark & ~same_t
            rows = np.flatnonzero(head)
            out_first: list[tuple[int, int, int, int]] = []
            keep = np.zeros(len(anchor), bool)
            if len(rows):
                a = anchor[rows]
                joined = np.zeros(len(rows), bool)
                joined[1:] = a[1:] == a[:-1]
                if only is not None and a[0] == only[0]:
                    joined[0] = True
                    if only[1] != 0:
                        out_first.append(only)
                        only = (only[0], 0, 0, 0)
                several = joined.copy()
                several[:-1] |= joined[1:]
                keep[rows[several]] = True
                r = rows[-1]
                if several[-1]:
                    only = (int(anchor[r]), 0, 0, 0)
                else:
                    only = (int(anchor[r]), int(text[r]), int(doc[r]), int(place[r]))
            last = (int(anchor[-1]), int(text[-1]), int(doc[-1]), int(place[-1]))
            out = np.flatnonzero(keep | mark | repeat)
            kind = np.where(keep[out], text[out], 0)
            where = np.where(repeat[out], (place[out] >> 14 << 32) | (place[out] & 127), place[out])
            cols = [np.concatenate([x, np.array([f[i] for f in out_first], np.int64)]) for i, x in enumerate((anchor[out], kind, doc[out], where))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=RUNS)

    return runs.repartition("anchor").sortWithinPartitions("anchor", "text", "doc_id", "place").mapInArrow(run, RUNS_DDL)


CONTEXTS = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
CONTEXTS_DDL = "anchor long, doc_id long, place long, bytes binary"


def contexts(docs: DataFrame, several: DataFrame) -> DataFrame:
    """The text of each run: its first suffix's start to its last suffix's LENGTH-th byte."""
    lists = several.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, held in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                for r in held:
                    first, n = r["place"] >> 14, r["place"] & 127
                    part = raw[first : first + n - 1 + LENGTH]
                    if len(part) == n - 1 + LENGTH:
                        rows.append((r["anchor"], doc, r["place"], part))
            yield rows_out(CONTEXTS, rows)

    return docs.join(lists, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, CONTEXTS_DDL)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def _shift(rank: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([rank[by:], np.zeros(by, rank.dtype)])


def repeated_suffixes(buckets: list[list[tuple[int, int, bytes]]]) -> list[tuple[int, int, int]]:
    """Of each bucket's suffixes all but the first of each class of equal ones, as (doc_id, first suffix, suffixes).
    A bucket has (doc_id, place, text) of its runs. This is the block that one task sorts at a time."""
    flat = [(g, doc, place, part) for g, bucket in enumerate(buckets) for doc, place, part in sorted(bucket)]
    back = np.array([p >> 7 & 127 for _, _, p, _ in flat], np.int64)
    n = np.array([p & 127 for _, _, p, _ in flat], np.int64)
    left = (-back) % STEP  # so that anchors stand at cover positions
    size = np.array([len(t) for *_, t in flat], np.int64)
    full = (left + size + STEP - 1) // STEP * STEP
    begin = np.cumsum(full) - full
    text = np.frombuffer(b"".join(bytes(int(a)) + t + bytes(int(f - a - len(t))) for a, f, (*_, t) in zip(left, full, flat)) + bytes(2 * STEP), np.uint8)
    word = np.ndarray((len(text) - STEP + 1,), ">u8", text.tobytes(), strides=(1,)).astype(np.uint64)
    rank = np.unique(word[::STEP], return_inverse=True)[1]
    for by in (1, 2, 4):
        rank = _pair(rank, _shift(rank, by))  # of 2, 4, 8 steps
    ranks = {q: _pair(rank, _shift(rank, q - 8)) for q in (LENGTH // STEP - 1, LENGTH // STEP)}
    owner = np.repeat(np.arange(len(flat)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (begin + left)[owner] + j
    head = -at % STEP
    steps = (LENGTH - head) // STEP
    tail = LENGTH - head - steps * STEP
    cover = (at + head) // STEP
    bits = np.uint64(8)
    cut = lambda w, k: np.where(k > 0, w >> ((np.uint64(STEP) - np.minimum(k, STEP).astype(np.uint64)) * bits % np.uint64(64)), 0)
    first, last = cut(word[at], head), cut(word[(cover + steps) * STEP], tail)
    middle = np.where(steps == LENGTH // STEP, ranks[LENGTH // STEP][cover], ranks[LENGTH // STEP - 1][cover])
    group = np.array([g for g, *_ in flat], np.int64)[owner] * 128 + (back[owner] - j)
    key = (group.astype(np.uint64) << np.uint64(32)) | middle.astype(np.uint64)
    order = np.lexsort((last, first, key))  # stable: equal ones stay in order of place
    key, first, last = key[order], first[order], last[order]
    again = np.zeros(len(order), bool)
    again[1:] = (key[1:] == key[:-1]) & (first[1:] == first[:-1]) & (last[1:] == last[:-1])
    hit = np.zeros(len(order), bool)
    hit[order[again]] = True
    # Runs that share document and place are one row read twice: the same start is no earlier start.
    pos = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]))
    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]))
    return [(flat[owner[a]][1], (flat[owner[a]][2] >> 14) + int(j[a]), int(b - a + 1)) for a, b in zip(pos.tolist(), stop.tolist())]


MARKS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
MARKS_DDL = "doc_id long, first long, n long"


def _sorted_blocks(small: DataFrame) -> DataFrame:
    """Marks of buckets that are held whole; blocks of buckets are sorted one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for b in slices(batches):
            for held in b.column(0).to_pylist():
                distinct = {(r["doc_id"], r["place"]): r["bytes"] for r in held}
                block.append([(d, p, t) for (d, p), t in distinct.items()])
                size += sum(map(len, distinct.values()))
                if size > 1 << 20:
                    yield rows_out(MARKS, repeated_suffixes(block))
                    block, size = [], 0
        if block:
            yield rows_out(MARKS, repeated_suffixes(block))

    held = small.groupBy("anchor").agg(F.collect_list(F.struct("doc_id", "place", "bytes")).alias("held"))
    return held.select("held").mapInArrow(run, MARKS_DDL)


def _spread(large: DataFrame) -> DataFrame:
    """Marks of buckets that are too large to be held: by the earliest place of each 128-bit key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("first", pa.int64())])
        for b in batches:
            rows = []
            for doc, place, part in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(xxhash.xxh3_128_digest(part[j : j + LENGTH]), doc, (place >> 14) + j) for j in range(place & 127)]
            yield rows_out(schema, rows)

    each = written(large.select("doc_id", "place", "bytes").mapInArrow(run, "key binary, doc_id long, first long"), "suffixes")
    least = each.groupBy("key").agg(F.min(F.struct("doc_id", "first")).alias("least"), F.count("*").alias("n")).where("n > 1")
    later = each.join(least, "key").where(F.struct("doc_id", "first") > F.col("least"))
    return later.select("doc_id", "first", F.lit(1).cast("long").alias("n"))


def marks(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Runs of suffixes that also start earlier, of rows of documents(): (doc_id, first, n)."""
    settled = written(settle_runs(bucket_runs(docs)), "runs")
    whole = settled.where("text = 0").select("doc_id", F.shiftright("place", 32).alias("first"), F.col("place").bitwiseAND((1 << 32) - 1).alias("n"))
    several = settled.where("text <> 0").select("anchor", "doc_id", "place")
    large = written(several.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > most), "large")
    held = contexts(docs, several)
    if large.isEmpty():
        return whole.unionByName(_sorted_blocks(held))
    held = written(held.join(large, "anchor", "left"), "contexts")
    return whole.unionByName(_sorted_blocks(held.where("size is null"))).unionByName(_spread(held.where("size is not null")))


def spans_of(found: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marks (first, n) cover, start and end."""
    out: list[list[int]] = []
    for first, n in sorted(found):
        end = min(first + n - 1 + LENGTH, size)
        if first >= end:
            continue
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(a, b) for a, b in out]


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`, a long in the order of documents: doc_id where that is unique and never null."""
    own = F.col("doc_id").cast("long")
    ids = docs.select(own.alias("doc_id"), text_hash().alias("h"))
    if ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, own)
    order = written(ids.distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("number", F.monotonically_increasing_id()), "order")
    order = order.select(F.col("doc_id").alias(f"{name}d"), F.col("h").alias(f"{name}h"), F.col("number").alias(name))
    same = own.eqNullSafe(F.col(f"{name}d")) & (text_hash() == F.col(f"{name}h"))
    return written(docs.join(order, same).select(*docs.columns, name), "numbered")


def repeated_spans(docs: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, text and marks (first suffix and number of suffixes) of each row."""
    rows = numbered(documents(docs), "number")
    found = written(marks(rows.select(F.col("number").alias("doc_id"), "text"), most), "marks")
    lists = found.groupBy(F.col("doc_id").alias("number")).agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    return rows.join(lists, "number", "left").select("doc_id", "text", "marks")


def deduplicate(docs: DataFrame, most: int = 4000) -> DataFrame:
    """Per document: bytes, bytes and runs removed, and the digest of what remains."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text, held in zip(*(c.to_pylist() for c in b.columns)):
                raw = text.encode()
                spans = spans_of([(m["first"], m["n"]) for m in held or ()], len(raw))
                digest, at = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(raw[at:s])
                    at = e
                digest.update(raw[at:])
                rows.append((doc, len(raw), sum(e - s for s, e in spans), len(spans), digest.hexdigest()))
            yield rows_out(schema, rows)

    return repeated_spans(docs, most).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(text: str, marks: list[dict] | None) -> str:
    """text without the marked spans, cut inwards to whole characters where one starts or ends within a character."""
    if not marks:
        return text
    raw = text.encode()
    out, at = [], 0
    for s, e in spans_of([(m["first"], m["n"]) for m in marks], len(raw)):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while s < e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append(raw[at:s])
        at = e
    return (b"".join(out) + raw[at:]).decode()


def deduplicated_text(docs: DataFrame, most: int = 4000) -> DataFrame:
    """docs, all columns, each text without its repeated spans."""
    at, held = spare(docs, "_key"), spare(docs, "_marks")
    rows = numbered(docs, at)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    found = written(marks(rows.select(F.col(at).alias("doc_id"), text), most), "marks")
    lists = found.groupBy(F.col("doc_id").alias(at)).agg(F.collect_list(F.struct("first", "n")).alias(held))
    return map_text(rows.join(lists, at, "left").drop(at), without_spans, held)
