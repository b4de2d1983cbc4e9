r"""Ranked lexical search, document at a time.

An index holds shards of documents, each sorted by doc_id and of bounded size. A shard's postings of a term are the places
of the documents that hold it, in that order, as gaps, each with its number of occurrences, all in bytes of seven bits
(LEB128). A search takes queries in blocks. For each query and shard the postings of its terms are merged by a heap of
their next documents, one document at a time, into a bounded heap of the best by score, then doc_id; the shards' lists
are merged into one. Lists whose highest scores together cannot reach the worst of a full result heap are not merged: a
document of theirs alone cannot enter, and for any other they are looked up.

Terms are runs of ASCII digits and letters and characters from U+0080 on, only A-Z lower-cased. A term in df of N
documents with terms weighs w = floor(1000 ln((2N + 2) / (2df + 1))); in a document of n terms, L in all, where it occurs
tf times it scores w * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25nN div L. A query's repeated terms count as often.

Null texts are empty; what has no term is no document and never found. Null ids come back as null, after all others of
equal score; rows that share an id are documents of their own, so an id may come back twice. Queries equal in id and text
are one query. Queries without terms, empty tables and queries that nothing matches give no rows. Other columns are
ignored. Long texts are read 4 MB at a time, and one makes a shard of its own.

A shard is what a task holds, and its postings of a block's terms are what a search exchanges; a hot source or word makes
no group but that. A block's terms, with their numbers of documents, go through the driver and are broadcast: a block is at
most BLOCK queries, and fewer if they hold BLOCK_TERMS terms (one query alone may hold more).
"""

from __future__ import annotations

import heapq
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compval.llm.common import documents, slices, written
from compval.llm.divergence import pieces

#: Digits and letters stay, A-Z as a-z; bytes of characters from U+0080 on stay; all other bytes part terms.
WORDS = bytes(c if c >= 128 or 97 <= c < 123 or 48 <= c < 58 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: Bytes of text and documents of a shard, queries and terms of a block.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15
BLOCK, BLOCK_TERMS = 1024, 1 << 18

INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("n", pa.int64()), ("postings", pa.binary())])
INDEX_DDL = "shard long, term string, df long, n long, postings binary"
HITS = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def term_counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for terms in pieces(text, WORDS):
        out.update(terms)
    return out


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LEB128 of non-negative integers in one run of bytes, and the length of each."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= 1 << 7 * k
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        on = size > k
        out[start[on] + k] = (values[on] >> 7 * k) & 127 | np.where(size[on] > k + 1, 128, 0)
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last + 1])[: len(last)]
    k = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * k, first) if len(last) else last


def shard_rows(shard: int, docs: list[tuple[int | None, bytes]]) -> Iterator[pa.RecordBatch]:
    """A row for each term, and one of null term for the documents: ids, which are null, and numbers of terms."""
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    vocabulary: dict[bytes, int] = {}
    term, tf, ids, lengths, widths = array("q"), array("q"), [], [], []
    for doc_id, text in docs:
        counts = term_counts(text)
        if counts:
            term.extend([vocabulary.setdefault(t, len(vocabulary)) for t in counts])
            tf.extend(counts.values())
            ids.append(doc_id)
            lengths.append(counts.total())
            widths.append(len(counts))
    if not ids:
        return
    ids_of = np.array([-1 if i is None else i for i in ids], np.int64)
    held = [ids_of, np.array([i is None for i in ids], np.int64), np.array(lengths, np.int64)]
    own = pa.array([zlib.compress(np.concatenate(held).tobytes(), 1)], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([None], pa.string()), pa.array([len(ids)]), pa.array([sum(lengths)]), own], schema=INDEX)

    term, tf = np.frombuffer(term, np.int64), np.frombuffer(tf, np.int64)
    place = np.repeat(np.arange(len(ids), dtype=np.int64), widths)
    by = np.argsort(term, kind="stable")
    term, tf, place = term[by], tf[by], place[by]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    gap = np.diff(place, prepend=0)
    gap[first] = place[first]
    data, size = packed(np.stack([gap, tf], axis=1).ravel())
    size = np.add.reduceat(size, 2 * first)
    df = np.diff(np.append(first, len(term)))
    n = np.add.reduceat(tf, first)
    at = np.concatenate([[0], np.cumsum(size)])
    names = pa.array(list(vocabulary), pa.binary()).cast(pa.string())
    step = 1 << 15
    for i in range(0, len(first), step):
        j = min(i + step, len(first))
        offsets = (at[i : j + 1] - at[i]).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(offsets), pa.py_buffer(data[at[i] : at[j]])])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, shard)), names.slice(i, j - i), pa.array(df[i:j]), pa.array(n[i:j]), postings], schema=INDEX)


def _sharded(shard_bytes: int, shard_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for b in slices([b]):
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                    if held and (size + len(text) > shard_bytes or len(held) >= shard_docs):
                        yield from shard_rows(shard, held)
                        shard, held, size = shard + 1, [], 0
                    held.append((doc_id, text))
                    size += len(text)
        yield from shard_rows(shard, held)

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """shard, term, df, n, postings of every term of all documents, as a table in the shared folder."""
    return written(documents(docs).mapInArrow(_sharded(shard_bytes, shard_docs), INDEX_DDL), "postings")


class Postings:
    """A shard's documents that hold a term, in order, and what the term adds to their scores."""

    def __init__(self, data: bytes, weight: int, m: np.ndarray):
        pairs = unpacked(data).reshape(-1, 2)
        place, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
        score = weight * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
        self.places, self.scores, self.most = place.tolist(), score.tolist(), int(score.max())
        self.at = dict(zip(self.places, self.scores))


def best_of_shard(lists: list[tuple[Postings, int]], k: int) -> list[tuple[int, int]]:
    """(score, place) of the k documents of highest score above 0, ties to the lower place, of lists that count so often."""
    lists = sorted(((p, times) for p, times in lists if p.most > 0), key=lambda x: x[0].most * x[1])
    reach, total = [], 0  # what the lists up to each one add at most
    for p, times in lists:
        total += p.most * times
        reach.append(total)
    first = 0  # lists before it are looked up only
    heap = [(p.places[0], i, 0) for i, (p, _) in enumerate(lists)]
    heapq.heapify(heap)
    best: list[tuple[int, int]] = []  # (score, -place), the worst first
    while heap:
        place, score = heap[0][0], 0
        while heap and heap[0][0] == place:
            _, i, j = heap[0]
            p, times = lists[i]
            if i < first:  # now only looked up
                heapq.heappop(heap)
                continue
            score += p.scores[j] * times
            if j + 1 < len(p.places):
                heapq.heapreplace(heap, (p.places[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
        if not score:
            continue
        least = best[0][0] if len(best) == k else 0
        for i in range(first - 1, -1, -1):
            if score + reach[i] <= least:
                score = 0
                break
            p, times = lists[i]
            score += p.at.get(place, 0) * times
        if score > least:
            (heapq.heapreplace if len(best) == k else heapq.heappush)(best, (score, -place))
            if len(best) == k:
                # A later document needs more than the worst score kept.
                while first < len(lists) and reach[first] <= best[0][0]:
                    first += 1
    return [(score, -place) for score, place in best]


def _searched(queries: list[dict[str, int]], weights: dict[str, int], n_docs: int, n_terms: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = dict(zip(table.column("term").to_pylist(), table.column("postings").to_pylist()))
        held = np.frombuffer(zlib.decompress(rows.pop(None)), np.int64).reshape(3, -1)
        sizes, which = np.unique(held[2], return_inverse=True)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)[which]
        lists = {t: Postings(data, weights[t], m) for t, data in rows.items()}
        out: list[tuple] = []
        for q, terms in enumerate(queries):
            for score, place in best_of_shard([(lists[t], c) for t, c in terms.items() if t in lists], k):
                out.append((q, None if held[1][place] else int(held[0][place]), score))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, HITS)], schema=HITS)

    return run


def _blocks(queries: DataFrame, id_col: str) -> Iterable[list[tuple[int | None, dict[str, int]]]]:
    block, terms = [], 0
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    for q, text in asked.toLocalIterator():
        counts = {t.decode(): c for t, c in term_counts(text.encode()).items()}
        if block and (len(block) == BLOCK or terms + len(counts) > BLOCK_TERMS):
            yield block
            block, terms = [], 0
        block.append((q, counts))
        terms += len(counts)
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each query (all, if fewer)."""
    spark = index.sparkSession
    n_docs, n_terms = index.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = None
    for block in _blocks(queries, id_col) if n_docs else ():
        asked = spark.createDataFrame([(t,) for t in sorted(set().union(*(c for _, c in block)))], "term string")
        found = index.join(F.broadcast(asked), "term", "left_semi")
        df = dict(found.groupBy("term").agg(F.sum("df")).collect())
        # In doubles, as the score is defined; all else is in integers.
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
        terms = [{t: c for t, c in counts.items() if weights.get(t, 0) > 0} for _, counts in block]
        shards = found.unionByName(index.where("term IS NULL")).select("shard", "term", "postings")
        # A shard's work lies in its merges, not in its bytes, so partitions are not put together by size.
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        hits = shards.repartition(tasks, "shard").groupBy("shard").applyInArrow(_searched(terms, weights, n_docs, n_terms, k), "query long, doc_id long, score long")
        ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], f"query long, {id_col} long")
        by = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(ids), "query").select(id_col, "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long") if out is None else out


def rank(docs: DataFrame, queries: DataFrame, id_col: str = "item_id", k: int = 20) -> DataFrame:
    return search(build_index(docs), queries, id_col, k)
