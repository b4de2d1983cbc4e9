"""SimHash near-deduplication by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two fingerprints within `radius`
differing bits share their values under at least one of 2^(radius+1) - 1 masks: each bit position has a non-zero vector
over GF(2) of radius + 1 dimensions, and mask v keeps the positions whose vector has an odd inner product with v. The
vectors of up to radius positions never span the space, so some v is orthogonal to all of them and keeps none of them.
With `check`, texts must also lie within that many bits in a second fingerprint, made of the same shingles by other
bits: at a wider radius that is what keeps unrelated texts apart, however many there are.

Equal fingerprints are one node, so a group of copies is a single row from then on. Nodes meet in the buckets of their
masked values, which are read as a sorted stream after one shuffle. A bucket of at most `most` nodes is searched in one
place, which emits a spanning forest of its links and not its pairs; a larger one is dealt again by masks over the bits
that its own mask leaves free, until by the number of free bits alone no bucket can be large. Components come from
alternating large and small stars, each a partial minimum and a join that AQE can split.

Texts are lower-cased in A-Z and cut at ASCII white space. Null texts are empty; a text without words has fingerprint
zero and links like any other. Rows that share an id are one document: they join their groups. Rows with a null id are
documents of their own if their texts differ; a group's component_id is its smallest id, and null only if none of its
rows has one. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import documents, dropped, rows_out, slices, text_hash, written


#: Levels of masks at most.
LEVELS = 3


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def shingle_hashes(text: str, words: int = 3, seed: int = 42) -> np.ndarray:
    w = text.encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    one = xxhash.xxh64_intdigest
    return np.array([one(line[a:b], seed) for a, b in zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist())], np.uint64)


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    return _majority(shingle_hashes(text, words, seed))


def _other_bits(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each shingle from its first."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, second: bool = False) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint as a signed long) and, with `second`, fp2 of each row (0 without).
    No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = [shingle_hashes(t, words, seed) for t in b.column(1).to_pylist()]
            fp = np.array([_majority(x) for x in hashes], np.uint64)
            fp2 = np.array([_majority(_other_bits(x)) for x in hashes], np.uint64) if second else np.zeros(len(fp), np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64))], names=["doc_id", "h", "fp", "fp2"])

    return documents(docs, text_hash().alias("h")).mapInArrow(run, "doc_id long, h long, fp long, fp2 long")


@lru_cache
def _vectors(n: int, dimensions: int) -> list[int]:
    """Non-zero vectors for n positions, dealt so that every mask keeps about half of them: each next vector is the one that
    leaves the least sum of 2^-kept over the masks, which is the share of random values that meet."""
    v = np.arange(1, 1 << dimensions)
    odd = np.bitwise_count(v[:, None] & v[None, :]) & 1  # by vector and mask
    share, out = np.ones(len(v)), []
    for _ in range(n):
        best = int(np.argmin((1 - odd / 2) @ share))
        share = share * (1 - odd[best] / 2)
        out.append(best + 1)
    return out


def covering_masks(kept: int = 0, radius: int = 3, bits: int = 64) -> list[int]:
    """Masks that keep `kept` and part of the other bits: values within radius that agree on `kept` agree on one of them."""
    free = [i for i in range(bits) if not kept >> i & 1]
    vector = dict(zip(free, _vectors(len(free), radius + 1)))
    return [kept | sum(1 << bit for bit, x in vector.items() if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def forest(nodes: np.ndarray, fps: np.ndarray, radius: int, checks: np.ndarray | None = None, check: int = 64) -> list[tuple[int, int]]:
    """(node, root) for a spanning forest of the links within a bucket; a root is its tree's smallest node."""
    order = np.argsort(nodes, kind="stable")
    nodes, fps = nodes[order], fps[order].view(np.uint64)
    checks = None if checks is None else checks[order].view(np.uint64)

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= radius
        return out if checks is None else out & (np.bitwise_count(checks[some][:, None] ^ checks[others][None, :]) <= check)

    rest = np.arange(len(nodes))
    if len(nodes) <= 256:  # those without any link are set aside at once
        rest = np.flatnonzero(near(rest, rest).sum(axis=1) > 1)
    out = []
    while len(rest):
        root, rest = rest[0], rest[1:]
        front, fresh = [np.array([root])], 0
        while fresh < len(front) and len(rest):
            todo = front[fresh]
            while len(todo) and len(rest):
                step = max(1, (1 << 19) // len(rest))
                hit = near(todo[:step], rest).any(axis=0)
                todo = todo[step:]
                if hit.any():
                    front.append(rest[hit])
                    rest = rest[~hit]
            fresh += 1
        out += [(int(nodes[j]), int(nodes[root])) for x in front[1:] for j in x.tolist()]
    return out


def _buckets(radius: int, check: int | None, most: int):
    """Over rows (mask, node, fp, fp2) in order of their buckets: (a, b, c, mask) with mask null for links a > b, and else
    with the rows node, fp, fp2 of buckets of over `most` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "c", "mask"]
        table = lambda a, b, c, mask: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, c, mask)], names=names)
        held = [np.empty(0, np.int64)] * 4
        large: tuple[int, int] | None = None  # the bucket that is being passed on
        for b in itertools.chain(batches, [None]):
            mask, node, fp, fp2 = held = held if b is None else [np.concatenate([x, y.to_numpy()]) for x, y in zip(held, b.columns)]
            if not len(mask):
                continue
            k = fp & mask
            head = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (k[1:] != k[:-1])]))
            size = np.diff(np.append(head, len(mask)))
            over = size > most
            over[0] |= large == (int(mask[0]), int(k[0]))
            large = (int(mask[-1]), int(k[-1])) if over[-1] else None
            # The last bucket may go on; it waits unless it is known to be large.
            wait = 0 if b is None or over[-1] else int(size[-1])
            if over.any():
                rows = np.flatnonzero(np.repeat(over, size))
                yield table(node[rows], fp[rows], fp2[rows], mask[rows])
            fine = ~over
            fine[-1] &= wait == 0
            two = head[fine & (size == 2)]
            near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
            if check is not None:
                near &= np.bitwise_count((fp2[two] ^ fp2[two + 1]).view(np.uint64)) <= check
            two = two[near]
            src, dst = [np.maximum(node[two], node[two + 1])], [np.minimum(node[two], node[two + 1])]
            for i in np.flatnonzero(fine & (size > 2)).tolist():
                part = slice(head[i], head[i] + size[i])
                tree = forest(node[part], fp[part], radius, None if check is None else fp2[part], check or 0)
                if tree:
                    src.append(np.array([x for x, _ in tree], np.int64))
                    dst.append(np.array([y for _, y in tree], np.int64))
            src, dst = np.concatenate(src), np.concatenate(dst)
            if len(src):
                yield table(src, dst, np.zeros(len(src), np.int64), pa.nulls(len(src), pa.int64()))
            held = [x[len(x) - wait :] for x in held]

    return run


def _finer(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (mask, node, fp, fp2) once under each mask that keeps the bits of theirs and part of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            mask, *rest = (c.to_numpy() for c in b.columns)
            for m in np.unique(mask).tolist():
                if m not in known:
                    known[m] = np.array(covering_masks(m & (1 << 64) - 1, radius), np.uint64).view(np.int64)
                at = np.flatnonzero(mask == m)
                for i in range(0, len(at), 1 << 12):
                    part, n = at[i : i + (1 << 12)], len(known[m])
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(known[m], len(part))), *(pa.array(np.repeat(x[part], n)) for x in rest)], names=b.schema.names)

    return rows.mapInArrow(run, "mask long, node long, fp long, fp2 long")


def links(nodes: DataFrame, radius: int = 3, most: int = 1 << 17, check: int | None = None) -> DataFrame:
    """Distinct edges (src > dst) whose components are those of all links among the nodes (node, fp, fp2; distinct)."""
    masks = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in covering_masks(0, radius)))
    keyed = nodes.select(F.explode(masks).alias("mask"), "node", "fp", "fp2")
    bucket, found = [F.col("mask"), F.col("fp").bitwiseAND(F.col("mask"))], []
    for level in range(1, LEVELS + 1):
        # A bucket of the last level has at most 2^8 fingerprints, as each mask keeps about half of the bits still free.
        run = _buckets(radius, check, most if level < LEVELS else 1 << 62)
        dealt = written(keyed.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(run, "a long, b long, c long, mask long"), "links")
        found.append(dealt.where("mask is null and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        large = dealt.where("mask is not null").select("mask", F.col("a").alias("node"), F.col("b").alias("fp"), F.col("c").alias("fp2")).distinct()
        if level == LEVELS or large.isEmpty():
            break
        keyed = _finer(large, radius)
    return written(reduce(DataFrame.unionByName, found).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges but the roots; a root is its component's smallest node."""
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst")).where("src <> dst").distinct()
        large = written(large, "large-star")
        least = large.groupBy("src").agg(F.min("dst").alias("root"))
        small = large.join(least, "src").select(F.explode(F.array(F.col("src"), F.col("dst"))).alias("src"), F.col("root").alias("dst")).where("src <> dst").distinct()
        small = written(small, "small-star")
        now = state(small)
        dropped(edges.sparkSession, large)
        if now == before:
            return small.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        edges, before = small, now


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, most: int = 1 << 17, check: int | None = None) -> DataFrame:
    """doc_id, h (a hash of the text), fp, component_id (the smallest doc_id reachable by links) and first: whether the row
    stands for its group, having its smallest id and, under one id or none, the least h."""
    rows = written(fingerprints(docs, words, seed, check is not None), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    nodes = written(rows.groupBy("fp", "fp2").agg(F.min(place).alias("least")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(nodes, radius, most, check)
    prints = F.struct("fp", "fp2")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(prints).alias("least"), F.max(prints).alias("most")).where("least <> most")
    several = written(several.select("doc_id"), "several")
    if not several.isEmpty():
        own = rows.join(several, "doc_id").select("doc_id", "fp", "fp2").distinct().join(nodes.select("fp", "fp2", "node"), ["fp", "fp2"])
        own = own.join(own.groupBy("doc_id").agg(F.min("node").alias("dst")), "doc_id").where("node <> dst")
        edges = written(edges.unionByName(own.select(F.col("node").alias("src"), "dst")).distinct(), "edges")
    root = components(edges)
    placed = nodes.join(root, "node", "left").select("fp", "fp2", F.coalesce("root", "node").alias("root"), "least")
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "fp2", "first")
    out = rows.join(named, ["fp", "fp2"])
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return out.select("doc_id", "h", "fp", F.col("first.doc_id").alias("component_id"), first.alias("first"))


def near_duplicate_classes(docs: DataFrame, **options) -> DataFrame:
    out = near_duplicates(docs, **options)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
