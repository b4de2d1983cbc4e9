"""Quality by importance resampling over hashed n-grams.

Two generative models are counted over hashed uni- and bigrams of words and punctuation runs: of target texts (labelled
good) and of raw texts (all of them). A text's importance is the ratio of its probabilities under the two; log_weight is
its logarithm. Resampling adds Gumbel noise, by a hash of the id, to log_weight and draws the k highest keys: a sample
without replacement in proportion to importance. The kth key is located by histograms of its digits, never by a global
sort. k is a parameter; unless given it is the number of texts that the classifier keeps.

The classifier reads the same ratio, made comparable between lengths: log_ratio is log_weight over the number of n-grams
(and PRIOR more). Which log_ratio still counts as good is learnt from labelled rows: the threshold parts good from bad
best among those that keep at least `keep_good` of the good. `keep` is whether a text reaches it; no noise is in that.

Raw counts cover every text. Labelled rows, for target and threshold, are about `per_class` of each class at most, dealt
by a hash of the id, so the ids that are broadcast have that bound. Counts are `buckets` numbers a task. Null texts are
empty; an empty text has log_weight 0. Without labelled rows of both classes there is no threshold and everything is
kept. Repeated rows get equal keys, and at the kth value all ties are drawn. Null ids come back as null, and their noise
goes by the text; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import documents, slices, text_hash, written

_rng = np.random.default_rng(5)
_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xC2B2AE3D27D4EB4F
_POWER: list[np.ndarray] = []
SPACE, WORD, PUNCT = 0, 1, 2
#: Stands for any word that follows itself.
SAME = np.uint64(0x5851F42D4C957F2D)
#: N-grams of ratio 1 that every text is thought to have besides its own, so that a few rare words decide little.
PRIOR = 8
_KIND = np.full(256, PUNCT, np.uint8)
_KIND[[*b" \t\n\r\x0b\x0c"]] = SPACE
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = WORD


def _powers(n: int) -> list[np.ndarray]:
    if not _POWER or len(_POWER[0]) < n:
        n = max(n, 1 << 20)
        _POWER[:] = [np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWER


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts one after the other (buckets must be a power of two), and their number before
    each text."""
    text = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _KIND[text]
    at = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    end = np.append(at[1:], len(text))
    real = kind[at] != SPACE
    at, end = at[real], end[real]
    power, unpower = _powers(len(text))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_MIX[text] * power[: len(text)], out=total[1:])
    word = (total[end] - total[at]) * unpower[at] + (end - at).astype(np.uint64)
    word ^= word >> np.uint64(31)
    word *= np.uint64(0x9FB21C651E98DF25)
    bound = np.searchsorted(at, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    doc = np.repeat(np.arange(len(texts)), np.diff(bound))
    pair = (word[:-1] * np.uint64(3) ^ (word[1:] >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
    pair[word[1:] == word[:-1]] = SAME
    inner = doc[1:] == doc[:-1]
    shift = np.uint64(64 - buckets.bit_length() + 1)
    every = np.concatenate([word, pair[inner]]) >> shift
    owner = np.concatenate([doc, doc[1:][inner]])
    order = np.argsort(owner, kind="stable")
    return every[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _grouped(texts: list[str], most: int = 1 << 19) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        raw = t.encode()
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield held


@dataclass
class Importance:
    """The logarithm of the ratio of the two models by bucket, and the least log_ratio that counts as good."""

    table: np.ndarray
    threshold: float

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log_weight, number of n-grams) of each text."""
        weight, number = [], []
        for part in _grouped(texts):
            bucket, bound = features(part, len(self.table))
            total = np.concatenate([[0.0], np.cumsum(self.table[bucket])])
            weight.append(total[bound[1:]] - total[bound[:-1]])
            number.append(np.diff(bound))
        return (np.concatenate(weight), np.concatenate(number)) if weight else (np.empty(0), np.empty(0, np.int64))


def _chosen(labels: DataFrame, per_class: int) -> dict[int, bool]:
    """About per_class ids of each class, or all where there are fewer: good (quality 1, not toxic) and bad."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good"))
    counts = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(counts) < 2:
        return {}
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / float(1 << 52)
    return {r["doc_id"]: r["good"] for r in rows.where(dealt < F.when(F.col("good"), per_class / counts[True]).otherwise(per_class / counts[False])).distinct().collect()}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, buckets: int = 1 << 14, smooth: float = 1.0, keep_good: float = 0.999) -> tuple[Importance, DataFrame]:
    """The model, and the written scores (doc_id, h, log_weight, number) of every text under it; h is a hash of the text."""
    spark = docs.sparkSession
    rows = documents(docs, text_hash().alias("h"))
    chosen = _chosen(labels, per_class)
    held = spark.sparkContext.broadcast(chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in slices(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            for part in _grouped(texts):
                bucket, bound = features(part, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                for i in range(len(part)):
                    if held.value.get(ids[at + i]):
                        target += np.bincount(bucket[bound[i] : bound[i + 1]], minlength=buckets)
                at += len(part)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], names=["bucket", "raw", "target"])

    raw, target = np.full(buckets, smooth), np.full(buckets, smooth)
    for r in rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    model = Importance(np.log(target / target.sum()) - np.log(raw / raw.sum()), -np.inf)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            weight, number = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(weight), pa.array(number)], names=["doc_id", "h", "log_weight", "number"])

    scored = written(rows.mapInArrow(score, "doc_id long, h long, log_weight double, number long"), "scores")
    if chosen:
        ids = spark.createDataFrame([(k, v) for k, v in chosen.items()], "doc_id long, good boolean")
        by_row = scored.join(ids, "doc_id").withColumn("x", F.col("log_weight") / (F.col("number") + PRIOR))
        found = by_row.groupBy("doc_id", "good").agg(F.min("x").alias("x")).collect()  # one an id, as many as chosen
        model.threshold = threshold(np.array([r["x"] for r in found if r["good"]]), np.array([r["x"] for r in found if not r["good"]]), keep_good)
    return model, scored


def threshold(good: np.ndarray, bad: np.ndarray, keep_good: float) -> float:
    """The cut that parts good from bad best, among those that at least keep_good of the good reach."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), cuts) / len(good)
    caught = np.searchsorted(np.sort(bad), cuts) / len(bad)
    fine = np.flatnonzero(kept >= keep_good)
    best = fine[np.argmax(kept[fine] + caught[fine])]
    below = cuts[best - 1] if best else cuts[best] - 1.0
    return float((cuts[best] + below) / 2)


def kth_largest(values: DataFrame, column: str, k: int, digit: int = 16) -> float | None:
    """The kth largest of a column of doubles, by histograms of its digits; None if there are fewer."""
    raw = "transform_bits"
    as_long = lambda batches: (pa.RecordBatch.from_arrays([pa.array(_ordered(b.column(0).to_numpy(zero_copy_only=False)))], names=[raw]) for b in batches)
    keys = values.select(F.col(column).cast("double")).mapInArrow(as_long, f"{raw} long")
    prefix, left = None, k
    for shift in range(64 - digit, -1, -digit):
        rows = keys if prefix is None else keys.where(F.shiftright(raw, shift + digit) == prefix)
        counts = rows.groupBy(F.shiftright(raw, shift).alias("v")).count().collect()
        for v, n in sorted(map(tuple, counts), reverse=True):
            if n >= left:
                prefix = v
                break
            left -= n
        else:
            return None
    return float(_unordered(np.array([prefix], np.int64))[0])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = np.ascontiguousarray(x, float).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def _unordered(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, x ^ np.int64(2**63 - 1), x).view(float)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 42, **options) -> DataFrame:
    """doc_id, h (a hash of the text), log_weight, log_ratio, keep (the classifier's decision), key and drawn (whether the
    text is among the k drawn) for every text."""
    model, scored = fit(docs, labels, **options)
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", "h"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = scored.withColumn("log_ratio", F.col("log_weight") / (F.col("number") + PRIOR))
    rows = rows.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(uniform)))
    keep = F.col("log_ratio") >= F.lit(model.threshold) if np.isfinite(model.threshold) else F.lit(True)
    size = rows.where(keep).count() if k is None else min(k, rows.count())
    least = kth_largest(rows, "key", size) if size else None
    drawn = F.lit(False) if least is None else F.col("key") >= F.lit(least)
    return rows.select("doc_id", "h", "log_weight", "log_ratio", keep.alias("keep"), "key", drawn.alias("drawn"))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return resample(docs, labels, **options).drop("h")
