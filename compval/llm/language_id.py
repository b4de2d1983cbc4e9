"""Language identification, words first with backoff to character n-grams.

The model counts, over labelled texts, words by language and the character n-grams of those words. A known word scores
its log frequency in each language. An unseen word falls back to its longest n-grams (a space marks its ends): the mean
log frequency of those that are known, or of the next shorter ones if none is, down to single characters. A text's
language has the highest sum; the score is its share after a softmax of the mean over words, times up to `trust` words.

Fitting takes about `per_language` texts of each language at most, dealt by a hash of the id (null: of the text), and
every word and n-gram that occurs `least` times in them; prediction takes every text, whole. Null texts and texts
without a letter are `und` with score 0. Ties go to the first language by name. Rows with a null lang teach nothing; a
model without any language answers `und`. Repeated rows give repeated results, null ids come back as null, other columns
are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import rows_out, slices

WORD = re.compile(r"[^\W\d_]+")
UND = "und"
#: Unseen words that are kept at once, and the longest of them.
SEEN, LONGEST_SEEN = 200_000, 40


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class _Numbers(dict):
    """The row of each word in the model's table; an unseen word gets one when it is first asked for."""

    def __init__(self, model: LanguageModel):
        super().__init__(model.words)
        self.model = model

    def __missing__(self, word: str) -> int:
        m = self.model
        row = m.used
        if row == len(m.table):
            m.table = np.concatenate([m.table, np.zeros((max(1024, len(m.table) // 4), len(m.languages)))])
        m.table[row] = m.backoff(word)
        m.used += 1
        if len(word) <= LONGEST_SEEN:
            self[word] = row
        return row


@dataclass
class LanguageModel:
    """Log frequencies by language: a row a word, and a table of n-grams for each of their lengths."""

    languages: list[str]
    words: dict[str, int]
    table: np.ndarray
    grams: list[dict[str, tuple[float, ...]]]
    trust: int = 20

    def __post_init__(self) -> None:
        self.table = np.asarray(self.table, float).reshape(len(self.words), len(self.languages))
        self.used, self.numbers = len(self.table), None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "table": self.table[: len(self.words)], "used": len(self.words), "numbers": None}

    def backoff(self, word: str) -> tuple[float, ...]:
        for n in range(len(self.grams), 0, -1):
            found = [x for g in grams(word, n) if (x := self.grams[n - 1].get(g)) is not None]
            if found:
                return tuple(sum(c) / len(found) for c in zip(*found))
        return (0.0,) * len(self.languages)

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall(text.lower())) if text else None
        if not counts or not self.languages or not any(c.isalpha() for w in counts for c in w):
            return UND, 0.0
        if self.numbers is None or self.used > len(self.words) + SEEN:
            self.used, self.numbers = len(self.words), _Numbers(self)
        rows = np.fromiter(map(self.numbers.__getitem__, counts), np.int64, len(counts))
        total = np.fromiter(counts.values(), float, len(counts)) @ self.table[rows]
        n = sum(counts.values())
        share = np.exp((total - total.max()) / n * min(n, self.trust))
        best = int(total.argmax())
        return self.languages[best], float(share[best] / share.sum())


def _counted(docs: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, word, n) and (lang, size, gram, n) of labelled texts, summed before and after the shuffle."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
        held: dict[str, Counter] = {}
        out = lambda: rows_out(schema, [(k, w, n) for k, c in held.items() for w, n in c.items()])
        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, held.values())) > 300_000:
                yield out()
                held = {}
        yield out()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
        held: Counter = Counter()
        for b in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                for size in range(1, longest + 1):
                    for g in grams(word, size):
                        held[lang, g] += n
            if len(held) > 300_000:
                yield rows_out(schema, [(*k, n) for k, n in held.items()])
                held = Counter()
        yield rows_out(schema, [(*k, n) for k, n in held.items()])

    by_word = docs.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_gram = by_word.mapInArrow(parts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return by_word, by_gram


def _frequent(counts: DataFrame, name: str, least: int) -> dict[str, dict[str, int]]:
    """name -> {lang: n} of the names that occur at least `least` times. The sample that was counted bounds them."""
    total = counts.groupBy(name).agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return {r[name]: r["by"] for r in total.where(F.col("total") >= least).select(name, "by").toLocalIterator()}


def fit(docs: DataFrame, per_language: int = 3000, longest: int = 4, smooth: float = 0.5, least: int = 2) -> LanguageModel:
    """A model of the labelled rows of docs (doc_id, text, lang)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language, as the model has
    if not sizes:
        return LanguageModel([], {}, np.empty((0, 0)), [])
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, per_language / n)])
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", "text")), F.lit(1 << 52)) / float(1 << 52)  # null ids are dealt by text
    by_word, by_gram = _counted(rows.where(dealt < share[F.col("lang")]), longest)
    by_word, by_gram = by_word.persist(), by_gram.persist()
    try:
        totals = {r["lang"]: r["n"] for r in by_word.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        languages = sorted(sizes)
        logs = lambda found, total: {k: tuple(float(np.log((by.get(g, 0) + smooth) / (total.get(g, 0) + smooth * len(found)))) for g in languages) for k, by in found.items()}
        words = logs(_frequent(by_word, "word", least), totals)
        found = _frequent(by_gram, "gram", least)
        tables = []
        for n in range(1, longest + 1):
            own = {k: v for k, v in found.items() if len(k) == n}
            sums = Counter()
            for by in own.values():
                sums.update(by)
            tables.append(logs(own, sums))
        return LanguageModel(languages, {w: i for i, w in enumerate(words)}, np.array(list(words.values())), tables)
    finally:
        by_word.unpersist()
        by_gram.unpersist()


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs' doc_id, and lang_pred and score by text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches):
            yield rows_out(schema, [(d, *model.predict(t)) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for every text by a model that learns from the rows that aren't held out."""
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
