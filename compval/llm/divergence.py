r"""How far do a language's sources differ in the words they use?

Integer-dictionary encoding. The terms that at least `least` documents of a language hold are kept and sorted; a chunk is
a run of that order, so a term's place in its chunk's sorted array (searchsorted) is its id, and ids of equal values break
ties as UTF-8 bytes do. A bincount over group and id gives a chunk's dense vectors, a row for each source of the language.
Sums of differences over chunks, and each chunk's highest terms, are what leaves a task.

Terms are runs of ASCII letters and characters from U+0080 on, only A-Z lower-cased. The smoothed share of a term in a
group of N kept occurrences is 1 + floor(10^9 (count + 5) / (N + 5 V)), V the number of kept terms, in exact integers (up
to 2^53 occurrences of a term in a group, 9 * 10^15 of all).

Null texts, languages and sources are empty strings; ids are not read, so null and repeated ids make no difference, and
repeated rows are documents like any other. Languages without a kept term still have every pair, at 0. An empty table
gives no rows; other columns are ignored. Long texts are cut at separators, 4 MB at a time.

Counts are combined in each task, in bounded memory, before they are exchanged by source and term, so a source or a word in
any share of the rows is no hot spot. The list of sources with their totals is collected: the result has a row for
each pair of them, so it is the square root of what is asked for.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compval.llm.common import slices, written

#: Letters stay, A-Z as a-z; bytes of characters from U+0080 on stay; all other bytes part terms.
LETTERS = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
PRIOR, SCALE = 5, 1000
PIECE = 4 << 20
#: Entries that a task holds before it hands them on, and cells of a chunk's vectors.
MOST_ENTRIES, MOST_CELLS = 1 << 18, 1 << 21

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def pieces(text: bytes, table: bytes = LETTERS, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text, of about `most` bytes of it at a time."""
    at = 0
    while at < len(text):
        piece = text[at : at + most].translate(table)
        end = len(text)
        if at + most < end:
            cut = piece.rfind(b" ")
            if cut >= 0:
                end, piece = at + cut + 1, piece[:cut]
            else:  # a term longer than a piece
                rest = text[at:].translate(table)
                cut = rest.find(b" ")
                end, piece = (at + cut, rest[:cut]) if cut >= 0 else (end, rest)
        yield piece.split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of the terms of each group; a null term counts the group's documents."""
    number: dict = defaultdict(Counter)
    holders: dict = defaultdict(Counter)
    sizes: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), docs in sizes.items():
            count, held = number[lang, source], holders[lang, source]
            terms = pa.array([*held, None], pa.binary()).cast(pa.string())
            same = [pa.array([v] * len(terms), pa.string()) for v in (lang, source)]
            cols = [*same, terms, pa.array([*held.values(), docs], pa.int64()), pa.array([*(count[t] for t in held), 0], pa.int64())]
            yield from slices([pa.RecordBatch.from_arrays(cols, schema=COUNTS)])
        for x in (number, holders, sizes):
            x.clear()

    for b in batches:
        for b in slices([b]):
            for text, lang, source in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), b.column("source").to_pylist()):
                own: set = set()
                count = number[lang, source]
                for terms in pieces(text):
                    count.update(terms)
                    own.update(terms)
                holders[lang, source].update(own)
                sizes[lang, source] += 1
            if sum(map(len, holders.values())) > MOST_ENTRIES:
                yield from out()
    yield from out()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * count / total), by long division in base 1000, as the product may exceed 64 bits."""
    rest, out = count % total, count // total
    for _ in range(3):
        rest = rest * SCALE
        out, rest = out * SCALE + rest // total, rest % total
    return out + 1


class _Lang:
    """A language's sources in order, their totals, and the number of kept terms."""

    def __init__(self, sources: dict[str, int], v: int):
        self.names = sorted(sources, key=lambda s: s.encode())
        self.keys = np.array([s.encode() for s in self.names], object)
        n = np.array([sources[s] for s in self.names], np.int64)
        self.total = n + PRIOR * v
        self.all = np.array([n.sum() + PRIOR * v], np.int64)

    def vectors(self, source: np.ndarray, term: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's sorted terms and its counts, a row for each source."""
        terms = np.array(sorted(set(term)), object)
        cell = np.searchsorted(self.keys, source) * len(terms) + np.searchsorted(terms, term)
        return terms, np.bincount(cell, weights=n, minlength=len(self.names) * len(terms)).astype(np.int64).reshape(len(self.names), -1)


def _chunks(batches: Iterator[pa.RecordBatch], langs: dict[str, _Lang]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole terms of one language, from rows in order of language and term."""
    lang, held, distinct, last = None, [], 0, None

    def taken() -> tuple:
        source, term, n = (np.array(c, object) for c in zip(*held))
        return lang, source, term, n.astype(np.int64)

    for b in batches:
        cols = [b.column("lang").to_pylist(), *(b.column(c).cast(pa.binary()).to_pylist() for c in ("source", "term")), b.column("n").to_pylist()]
        for at, source, term, n in zip(*cols):
            if at != lang or term != last:
                if held and (at != lang or distinct >= max(1, MOST_CELLS // len(langs[lang].names))):
                    yield taken()
                    held, distinct = [], 0
                lang, last, distinct = at, term, distinct + 1
            held.append((source, term, n))
    if held:
        yield taken()


def _compared(langs: dict[str, _Lang], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart: dict[str, np.ndarray] = {}
        rows: list[tuple] = []
        for lang, source, term, n in _chunks(batches, langs):
            own = langs[lang]
            terms, counts = own.vectors(source, term, n)
            p = shares(counts + PRIOR, own.total[:, None])
            q = shares(counts.sum(axis=0) + PRIOR, own.all)
            sums = apart.setdefault(lang, np.zeros((len(p), len(p)), np.int64))
            for i in range(len(p)):
                sums[i] += np.abs(p - p[i]).sum(axis=1)
                over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                # Ids are in the order of the terms, so a stable sort by value breaks ties by UTF-8 bytes.
                best = over[np.argsort(q[over] - p[i][over], kind="stable")[:most]]
                rows += [(lang, own.names[i], "term", terms[t].decode(), int(p[i][t] - q[t])) for t in best]
            if len(rows) > MOST_ENTRIES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)
                rows = []
        for lang, sums in apart.items():
            names = langs[lang].names
            rows += [(lang, a, "pair", b, int(sums[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)], schema=FOUND)

    return run


def audit(docs: DataFrame, least: int = 30, most: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: of each source its distance to each other one of the language (part pair),
    and the up to `most` terms that it uses more than the language does (part term)."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = read.mapInArrow(_counted, "lang string, source string, term string, docs long, n long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")), "term_counts")
    words = counts.where("term IS NOT NULL")
    kept = words.groupBy("lang", "term").agg(F.sum("docs").alias("df")).where(F.col("df") >= least).drop("df")
    used = written(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept_counts")

    groups = counts.where("term IS NULL").select("lang", "source")
    total = used.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sources: dict[str, dict[str, int]] = defaultdict(dict)
    for lang, source, n in groups.join(total, ["lang", "source"], "left").collect():
        sources[lang][source] = n or 0
    v = dict(used.select("lang", "term").distinct().groupBy("lang").count().collect())
    langs = {lang: _Lang(s, v.get(lang, 0)) for lang, s in sources.items()}

    chunks = used.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    found = written(chunks.mapInArrow(_compared(langs, most), "lang string, source string, part string, item string, value long"), "compared")

    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.withColumnRenamed("source", "item")
    pairs = groups.join(other, "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    cols = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return pairs.withColumn("rank", F.row_number().over(by)).select(*cols).unionByName(terms.select(*cols))
