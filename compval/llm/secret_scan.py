r"""Secret scans with corpus-wide ownership.

Three patterns find spans in each text (leftmost, non-overlapping within a kind, code points, end exclusive):
assign, access and hex. Every value they hold, and every other long token that mixes letters and digits, is a
candidate. Candidates' hashes are counted over the corpus by distinct repositories, owners and texts. A value is a
copied example if more than MOST_REPOS repositories hold it, be they of one owner, or if more than MOST_OWNERS owners
do and none of them has all the texts that it stands in: where one has, the others are mirrors (exact copies) of its
documents. Any other value that looks random is live-looking, and its place is a further span, of kind live. The
patterns' own spans stay in either case.

The owner is the `source` column and the repository the document, unless other columns are named. Null texts are empty,
null owners are one owner, and null ids one repository; null ids come back as null. Repeated rows count as repositories
of their own only if their ids differ. An empty table gives no rows; other columns are ignored. Counts go through partial
sums and verdicts are salted, so a value in any share of all rows is no hot spot; what comes back to documents are rows
of candidates only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compval.llm.common import slices, text_hash, written

KINDS = ("assign", "access", "hex", "live")
#: Fixed patterns, with the least length of what is named.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
DIGIT = re.compile(r"[0-9]")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: What a value that is not widely copied has at most.
MOST_REPOS, MOST_OWNERS = 10, 1
SALTS = 8


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def looks_random(value: str) -> bool:
    """Letters and digits, no few characters over and over: over 2.5 bits a character."""
    n = len(value)
    if not (re.search("[A-Za-z]", value) and DIGIT.search(value)):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) > 2.5


def candidates(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(value, start, end) of what may be a credential, each place once."""
    out: dict[tuple[int, int], str] = {}
    for kind, s, e in spans:
        if kind == "assign":
            m = ASSIGN.match(text, s)
            s, e = m.span(2)
        out[s, e] = text[s:e]
    if DIGIT.search(text):
        # Tokens come in order of place, so the taken places that end before one are passed for good.
        taken, at, reach = sorted(out), 0, 0
        for m in TOKEN.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start():
                out[m.span()] = m[0]
    return [(v, s, e) for (s, e), v in out.items() if looks_random(v)]


BASE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("row", pa.int64()),
        ("h", pa.int64()),
        ("owner", pa.string()),
        ("repo", pa.string()),
        ("n_assign", pa.int64()),
        ("n_access", pa.int64()),
        ("n_hex", pa.int64()),
        ("base", pa.string()),
        ("digest", pa.binary()),
        ("found", pa.list_(pa.struct([("hash", pa.binary()), ("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
BASE_DDL = "doc_id long, row long, h long, owner string, repo string, n_assign long, n_access long, n_hex long, base string, digest binary, found array<struct<hash:binary,start:long,end:long>>"


def hashed(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """A row per document: counts and spans of the patterns, and its candidates with their hashes. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(5).to_pylist():
                spans = base_spans(text)
                n = Counter(k for k, _, _ in spans)
                found = [{"hash": hashed(v), "start": s, "end": e} for v, s, e in candidates(text, spans)]
                for c, x in zip(out, (n["assign"], n["access"], n["hex"], joined(spans), hashed(text) if found else None, found)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(c, BASE.field(i + 5).type) for i, c in enumerate(out))], schema=BASE)

    null = F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        text_hash().alias("h"),
        (F.col(owner).cast("string") if owner in docs.columns else null).alias("owner"),
        (F.col(repo).cast("string") if repo in docs.columns else null).alias("repo"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, BASE_DDL)


def ownership(scanned: DataFrame) -> DataFrame:
    """For each candidate's hash the distinct owners, repositories and texts that hold it, and the texts of the owner that
    has most of them."""
    each = scanned.select(F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"), "digest", F.explode("found").alias("f")).select("f.hash", "owner", "repo", "digest")
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("places"))
    most = each.select("hash", "owner", "digest").distinct().groupBy("hash", "owner").count().groupBy("hash").agg(F.max("count").alias("most_texts"))
    texts = each.select("hash", "digest").distinct().groupBy("hash").agg(F.count("*").alias("texts"))
    return owners.join(most, "hash").join(texts, "hash")


def secret_spans(docs: DataFrame, owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """A row per document: counts, `base` spans, `live` spans (start and end), all `spans` joined, and how many of its
    candidates are copied examples. A live value has at most most_repos repositories, and at most most_owners owners or
    one that has all its texts."""
    scanned = written(scan(docs, owner, repo), "secrets")
    places = scanned.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    # A value in any share of all places is dealt to SALTS tasks, its verdict to each of them.
    salted = ownership(scanned).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = places.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).withColumn("live", (F.col("repos") <= most_repos) & ((F.col("owners") <= most_owners) | (F.col("most_texts") == F.col("texts"))))
    added = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live"), F.struct("start", "end")))).alias("live"),
        F.count(F.when(~F.col("live"), True)).alias("n_copied"),
    )
    live = F.transform("live", lambda x: F.concat(F.lit("live:"), x["start"], F.lit(":"), x["end"]))
    every = F.array_distinct(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ",")), F.coalesce(live, F.array().cast("array<string>"))))
    kind = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    part = lambda x, i: F.split(x, ":")[i]
    keyed = F.transform(every, lambda x: F.struct(part(x, 1).cast("long").alias("s"), kind[part(x, 0)].alias("k"), part(x, 2).cast("long").alias("e"), x.alias("t")))
    spans = F.array_join(F.transform(F.sort_array(keyed), lambda x: x["t"]), ",")
    # Documents without candidates have nothing to join, so only those with some are shuffled.
    with_some = scanned.where(F.size("found") > 0).join(added, "row", "left").withColumn("spans", spans)
    without = scanned.where(F.size("found") == 0).withColumns({"live": F.array().cast("array<struct<start:long,end:long>>"), "n_copied": F.lit(0).cast("long"), "spans": F.col("base")})
    keep = ["doc_id", "h", "row", "n_assign", "n_access", "n_hex", "base", "live", "n_copied", "spans"]
    return with_some.select(*keep).unionByName(without.select(*keep))


def secret_digests(docs: DataFrame, **options) -> DataFrame:
    out = secret_spans(docs, **options)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", F.size("live").cast("long").alias("n_live"), "n_copied")


MASK = {"assign": "<SECRET>", "access": "<ACCESS_KEY>", "hex": "<HEX>", "live": "<SECRET>"}


def redact(text: str, spans: str | None) -> str:
    """text with every span replaced by its kind's mask; overlapping spans are replaced as one."""
    if not spans:
        return text
    out, at, last = [], 0, 0
    for kind, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))):
        if s >= last:
            out += [text[at:s], MASK[kind]]
        at = last = max(last, e)
    return "".join(out) + text[at:]
