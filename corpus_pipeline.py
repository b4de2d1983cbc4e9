"""From raw documents to packed training sequences, in five stages.

quality          drops what the importance ratio rejects
near_dedup       keeps one document of each group of near duplicates
substring_dedup  cuts strings of 100 bytes that also start earlier; documents of which nothing is left go
secrets          masks the spans of secrets
packing          tokens of the remaining documents in sequences

Each stage reads what its predecessor wrote. All but the last return the columns of documents, n_chars up to date. Rows
that share an id but not the text, or have a null id, are documents of their own; of rows equal in id and text
near_dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compval.llm import packing, quality, secret_scan, simhash, substring_dedup
from compval.llm.common import map_text, read, spare, text_hash, written
from compval.llm.queries import TOKENIZER

#: Near duplicates differ in at most RADIUS bits of a fingerprint and CHECK bits of a second one.
RADIUS, CHECK = 6, 14


def _joined(docs: DataFrame, found: DataFrame, how: str, *names: str) -> DataFrame:
    """docs with `names` of the rows of found (doc_id, h) that are theirs by id and text."""
    at, h = spare(docs, "_id"), spare(docs, "_hash")
    right = found.select(F.col("doc_id").alias(at), F.col("h").alias(h), *names)
    return docs.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col(at)) & (text_hash() == F.col(h)), how).drop(at, h)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _joined(docs, quality.resample(docs, read(spark, sf_dir, "labels")).where("keep"), "left_semi")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = written(simhash.near_duplicates(docs, radius=RADIUS, check=CHECK).where("first"), "groups")
    out = _joined(docs, first, "left_semi")
    if first.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        return out
    # Of rows equal in id and text the one with the least hash of its other columns stays.
    order = Window.partitionBy(F.col("doc_id"), text_hash()).orderBy(F.xxhash64(*(F.col(c) for c in docs.columns)))
    rank = spare(docs, "_rank")
    return out.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    was = spare(docs, "_was")
    out = substring_dedup.deduplicated_text(docs.withColumn(was, F.coalesce(F.length("text"), F.lit(0))))
    return _counted(out.where((F.col(was) == 0) | (F.length("text") > 0)).select(*docs.columns))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    held = spare(docs, "_spans")
    spans = secret_scan.secret_spans(docs).where("spans <> ''").groupBy("doc_id", "h").agg(F.min("spans").alias(held))
    return _counted(map_text(_joined(docs, spans, "left", held), secret_scan.redact, held)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SimHash components, suffix sorting and packing have no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
