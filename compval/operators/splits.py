"""Splits into training and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compval.functions.scalars import hash_byte

DATE = "wertermittlungsstichtag"


def at_date(df: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """Before the date or undated; on or after it."""
    cut = F.lit(date).cast("date")
    return df.where(F.col(DATE).isNull() | (F.col(DATE) < cut)), df.where(F.col(DATE) >= cut)


def at_two_dates(df: DataFrame, train_before: str, test_from: str) -> tuple[DataFrame, DataFrame]:
    return at_date(df, train_before)[0], df.where(F.col(DATE) >= F.lit(test_from).cast("date"))


def _first(df: DataFrame, order: list, ratio: float, rest_rounded: bool) -> DataFrame:
    """df with in_train for the first floor(n ratio) rows of the order (n - floor(n (1 - ratio)) if rest_rounded). Rows are
    range-sorted and numbered partition by partition, so no task holds the table."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = {r["p"]: r["count"] for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    n = sum(sizes.values())
    take = n if n <= 1 else n - int(n * (1 - ratio) + 1e-9) if rest_rounded else int(n * ratio + 1e-9)
    for p in sorted(sizes):
        if take < sizes[p]:
            return ordered.withColumn("in_train", F.col("_at") < (p << 33) + take).drop("_at")
        take -= sizes[p]
    return ordered.withColumn("in_train", F.lit(True)).drop("_at")


def _parts(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("in_train").drop("in_train"), df.where(~F.col("in_train")).drop("in_train")


def by_date_ratio(df: DataFrame, ratio: float, rest_rounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows by date (undated first, then id) to train."""
    return _parts(_first(df, [F.col(DATE).asc_nulls_first(), F.col("id")], ratio, rest_rounded))


def by_hash(df: DataFrame, ratio: float, seed: str, rest_rounded: bool = False) -> tuple[DataFrame, DataFrame]:
    """The first share by a hash of seed and id, then id: the same rows on every run and engine."""
    keyed = df.withColumn("_hash", hash_byte(seed, F.col("id")))
    a, b = _parts(_first(keyed, [F.col("_hash"), F.col("id")], ratio, rest_rounded))
    return a.drop("_hash"), b.drop("_hash")


def by_fold(df: DataFrame, folds: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(folds)))


def mini_batch(df: DataFrame, size: int, seed: int) -> DataFrame:
    """A sample without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)


def numbered(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
