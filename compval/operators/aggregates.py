"""Weighted means and medians, error measures, percentiles of deviations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compval.durable import saved
from compval.functions.scalars import sqm_price


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of weight x value over the weights' sum; null for no rows, NaN for a sum of 0."""
    w = F.sum(weight)
    return F.when(w == 0, float("nan")).otherwise(F.try_divide(F.sum(value * weight), w))


def reaching(df: DataFrame, by: list[str], value: str, weight: Column, goal: Callable[[Column, Column], Column], out: str) -> DataFrame:
    """By group (a null key is one) the smallest value where goal(weight of the values up to it, weight of the group) holds;
    groups without weights have no row. Weights are 0 or more. Those of equal values are added up first; the sums are ranged
    by group and value, so a group of any size is spread over tasks, and the ranges' sums say which one range of a group to
    go through. Null values come first but are never the result."""
    sums = df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    ranged = saved(sums.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = ranged.groupBy(*by, "_p").agg(F.sum("_w").alias("_s")).withColumns({"_before": before, "_total": F.sum("_s").over(group)})
    there = parts.where(goal(F.col("_before") + F.col("_s"), F.col("_total"))).groupBy(*by).agg(F.min(F.struct("_p", "_before", "_total")).alias("_at"))
    there = there.select(*[F.col(k).alias(f"_by_{k}") for k in by], "_at._before", "_at._total", F.col("_at._p").alias("_in"))
    same = F.col("_p") == F.col("_in")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    cum = F.sum("_w").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = ranged.join(there, same).withColumn("_cum", F.col("_before") + cum)
    # A sum that misses the goal by rounding alone ends at the range's last value.
    last = F.coalesce(F.min(F.when(goal(F.col("_cum"), F.col("_total")), F.col("_v"))), F.max("_v"))
    return found.groupBy(*by).agg(last.alias(out))


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """By group the smallest value whose cumulated weight reaches half of the whole."""
    return reaching(df, by, value, F.col(weight), lambda cum, total: cum >= total / 2, out)


MEASURES = ("mse", "rmse", "mae", "mpe", "mape", "median_ape", "msle", "rmsle", "mape_on_logs", "r2", "pe5", "pe10", "pe15", "pe20")


def kpi(real: Column, pred: Column, strict: bool = False) -> dict[str, Column]:
    """The 14 error measures of square-metre prices as aggregates; strict counts |pe| < t and not <= t."""
    d, pe = real - pred, (real - pred) / real
    ape = F.abs(pe)
    logs = F.log1p(real) - F.log1p(pred)
    share = lambda t: F.avg(F.when(ape < t if strict else ape <= t, 1.0).otherwise(0.0))
    ordered = F.sort_array(F.collect_list(ape))
    at = F.least(F.floor((F.size(ordered) + 1) / 2), F.size(ordered) - 1).cast("int")
    mse = F.avg(d * d)
    return {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(d)),
        "mpe": F.avg(pe),
        "mape": F.avg(ape),
        "median_ape": F.try_element_at(ordered, at + 1),
        "msle": F.avg(logs * logs),
        "rmsle": F.sqrt(F.avg(logs * logs)),
        "mape_on_logs": F.avg(F.abs(1 - F.log(real) / F.log(pred))),
        "r2": 1 - F.try_divide(mse, F.var_pop(real)),
        **{f"pe{t}": share(t / 100) for t in (5, 10, 15, 20)},
    }


def _median_ape(df: DataFrame, by: list[str]) -> DataFrame:
    """The absolute percentage error at 0-based index min(floor((n + 1) / 2), n - 1) of its order."""
    return reaching(df, by, "_ape", F.lit(1), lambda cum, n: cum > F.least(F.floor((n + 1) / 2), n - 1), "median_ape")


def evaluate(pairs: DataFrame, by: list[str] | None = None, real: str = "sqm", pred: str = "pred_sqm", strict: bool = False) -> DataFrame:
    """A row of measures, or one for each group of `by` with a valid pair set (groups that hold an invalid one are left
    out; null keys are the group ""). Without `by`, an empty or invalid set is an error."""
    r, p = F.col(real), F.col(pred)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    invalid = F.coalesce(bad(r) | bad(p) | (r <= 1), F.lit(True))
    measures = {k: v for k, v in kpi(r, p, strict).items() if k != "median_ape"}
    columns = [v.alias(k) for k, v in measures.items()]
    # What is measured is a few columns a pair; the predictions behind it are computed once.
    pairs = pairs.select(*(by or []), real, pred).persist()
    if by is None:
        n = pairs.agg(F.count("*").alias("n"), F.count(F.when(invalid, 1)).alias("bad")).first()
        if not n["n"] or n["bad"]:
            raise ValueError(f"{n['bad']} of {n['n']} pairs can't be evaluated")
        (median,) = at_ranks(pairs.select(F.abs((r - p) / r).alias("v")), lambda n: [min((n + 1) // 2, n - 1)])
        return pairs.agg(*columns).withColumn("median_ape", F.lit(median)).select(*MEASURES)
    keyed = pairs.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in by})
    out = keyed.groupBy(*by).agg(*columns, F.count("*").alias("n"), F.count(F.when(invalid, 1)).alias("_bad")).where("_bad = 0").drop("_bad")
    return out.join(_median_ape(keyed.withColumn("_ape", F.abs((r - p) / r)), by), by).select(*by, "n", *MEASURES)


def at_ranks(values: DataFrame, ranks: Callable[[int], list[int]]) -> list[float]:
    """The values (column v) at 0-based ranks of their order, given their number: range-partitioned sorting and counts by
    partition say which rows these are, so no task holds the column."""
    ordered = values.repartitionByRange("v").sortWithinPartitions("v").withColumn("_at", F.monotonically_increasing_id()).persist()
    try:
        sizes = sorted((r["p"], r["count"]) for r in ordered.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
        found = {}
        wanted = ranks(sum(n for _, n in sizes))
        for rank in wanted:
            left = rank
            for p, n in sizes:
                if left < n:
                    found[rank] = (p << 33) + left
                    break
                left -= n
        rows = {r["_at"]: r["v"] for r in ordered.where(F.col("_at").isin(list(found.values()))).collect()} if found else {}
        return [rows[found[rank]] for rank in wanted]
    finally:
        ordered.unpersist()


def summarised(kpis: DataFrame, how: str = "avg") -> DataFrame:
    """Mean, sum, worst or best of rows of measures; r2 and the shares are the better the higher."""
    higher = {"r2", "pe5", "pe10", "pe15", "pe20"}
    pick = {"avg": lambda k: F.avg(k), "sum": lambda k: F.sum(k), "worst": lambda k: (F.min if k in higher else F.max)(k), "best": lambda k: (F.max if k in higher else F.min)(k)}[how]
    return kpis.agg(*[pick(k).alias(k) for k in MEASURES])


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """The measures of one row less those of another."""
    signed = first.select(*MEASURES).unionByName(second.select(*[(-F.col(k)).alias(k) for k in MEASURES]))
    return signed.agg(*[F.sum(k).alias(k) for k in MEASURES])


def deviation(pairs: DataFrame, relative: bool, percentiles: int = 9, real: str = "sqm", pred: str = "pred_sqm", strict: bool = False) -> DataFrame:
    """Mean, least and largest deviation, and the values at index floor(p n / (m + 1)) of its order for p = 1..m. Pairs
    without a deviation are left out; with strict they are an error, and so are real prices of 0 in the relative one."""
    if strict:
        unknown = lambda c: c.isNull() | F.isnan(c)
        nothing = (F.abs(F.col(real)) < 2.220446049250313e-16) & F.lit(relative)
        bad = pairs.where(unknown(F.col(real)) | unknown(F.col(pred)) | nothing).count()
        if bad:
            raise ValueError(f"{bad} pairs have no deviation")
    d = F.abs(F.col(real) - F.col(pred))
    v = pairs.select((F.try_divide(d, F.col(real)) if relative else d).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    found = at_ranks(v, lambda n: [p * n // (percentiles + 1) for p in range(1, percentiles + 1)])
    return v.agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")).select("*", *[F.lit(x).alias(f"p{i}") for i, x in enumerate(found, 1)])


def fold_mean(pairs: DataFrame, fold: str = "fold") -> DataFrame:
    """The mean over folds of each fold's measures."""
    return summarised(evaluate(pairs.withColumn(fold, F.col(fold).cast("string")), [fold]))


def with_sqm(listings: DataFrame) -> DataFrame:
    return listings.withColumn("sqm", sqm_price())
