"""Spatial and interval joins by grid cells: equi-joins that Catalyst can plan, never a product."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compval.durable import saved
from compval.functions.scalars import squared_distance


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


#: Cells are whole numbers within +-2^60; what lies beyond shares the outermost, and the exact condition decides.
_MOST, _LEVELS = float(2**60), 61
#: Nodes (level, node) that make up the cells _a.._b. At level k ceil(a / 2^k) up to floor((b + 1) / 2^k) are left to cover;
#: an odd start is a node of its own, and so is what lies before an odd end.
_FIRST, _END = "shiftright(_a + shiftleft(1L, k) - 1, k)", "shiftright(_b + 1, k)"
_COVER = f"""filter(flatten(transform(sequence(0, {_LEVELS}), k -> array(
IF(({_FIRST} & 1) = 1 AND {_FIRST} < {_END}, named_struct('level', k, 'node', {_FIRST}), NULL),
IF(({_END} & 1) = 1 AND {_FIRST} + ({_FIRST} & 1) < {_END}, named_struct('level', k, 'node', {_END} - 1), NULL)))), n -> n IS NOT NULL)"""


def whole_cell(value: Column, unit: float) -> Column:
    """The cell of a number: its floor in units."""
    return F.floor(F.least(F.greatest(value.cast("double") / unit, F.lit(-_MOST)), F.lit(_MOST))).cast("long")


def radius_join(targets: DataFrame, others: DataFrame, radius: float, a: str = "t_", b: str = "n_", exclude_self: bool = False, compat: bool = False, keys: Callable[[str], list[Column]] | None = None, tasks: int | None = None) -> DataFrame:
    """Pairs (a- and b-prefixed) within radius, inclusive. Cells are as wide as the radius, so a target meets its own and
    the eight around; only targets are repeated. Rows without coordinates have no neighbours. compat truncates the
    coordinates to whole numbers of at least 0 first. keys, of a prefix, are values without which a pair is not asked for: all
    pairs that agree in them, nulls too, are there, and a few others. tasks deals the cells to so many, where the pairs are far
    more than the rows by whose size they would be dealt."""
    if compat:
        whole = lambda df: df.withColumns({c: F.greatest(F.col(c).cast("long"), F.lit(0)).cast("double") for c in ("x", "y")})
        targets, others, limit = whole(targets), whole(others), float(int(radius * radius))
    else:
        limit = float(radius) * radius
    size = max(float(radius), 1e-9)
    near = F.array(*[F.struct((_cell(f"{a}x", size) + i).alias("cx"), (_cell(f"{a}y", size) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    here = lambda df: df.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    left = prefixed(here(targets), a).withColumn("_cell", F.explode(near)).select("*", F.col("_cell.cx").alias("_cx"), F.col("_cell.cy").alias("_cy")).drop("_cell")
    right = prefixed(here(others), b).withColumns({"_cx": _cell(f"{b}x", size), "_cy": _cell(f"{b}y", size)})
    on = ["_cx", "_cy"]
    if keys and keys(a):
        left, right, on = left.withColumn("_k", F.xxhash64(*keys(a))), right.withColumn("_k", F.xxhash64(*keys(b))), [*on, "_k"]
    if tasks:
        left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    out = left.join(right, on).drop(*on).where(squared_distance(a, b) <= limit)
    return out.where(F.col(f"{a}id") != F.col(f"{b}id")) if exclude_self else out


def range_join(rects: DataFrame, points: DataFrame, x: tuple[str, str], y: tuple[str, str], at: tuple[str, str] = ("x", "y"), unit: float = 1.0) -> DataFrame:
    """Rows of rects and points with low <= coordinate < high in both directions; each rectangle has its own bounds (columns
    x and y of rects). On each axis a rectangle falls into the class of the power of two (of cells of `unit`) above its
    width, where it meets two nodes at most; points are repeated for each pair of classes that occurs, not for widths."""
    (xl, xh), (yl, yh), (px, py) = x, y, at
    sized = rects.where((F.col(xl) < F.col(xh)) & (F.col(yl) < F.col(yh)))
    for c, low, high in (("_x", xl, xh), ("_y", yl, yh)):
        sized = sized.withColumns({f"{c}a": whole_cell(F.col(low), unit), f"{c}b": whole_cell(F.col(high), unit)})
        sized = sized.withColumn(f"{c}k", F.length(F.bin(F.col(f"{c}b") - F.col(f"{c}a"))))
    classes = [(r[0], r[1]) for r in sized.select("_xk", "_yk").distinct().collect()]  # 62 x 62 at most
    for c in ("_x", "_y"):
        node = lambda end, c=c: F.expr(f"shiftright({c}{end}, {c}k)")
        sized = sized.withColumn(f"{c}n", F.explode(F.array_distinct(F.array(node("a"), node("b")))))
    sized = sized.drop("_xa", "_xb", "_ya", "_yb")
    if not classes:
        return sized.crossJoin(points.limit(0)).drop("_xk", "_yk", "_xn", "_yn")
    pairs = F.array(*[F.struct(F.lit(i).alias("xk"), F.lit(j).alias("yk")) for i, j in sorted(classes)])
    placed = points.where(F.col(px).isNotNull() & F.col(py).isNotNull()).withColumn("_c", F.explode(pairs)).withColumns({"_xa": whole_cell(F.col(px), unit), "_ya": whole_cell(F.col(py), unit)})
    placed = placed.withColumns({"_xk": F.col("_c.xk"), "_yk": F.col("_c.yk")}).withColumns({"_xn": F.expr("shiftright(_xa, _xk)"), "_yn": F.expr("shiftright(_ya, _yk)")}).drop("_c", "_xa", "_ya")
    met = sized.join(placed, ["_xk", "_yk", "_xn", "_yn"]).drop("_xk", "_yk", "_xn", "_yn")
    return met.where((F.col(px) >= F.col(xl)) & (F.col(px) < F.col(xh)) & (F.col(py) >= F.col(yl)) & (F.col(py) < F.col(yh)))


def rectangle_join(targets: DataFrame, others: DataFrame, width: float, height: float, a: str = "t_", b: str = "n_") -> DataFrame:
    """Pairs where the other lies in [x, x + width) x [y, y + height) of the target."""
    left = prefixed(targets, a).withColumns({"_xh": F.col(f"{a}x") + width, "_yh": F.col(f"{a}y") + height})
    return range_join(left, prefixed(others, b), (f"{a}x", "_xh"), (f"{a}y", "_yh"), (f"{b}x", f"{b}y"), min(1.0, width, height)).drop("_xh", "_yh")


def _ranked(pairs: DataFrame, k: int, a: str, b: str) -> DataFrame:
    order = Window.partitionBy(f"{a}id").orderBy(squared_distance(a, b), F.col(f"{b}id"))
    return pairs.withColumn("knn_rank", F.row_number().over(order)).where(F.col("knn_rank") <= k)


def knn_join(targets: DataFrame, others: DataFrame, k: int, a: str = "t_", b: str = "n_", radius: float | None = None, rounds: int = 20) -> DataFrame:
    """The k nearest others of each target, ties to the smaller id, with knn_rank; ids are unique on either side. A target is
    done once k others lie within the radius it searched; the rest search four times as far. Its first radius follows from the
    density of the others around it, or is the one given. Only ids and places are joined and ranked; what else the rows hold
    comes to the pairs chosen."""
    located = F.col("x").isNotNull() & F.col("y").isNotNull()
    narrow = lambda df: df.where(located).select("id", "x", "y")
    pairs = _nearest(saved(narrow(targets)), saved(narrow(others)), k, a, b, radius, rounds)
    for df, c in ((targets, a), (others, b)):
        more = [x for x in df.columns if x not in ("x", "y")]
        if more != ["id"]:
            pairs = pairs.join(prefixed(df.select(*more), c), f"{c}id")
    return pairs.select(*[f"{a}{c}" for c in targets.columns], *[f"{b}{c}" for c in others.columns], "knn_rank")


#: Where no square as wide as the mean first radius holds more than CROWDED times k others, that radius serves all targets.
CROWDED = 8
#: Levels beyond that of the mean: targets where it is sparser start with up to 2^COARSER times its radius.
COARSER = 2


def _levels(targets: DataFrame, others: DataFrame, k: int, cell: float, top: int, box) -> DataFrame:
    """targets with _l: the first level at which the square of 2^_l cells around a target (for one outside the box of the
    others: around the box's nearest place) holds half of k others, and at least as far as the box. Cells are counted once,
    at level 0, and added up from there."""
    def placed(c: str) -> Column:
        return whole_cell(F.least(F.greatest(F.col(c), F.lit(box[f"lo{c}"])), F.lit(box[f"hi{c}"])) - F.lit(box[f"lo{c}"]), cell)

    up = F.explode(F.sequence(F.lit(0), F.lit(top)))
    at = ("_l", F.expr("shiftright(_cx, _l)").alias("_ux"), F.expr("shiftright(_cy, _l)").alias("_uy"))
    counts = others.groupBy(placed("x").alias("_cx"), placed("y").alias("_cy")).agg(F.count("*").alias("_n"))
    enough = counts.withColumn("_l", up).groupBy(*at).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= (k + 1) // 2).select("_l", "_ux", "_uy")
    near = targets.withColumns({"_cx": placed("x"), "_cy": placed("y")})
    cells = near.select("_cx", "_cy").distinct().withColumn("_l", up).select("_cx", "_cy", *at)
    first = cells.join(enough, ["_l", "_ux", "_uy"]).groupBy("_cx", "_cy").agg(F.min("_l").alias("_l"))
    away = F.greatest(*[F.abs(F.col(c) - F.least(F.greatest(F.col(c), F.lit(box[f"lo{c}"])), F.lit(box[f"hi{c}"]))) for c in ("x", "y")])
    far = F.when(away > cell, F.least(F.ceil(F.log2(away / cell)), F.lit(50)).cast("int")).otherwise(0)
    return near.join(first, ["_cx", "_cy"], "left").select("id", "x", "y", F.greatest(F.coalesce("_l", F.lit(top)), far).alias("_l"))


def _levels_join(targets: DataFrame, others: DataFrame, cell: float, a: str, b: str) -> DataFrame:
    """Pairs within cell * 2^_l, each target's own radius. Others are repeated for the levels that occur."""
    levels = sorted(r[0] for r in targets.select("_l").distinct().collect())  # some 60 at most
    size = F.expr("shiftleft(1L, _l)") * F.lit(cell)
    cells = lambda c, plus: F.floor(F.col(c) / size) + plus
    around = F.array(*[F.struct(cells("x", i).alias("cx"), cells("y", j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = targets.withColumn("_c", F.explode(around)).select(*[F.col(c).alias(a + c) for c in ("id", "x", "y")], "_l", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    right = others.withColumn("_l", F.explode(F.array(*map(F.lit, levels)))).select(*[F.col(c).alias(b + c) for c in ("id", "x", "y")], "_l", cells("x", 0).alias("_cx"), cells("y", 0).alias("_cy"))
    met = left.join(right, ["_l", "_cx", "_cy"])
    return met.where(squared_distance(a, b) <= size * size).drop("_l", "_cx", "_cy")


def _nearest(targets: DataFrame, others: DataFrame, k: int, a: str, b: str, radius: float | None, rounds: int) -> DataFrame:
    box = others.agg(F.count("*").alias("n"), *[g(c).alias(f"{n}{c}") for c in ("x", "y") for n, g in (("lo", F.min), ("hi", F.max))]).first()
    n = box["n"]
    if not n:
        return _ranked(radius_join(targets, others, 1.0, a, b), k, a, b)
    wide, high = box["hix"] - box["lox"], box["hiy"] - box["loy"]
    cell, todo = radius, targets.withColumn("_l", F.lit(0))
    if radius is None:
        cell = max(1.0, (4.0 * k * max(wide, 1.0) * max(high, 1.0) / (n * 3.14159)) ** 0.5)
        most = others.groupBy(_cell("x", cell), _cell("y", cell)).count().agg(F.max("count")).first()[0]
        if most > CROWDED * k:
            finer = min(20, math.ceil(math.log(most / k, 4)))  # down to where the densest square holds k, if it is even
            cell /= 2**finer
            todo = saved(_levels(targets, others, min(k, n), cell, finer + COARSER, box))
    out = None
    for _ in range(rounds):
        found = saved(_ranked(_levels_join(todo, others, cell, a, b), k, a, b))
        full = found.groupBy(f"{a}id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min(k, n))
        done = found.join(full.select(f"{a}id"), f"{a}id", "left_semi")
        out = done if out is None else out.unionByName(done)
        todo = saved(todo.join(full.select(F.col(f"{a}id").alias("id")), "id", "left_anti").withColumn("_l", F.col("_l") + 2))
        if todo.isEmpty():
            break
    else:  # what was found for those that are still not full
        out = out.unionByName(found.join(todo.select(F.col("id").alias(f"{a}id")), f"{a}id", "left_semi"))
    return out


def with_fallback(pairs: DataFrame, targets: DataFrame, others: DataFrame, least: int = 10, a: str = "t_", b: str = "n_") -> DataFrame:
    """pairs, but the `least` nearest others at any distance for targets with fewer pairs than that."""
    counts = pairs.groupBy(F.col(f"{a}id").alias("id")).agg(F.count("*").alias("_n"))
    few = targets.join(counts.where(F.col("_n") >= least).select("id"), "id", "left_anti").persist()
    # Counted over the partitioning that a later aggregation by target needs anyway.
    kept = pairs.withColumn("_n", F.count("*").over(Window.partitionBy(f"{a}id"))).where(F.col("_n") >= least).drop("_n")
    if few.isEmpty():
        return kept
    return kept.unionByName(knn_join(few, others, least, a, b).drop("knn_rank").select(*kept.columns))


def strict_cap(pairs: DataFrame, kilometres: float, a: str = "t_", b: str = "n_") -> DataFrame:
    """Drops pairs beyond the cap; after the k nearest were taken, so fewer than k may stay."""
    return pairs.where(squared_distance(a, b) <= (1000.0 * kilometres) ** 2)


def interval_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, unit: float = 1.0) -> DataFrame:
    """Rows of points and intervals with low <= point < high. The cells of `unit` that an interval touches are at most two
    nodes a level of the tree of powers of two, so its rows grow with the logarithm of its width; points are repeated once a
    level that occurs. Null bounds and empty intervals hold nothing."""
    cells = intervals.where(F.col(low) < F.col(high)).withColumns({"_a": whole_cell(F.col(low), unit), "_b": whole_cell(F.col(high), unit)})
    nodes = cells.withColumn("_n", F.explode(F.expr(_COVER))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_a", "_b", "_n")
    levels = sorted(r[0] for r in nodes.select("_level").distinct().collect())  # 62 at most
    up = F.expr(f"explode(transform(array({', '.join(map(str, levels)) or 'CAST(NULL AS INT)'}), k -> named_struct('level', k, 'node', shiftright(_a, k))))")
    above = points.where(F.col(point).isNotNull()).withColumn("_a", whole_cell(F.col(point), unit)).withColumn("_n", up).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_a", "_n")
    return above.join(nodes, ["_level", "_node"]).drop("_level", "_node").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))


def interval_sums(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, value: str | None = None) -> DataFrame:
    """intervals that hold any points (low <= point < high) with n, their number, and with `value` also total, its sum: what lies
    before high less what lies before low, so the rows are those of both tables and not pairs. Sums are differences of running
    sums, exact as long as these are, as of whole numbers below 2^53. Null bounds and empty intervals hold nothing."""
    held = intervals.where(F.col(low) < F.col(high)).withColumn("_key", F.monotonically_increasing_id())
    held = saved(held)
    sums = points.where(F.col(point).isNotNull()).groupBy(F.col(point).cast("double").alias("_v")).agg(F.count("*").alias("_n"), F.sum(F.col(value).cast("double") if value else F.lit(0.0)).alias("_s"))
    nothing = F.lit(None).cast("long")
    rows = sums.select("_v", F.lit(1).alias("_kind"), nothing.alias("_key"), F.lit(0).alias("_sign"), "_n", F.coalesce("_s", F.lit(0.0)).alias("_s"))
    for c, sign in ((low, -1), (high, 1)):  # a bound comes before the points at it, which are not below it
        rows = rows.unionByName(held.select(F.col(c).cast("double").alias("_v"), F.lit(0).alias("_kind"), "_key", F.lit(sign).alias("_sign"), F.lit(0).cast("long").alias("_n"), F.lit(0.0).alias("_s")))
    ranged = saved(rows.repartitionByRange("_v", "_kind").withColumn("_p", F.spark_partition_id()))
    # One row a partition: what lies in those before.
    parts = ranged.groupBy("_p").agg(F.sum("_n").alias("_pn"), F.sum("_s").alias("_ps"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_p", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_pn", "_ps")])
    inside = Window.partitionBy("_p").orderBy("_v", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({"_n": F.sum("_n").over(inside), "_s": F.sum("_s").over(inside)}).where(F.col("_key").isNotNull()).join(F.broadcast(parts), "_p")
    found = running.groupBy("_key").agg(F.sum(F.col("_sign") * (F.col("_n") + F.col("_pn"))).alias("n"), F.sum(F.col("_sign") * (F.col("_s") + F.col("_ps"))).alias("total")).where("n > 0")
    out = held.join(found, "_key").drop("_key")
    return out if value else out.drop("total")


@dataclass(frozen=True)
class IntervalIndex:
    """Intervals [low, high) by a unique key. An index is a value: add and delete give new ones, whose plans are joins."""

    intervals: DataFrame
    key: str
    low: str
    high: str
    unit: float = 1.0

    def __post_init__(self) -> None:
        twice = self.intervals.groupBy(self.key).count().where((F.col("count") > 1) | F.col(self.key).isNull()).count()
        if twice:
            raise ValueError(f"{twice} keys are null or not unique")

    def _held(self, keys: DataFrame, how: str) -> DataFrame:
        return keys.join(self.intervals.select(self.key), self.key, how)

    def add(self, more: DataFrame) -> IntervalIndex:
        """With further intervals; keys that the index or `more` already holds are an error."""
        there = self._held(more.select(self.key), "left_semi").count()
        if there:
            raise ValueError(f"{there} keys are in the index already")
        return replace(self, intervals=self.intervals.unionByName(more.select(*self.intervals.columns)))

    def delete(self, keys: DataFrame) -> IntervalIndex:
        """Without the intervals of these keys; keys that the index does not hold are an error."""
        missing = self._held(keys.select(self.key).distinct(), "left_anti").count()
        if missing:
            raise ValueError(f"{missing} keys are not in the index")
        return replace(self, intervals=self.intervals.join(keys.select(self.key), self.key, "left_anti"))

    def stab(self, points: DataFrame, point: str) -> DataFrame:
        """points with the intervals that hold them, a row each."""
        return interval_join(points, self.intervals, point, self.low, self.high, self.unit)

    def counts(self, points: DataFrame, point: str) -> DataFrame:
        """The intervals that hold any points, with their number n."""
        return interval_sums(points, self.intervals, point, self.low, self.high)


def epsilon_edges(listings: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of different listings within epsilon, each once (a_id < b_id). A listing meets those of its own cell and of four of
    the eight around it, from which the other four are met; the ends are named by their ids afterwards."""
    size = max(float(epsilon), 1e-9)
    here = listings.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    half = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = F.array(*[F.struct((_cell("a_x", size) + i).alias("cx"), (_cell("a_y", size) + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i, j in half])
    left = prefixed(here, "a_").withColumn("_c", F.explode(near)).select("*", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"), F.col("_c.own").alias("_own")).drop("_c")
    right = prefixed(here, "b_").withColumns({"_cx": _cell("b_x", size), "_cy": _cell("b_y", size)})
    met = left.join(right, ["_cx", "_cy"]).where((squared_distance("a_", "b_") <= size * size) & (F.col("a_id") != F.col("b_id")) & (~F.col("_own") | (F.col("a_id") < F.col("b_id"))))
    turned = F.col("a_id") > F.col("b_id")
    ends = [F.when(turned, F.col(f"{q}{c}")).otherwise(F.col(f"{p}{c}")).alias(f"{p}{c}") for p, q in (("a_", "b_"), ("b_", "a_")) for c in listings.columns]
    return met.select(*ends)


def join_known_prices(rows: DataFrame, prices: DataFrame, name: str = "known_price", price: str = "sqm") -> DataFrame:
    """rows with the price that a table (id, price) knows of them, null for those it hasn't; `in_prices` tells which."""
    known = prices.select("id", F.col(price).alias(name), F.lit(True).alias("in_prices"))
    return rows.join(known, "id", "left").withColumn("in_prices", F.coalesce("in_prices", F.lit(False)))
