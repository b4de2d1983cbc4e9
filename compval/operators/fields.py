"""Sums over all others within a radius of each target, where the pairs are too many to be rows.

Others lie in square tiles; each target meets the tiles in reach, and what the tiles give is added up. In a task both sides
of a tile are numpy columns in small cells: pairs of cells are beyond the radius, wholly within it, or tested one by one.
Every pair is weighed, none is a row. Tiles with many rows are dealt in pieces, so a crowded place is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from compval.durable import saved
from compval.functions import dissimilarity as D
from compval.operators.spatial import knn_join, prefixed, radius_join, whole_cell

#: Rows of a side that a task holds at once, roughly.
PIECE = 1 << 18
#: Pairs that are weighed at once; what they need stays in a core's cache.
BLOCK = 1 << 16

#: sums(squared distances, within or None for all, own pairs or None, columns of targets, columns of others): rows of sums.
Sums = Callable[[np.ndarray, np.ndarray | None, tuple | None, list[np.ndarray], list[np.ndarray]], np.ndarray]


def _cells(x: np.ndarray, y: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the points by cells of some `rows` points, where each cell starts, and the cells' bounds."""
    n = max(1, min(64, int((len(x) / rows) ** 0.5)))
    place = lambda v: np.minimum(((v - v.min()) * (n / max(np.ptp(v), 1e-300))).astype(np.int64), n - 1)
    cell = place(x) * n + place(y)
    order = np.argsort(cell, kind="stable")
    start = np.flatnonzero(np.diff(cell[order], prepend=-1))
    bounds = [g.reduceat(v[order], start) for v in (x, y) for g in (np.minimum, np.maximum)]
    return order, start, np.array(bounds)


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each number of low..high - 1 its row and itself."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def _mates(targets: pa.Table, others: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Others in order of their ids, and where those of each target's own id begin and end there."""
    known = others.column("id").combine_chunks().dictionary_encode()
    code = pc.index_in(targets.column("t_id"), value_set=known.dictionary).combine_chunks().fill_null(-1).to_numpy()
    theirs = known.indices.fill_null(-2).to_numpy()
    by = np.argsort(theirs, kind="stable")
    return by, np.searchsorted(theirs[by], code, "left"), np.searchsorted(theirs[by], code, "right")


def _added(targets: list[np.ndarray], others: list[np.ndarray], mates: tuple, limit: float, sums: Sums, width: int) -> np.ndarray:
    """Counts and sums of each target. Columns are x, y and what the sums need."""
    out = np.zeros((len(targets[0]), 1 + width))
    order, start, (tx0, tx1, ty0, ty1) = _cells(*targets[:2], 16)
    place, first, (ox0, ox1, oy0, oy1) = _cells(*others[:2], 64)
    others, ends, size = [c[place] for c in others], np.append(start, len(order)), np.diff(np.append(first, len(place)))
    back, (by, low, high) = np.argsort(place), mates
    for i in range(len(start)):
        rows = order[ends[i] : ends[i + 1]]
        gap = [np.maximum(0, np.maximum(a0 - b1[i], b0[i] - a1)) for a0, a1, b0, b1 in ((ox0, ox1, tx0, tx1), (oy0, oy1, ty0, ty1))]
        far = [np.maximum(a1 - b0[i], b1[i] - a0) for a0, a1, b0, b1 in ((ox0, ox1, tx0, tx1), (oy0, oy1, ty0, ty1))]
        # Bounds by a margin, as the test by pairs rounds otherwise.
        within = (far[0] ** 2 + far[1] ** 2) * (1 + 1e-12) <= limit
        mixed = ~within & ((gap[0] ** 2 + gap[1] ** 2) * (1 - 1e-12) <= limit)
        for some, tested in ((within, False), (mixed, True)):
            if not some.any():
                continue
            chosen = np.flatnonzero(np.repeat(some, size))
            near = [c[chosen] for c in others]
            step = max(1, BLOCK // len(chosen))
            for j in range(0, len(rows), step):
                part = rows[j : j + step]
                here = [c[part][:, None] for c in targets]
                d2, dy = here[0] - near[0], here[1] - near[1]
                d2 *= d2
                dy *= dy
                d2 += dy
                inside = d2 <= limit if tested else None
                own, (at, theirs) = None, _spans(low[part], high[part])
                if len(at):
                    theirs = back[by[theirs]]
                    k = np.minimum(np.searchsorted(chosen, theirs), len(chosen) - 1)
                    hit = chosen[k] == theirs
                    own = (at[hit], k[hit])
                out[part, 0] += len(chosen) if inside is None else inside.sum(axis=1)
                out[part, 1:] += sums(d2, inside, own, here[2:], near[2:])
    return out


def _plain(targets: list[np.ndarray], others: list[np.ndarray], mates: tuple, limit: float) -> np.ndarray:
    """Counts, then the sums of the others' columns after x and y, and their number, without those of a target's own id. Cells
    that are wholly within count by their totals."""
    out = np.zeros((len(targets[0]), len(others)))
    order, start, (tx0, tx1, ty0, ty1) = _cells(*targets[:2], 16)
    place, first, (ox0, ox1, oy0, oy1) = _cells(*others[:2], 64)
    sorted_ = [c[place] for c in others]
    values = np.stack([*sorted_[2:], np.ones(len(place))], axis=1)
    totals, ends, size = np.add.reduceat(values, first), np.append(start, len(order)), np.diff(np.append(first, len(place)))
    for i in range(len(start)):
        rows = order[ends[i] : ends[i + 1]]
        gap = [np.maximum(0, np.maximum(a0 - b1[i], b0[i] - a1)) for a0, a1, b0, b1 in ((ox0, ox1, tx0, tx1), (oy0, oy1, ty0, ty1))]
        far = [np.maximum(a1 - b0[i], b1[i] - a0) for a0, a1, b0, b1 in ((ox0, ox1, tx0, tx1), (oy0, oy1, ty0, ty1))]
        within_ = (far[0] ** 2 + far[1] ** 2) * (1 + 1e-12) <= limit
        mixed = ~within_ & ((gap[0] ** 2 + gap[1] ** 2) * (1 - 1e-12) <= limit)
        out[rows, 1:] += totals[within_].sum(axis=0)
        chosen = np.flatnonzero(np.repeat(mixed, size))
        step = max(1, BLOCK // max(1, len(chosen)))
        for j in range(0, len(rows) if len(chosen) else 0, step):
            part = rows[j : j + step]
            dx, dy = (targets[c][part][:, None] - sorted_[c][chosen] for c in (0, 1))
            dx *= dx
            dy *= dy
            dx += dy
            out[part, 1:] += (dx <= limit) @ values[chosen]
    out[:, 0] = out[:, -1]
    by, low, high = mates
    at, theirs = _spans(low, high)
    theirs = by[theirs]
    inside = (targets[0][at] - others[0][theirs]) ** 2 + (targets[1][at] - others[1][theirs]) ** 2 <= limit
    own = np.stack([*(c[theirs] for c in others[2:]), np.ones(len(theirs))], axis=1)
    np.subtract.at(out, (at[inside][:, None], np.arange(1, out.shape[1])[None, :]), own[inside])
    return out


def radius_sums(targets: DataFrame, others: DataFrame, radius: float, sums: Sums | None, width: int, t: list[str] = [], o: list[str] = []) -> DataFrame:  # noqa: B006
    """id, found (how many others lie within the radius, inclusive) and s (`width` sums) of each target with any in reach; t and
    o name the number columns that the sums need. Rows without coordinates have no neighbours; nulls are NaN. Without `sums`
    they are the plain sums of o, then the number, without others of the target's own id."""
    spark, limit, side = targets.sparkSession, float(radius) * radius, max(float(radius), 1e-9) / 2
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    here = lambda df, cols: df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", *cols)])
    tile = lambda c, i=0: F.floor(F.col(c) / side) + i
    steps = range(-2, 3)
    around = F.array(*[F.struct(tile("x", i).alias("x"), tile("y", j).alias("y")) for i in steps for j in steps])
    left = here(targets, t).withColumn("_t", F.explode(around)).withColumns({"_x": F.col("_t.x"), "_y": F.col("_t.y")}).drop("_t")
    right = here(others, o).withColumns({"_x": tile("x"), "_y": tile("y")})
    # Crowded tiles: pieces of one side meet pieces of the other.
    crowd = right.groupBy("_x", "_y").count().where(F.col("count") > PIECE)
    crowd = crowd.select("_x", "_y", F.ceil(F.col("count") / PIECE).cast("int").alias("_m"))
    dealt = lambda df, a, b: df.join(F.broadcast(crowd), ["_x", "_y"], "left").withColumns({a: F.expr("pmod(hash(id), coalesce(_m, 1))"), b: F.explode(F.expr("sequence(0, coalesce(_m, 1) - 1)"))}).drop("_m")
    if not crowd.isEmpty():
        left, right = dealt(left, "_i", "_j"), dealt(right, "_j", "_i")
    else:
        left, right = (df.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for df in (left, right))
    keys = ["_x", "_y", "_i", "_j"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            a, rows = a.slice(0, 0), np.empty((0, 1 + width))
        else:
            numbers = lambda df, cols: [df.column(c).to_numpy().astype(float) for c in cols]
            both = numbers(a, ["t_x", "t_y", *(f"t_{c}" for c in t)]), numbers(b, ["x", "y", *o])
            rows = _added(*both, _mates(a, b), limit, sums, width) if sums else _plain(*both, _mates(a, b), limit)
        some = rows[:, 0] > 0
        rows = rows[some]
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows[:, 1:].ravel()))
        return pa.table({"id": a.column("t_id").filter(pa.array(some, pa.bool_())), "found": pa.array(rows[:, 0].astype(np.int64)), "s": cells})

    kind = dict(targets.dtypes)["id"]
    # Few bytes are work for every core, so the number of partitions is given.
    left = prefixed(left, "t_").repartition(parts, *[f"t_{k}" for k in keys])
    right = right.repartition(parts, *keys)
    found = left.groupBy(*[f"t_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInArrow(run, f"id {kind}, found long, s array<double>")
    if not width:
        return found.groupBy("id").agg(F.sum("found").alias("found"))
    added = found.groupBy("id").agg(F.sum("found").alias("found"), *[F.sum(F.col("s")[i]).alias(f"_s{i}") for i in range(width)])
    return added.select("id", "found", F.array(*[F.col(f"_s{i}") for i in range(width)]).alias("s"))


def distance_sums(targets: DataFrame, others: DataFrame, radius: float, power: float, value: str) -> DataFrame:
    """radius_sums of weight x value and of weights, by the inverse of the distance to a power as D.distance and D.weight_of
    have it: at least 10 units, weights within [1e-10, 1e9], a target's own 0."""

    def sums(d2, inside, own, _, others):
        np.maximum(d2, D.MIN_SQUARED_DISTANCE, out=d2)
        w = np.reciprocal(d2, out=d2) if power == 2 else d2 ** (-power / 2)
        np.clip(w, 1e-10, 1e9, out=w)
        if inside is not None:
            w *= inside
        if own is not None:
            w[own] = 0.0
        return w @ np.stack([others[0], np.ones(len(others[0]))], axis=1)

    return radius_sums(targets, others, radius, sums, 2, o=[value])


def spread_sums(rows: DataFrame, radius: float, value: str) -> DataFrame:
    """radius_sums over all other rows: of the squared difference of values by inverse squared distance, and of weights. Pairs
    without a difference count in the weights only."""

    def sums(d2, inside, own, here, near):
        np.maximum(d2, D.MIN_SQUARED_DISTANCE, out=d2)
        w = np.reciprocal(d2, out=d2)
        if inside is not None:
            w *= inside
        if own is not None:
            w[own] = 0.0
        apart = here[0] - near[0]
        apart *= apart
        np.nan_to_num(apart, copy=False)
        return np.stack([np.einsum("ij,ij->i", apart, w), w.sum(axis=1)], axis=1)

    return radius_sums(rows, rows, radius, sums, 2, t=[value], o=[value])


#: What a task does with a piece's targets and others: columns of its result, a row for each target.
Work = Callable[[dict[str, np.ndarray], dict[str, np.ndarray], pa.Table, pa.Table], dict[str, pa.Array]]


def gathered(targets: DataFrame, others: DataFrame, radius: float, work: Work, out: str, t: list[str] = [], o: list[str] = [], whole: bool = False, wide: float = 1.0) -> DataFrame:  # noqa: B006
    """work's columns (`out`) and t_id, for results that are wide or need a target's others together: here others are repeated
    and targets are not. A target has a row, or one for each piece where those around its tile are more than PIECE. Pieces are
    dealt by id, or as column _i of others says, which targets then have too. With `whole` others are never dealt: a task then
    holds all those around a tile. Tiles are as wide as the radius, or `wide` times that, 2 at least; others are then repeated
    only where the radius reaches beyond their tile."""
    side = max(float(radius), 1e-9) * wide
    dealt = "_i" in others.columns
    here = lambda df, cols: df.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select("id", *(["_i"] if dealt else []), *[F.col(c).cast("double").alias(c) for c in ("x", "y", *cols)])
    tile = lambda c, i=0: F.floor(F.col(c) / side) + i
    around = F.array(*[F.struct(tile("x", i).alias("x"), tile("y", j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    if wide > 1:
        reached = lambda c, i: F.floor((F.col(c) + i * float(radius)) / side)
        around = F.array_distinct(F.array(*[F.struct(reached("x", i).alias("x"), reached("y", j).alias("y")) for i in (-1, 1) for j in (-1, 1)]))
    left = here(targets, t).withColumns({"_x": tile("x"), "_y": tile("y")})
    right = here(others, o).withColumn("_t", F.explode(around)).withColumns({"_x": F.col("_t.x"), "_y": F.col("_t.y")}).drop("_t")
    keys = ["_x", "_y", "_i", "_j"]
    crowd = lambda df, c: df.groupBy("_x", "_y").count().where(F.col("count") > PIECE).select("_x", "_y", F.ceil(F.col("count") / PIECE).cast("int").alias(c))
    parts = crowd(right, "_m").join(crowd(left, "_k"), ["_x", "_y"], "full")
    if parts.isEmpty():
        left, right = (df.withColumn("_j", F.lit(0)) if dealt else df.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for df in (left, right))
    else:
        left, right = (df.join(F.broadcast(parts), ["_x", "_y"], "left") for df in (left, right))
        left, right = left.withColumn("_j", F.expr("pmod(hash(id), coalesce(_k, 1))")), right.withColumn("_j", F.explode(F.expr("sequence(0, coalesce(_k, 1) - 1)")))
        if whole:
            left, right = (df.withColumn("_i", F.lit(0)) for df in (left, right))
        elif not dealt:
            left, right = left.withColumn("_i", F.explode(F.expr("sequence(0, coalesce(_m, 1) - 1)"))), right.withColumn("_i", F.expr("pmod(hash(id), coalesce(_m, 1))"))
        left, right = (df.drop("_m", "_k") for df in (left, right))
    names = ["x", "y", *t], ["x", "y", *o]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not b.num_rows:
            a = a.slice(0, 0)
        numbers = lambda df, prefix, cols: {c: df.column(prefix + c).to_numpy().astype(float) for c in cols}
        found = work(numbers(a, "t_", names[0]), numbers(b, "", names[1]), a, b)
        return pa.table({"t_id": a.column("t_id"), "_i": a.column("t__i"), **found})

    shuffled = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = prefixed(left, "t_").repartition(shuffled, *[f"t_{k}" for k in keys])
    pairs = left.groupBy(*[f"t_{k}" for k in keys]).cogroup(right.repartition(shuffled, *keys).groupBy(*keys))
    return pairs.applyInArrow(run, f"t_id {dict(targets.dtypes)['id']}, _i int, {out}")


#: Points of others in a square as wide as the strips of a disc: more mean fewer strips and more points that are tested.
STRIP = 20
#: Points near the edge of discs that are tested at once.
EDGE = 1 << 21


def _sliced(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `most` at most, or single rows."""
    upto, i = np.cumsum(size), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _discs(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, values: np.ndarray, radius: float) -> np.ndarray:
    """For each place (x, y) the sums of values (a row for each other) within the radius. Others lie in strips by y, in order of x:
    what of a strip is wholly within is a difference of running sums, and only what is near the edge is tested one by one."""
    out, limit = np.zeros((len(x), values.shape[1])), float(radius) * radius
    area = max(np.ptp(ox), radius) * max(np.ptp(oy), radius)
    high = min(float(radius), max((STRIP * area / len(ox)) ** 0.5, radius / 512))
    strip = np.floor((oy - oy.min()) / high).astype(np.int64)
    place = np.lexsort((ox, strip))
    ox, oy, values = ox[place], oy[place], values[place]
    start = np.flatnonzero(np.diff(strip[place], prepend=-1))
    ends = np.append(start[1:], len(ox))
    low, top = np.minimum.reduceat(oy, start), np.maximum.reduceat(oy, start)
    running = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    order = np.argsort(y, kind="stable")
    ys = y[order]
    for k in range(len(start)):
        # Bounds by a margin, as the test by pairs rounds otherwise.
        reach = radius * (1 + 1e-9)
        rows = order[np.searchsorted(ys, low[k] - reach, "left") : np.searchsorted(ys, top[k] + reach, "right")]
        if not len(rows):
            continue
        tx, ty, xs = x[rows], y[rows], ox[start[k] : ends[k]]
        gap, far = np.maximum(0, np.maximum(low[k] - ty, ty - top[k])), np.maximum(top[k] - ty, ty - low[k])
        wide = np.sqrt(np.maximum(0.0, limit * (1 + 1e-9) - gap * gap)) * (1 + 1e-9) + 1e-9 * np.abs(tx)
        sure = np.sqrt(np.maximum(0.0, limit * (1 - 1e-9) - far * far)) * (1 - 1e-9) - 1e-9 * np.abs(tx)
        first, last = np.searchsorted(xs, tx - wide, "left"), np.searchsorted(xs, tx + wide, "right")
        a, b = np.searchsorted(xs, tx - sure, "left"), np.searchsorted(xs, tx + sure, "right")
        none = sure <= 0
        a[none] = b[none] = first[none]
        first, last, a, b = (v + start[k] for v in (first, last, a, b))
        out[rows] += running[b] - running[a]
        for lo, hi in ((first, a), (b, last)):
            for i, j in _sliced(hi - lo, EDGE):
                at, n = _spans(lo[i:j], hi[i:j])
                hit = (tx[i:j][at] - ox[n]) ** 2 + (ty[i:j][at] - oy[n]) ** 2 <= limit
                at, n = at[hit], n[hit]
                for c in range(values.shape[1]):
                    out[rows[i:j], c] += np.bincount(at, values[n, c], j - i)
    return out


def disc_sums(targets: DataFrame, others: DataFrame, radius: float, value: list[str] = [], squares: bool = False, exclude_self: bool = False, wide: float = 2.0) -> DataFrame:  # noqa: B006
    """id, found and s of each target with any others within the radius, inclusive: the sums of `value` over them and, with
    `squares`, that of their squared distances. Neither are pairs rows, nor are most of them gone through: what a disc
    holds costs as much as its edge. Sums are differences of running sums, exact as long as these are, as of whole
    numbers below 2^53. With exclude_self others of a target's own id do not count, nor does what has none."""
    width = len(value) + (1 if squares else 0)
    if exclude_self:
        targets, others = (df.where(F.col("id").isNotNull()) for df in (targets, others))
    else:
        others = others.withColumn("id", F.xxhash64("id"))

    def work(a, b, targets, others):
        found = np.zeros((len(a["x"]), 1 + width))
        if len(a["x"]) and len(b["x"]):
            # Whole numbers about the middle keep the sums of squares small.
            cx, cy = (np.rint((b[c].min() + b[c].max()) / 2) for c in ("x", "y"))
            columns = [np.ones(len(b["x"])), *[b[c] for c in value]]
            x, y, ox, oy = a["x"] - cx, a["y"] - cy, b["x"] - cx, b["y"] - cy
            if squares:
                columns += [ox * ox + oy * oy, ox, oy]
            sums = _discs(a["x"], a["y"], b["x"], b["y"], np.stack(columns, axis=1), radius)
            if squares:
                sums[:, -3] += sums[:, 0] * (x * x + y * y) - 2 * (x * sums[:, -2] + y * sums[:, -1])
            found = sums[:, : 1 + width]
            if exclude_self:
                by, low, high = _mates(targets, others)
                at, theirs = _spans(low, high)
                theirs = by[theirs]
                d2 = (a["x"][at] - b["x"][theirs]) ** 2 + (a["y"][at] - b["y"][theirs]) ** 2
                hit = d2 <= float(radius) * radius
                own = np.stack([np.ones(len(at)), *[b[c][theirs] for c in value], *([d2] if squares else [])], axis=1)
                np.subtract.at(found, at[hit], own[hit])
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(found[:, 1:].ravel()))
        return {"found": pa.array(np.rint(found[:, 0]).astype(np.int64)), "s": cells}

    met = gathered(targets, others, radius, work, "found long, s array<double>", o=value, wide=wide).where("found > 0")
    added = met.groupBy(F.col("t_id").alias("id")).agg(F.sum("found").alias("found"), *[F.sum(F.col("s")[i]).alias(f"_s{i}") for i in range(width)])
    return added.select("id", "found", F.array(*[F.col(f"_s{i}") for i in range(width)]).alias("s") if width else F.expr("CAST(array() AS array<double>)").alias("s"))


def within(a: dict, b: dict, mates: tuple, limit: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each target with its others within reach, their squared distances, and which of them have its own id."""
    by, low, high = mates
    for i in range(len(a["x"])):
        d2, dy = b["x"] - a["x"][i], b["y"] - a["y"][i]
        d2 *= d2
        dy *= dy
        d2 += dy
        at = np.flatnonzero(d2 <= limit)
        yield i, at, d2[at], np.isin(at, by[low[i] : high[i]]) if high[i] > low[i] else np.zeros(len(at), bool)


#: Parts along a side of a tile whose targets go through only what they reach.
FINER = 8


def _local(a: dict, b: dict, radius: float, day: str, days: float, reference: float, value: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each target with the values of others within the radius that are at most so many days from its own day, and of those
    that are from the reference's."""
    limit, reach = float(radius) * radius, radius * (1 + 1e-9)
    order = np.argsort(b[day], kind="stable")
    ox, oy, od, ov = (b[c][order] for c in ("x", "y", day, value))
    part = lambda v: np.minimum(((v - v.min()) * (FINER / max(np.ptp(v), 1e-300))).astype(np.int64), FINER - 1)
    cell = part(a["x"]) * FINER + part(a["y"])
    for c in np.unique(cell):
        rows = np.flatnonzero(cell == c)
        x, y = a["x"][rows], a["y"][rows]
        kept = np.flatnonzero((ox >= x.min() - reach) & (ox <= x.max() + reach) & (oy >= y.min() - reach) & (oy <= y.max() + reach))
        px, py, pd, pv = ox[kept], oy[kept], od[kept], ov[kept]
        # A target without a day is near none: NaN comes last, so its run is empty.
        low, high = np.searchsorted(pd, a[day][rows] - days, "left"), np.searchsorted(pd, a[day][rows] + days, "right")
        first, last = np.searchsorted(pd, reference - days, "left"), np.searchsorted(pd, reference + days, "right")
        ex, ey, ev = px[first:last], py[first:last], pv[first:last]
        for i, tx, ty, lo, hi in zip(rows, x, y, low, high):
            yield i, pv[lo:hi][(tx - px[lo:hi]) ** 2 + (ty - py[lo:hi]) ** 2 <= limit], ev[(tx - ex) ** 2 + (ty - ey) ** 2 <= limit]


def local_sums(targets: DataFrame, others: DataFrame, radius: float, day: str, days: float, reference: float, value: str) -> DataFrame:
    """id, {start,end}_{n,sum} of each target with any others in reach: number and sum of the values of those within the radius
    that are at most so many days from its own day (start), or from the reference's (end). No pair is a row."""
    names = ["start_n", "start_sum", "end_n", "end_sum"]

    def work(a, b, *_):
        out = np.zeros((4, len(a["x"])))
        if len(a["x"]) and len(b["x"]):
            for i, s, e in _local(a, b, radius, day, days, reference, value):
                out[:, i] = len(s), s.sum(), len(e), e.sum()
        return dict(zip(names, map(pa.array, out)))

    met = gathered(targets, others, radius, work, ", ".join(f"{n} double" for n in names), t=[day], o=[day, value], wide=2.0)
    return met.where("start_n + end_n > 0").groupBy(F.col("t_id").alias("id")).agg(*[F.sum(n).alias(n) for n in names])


def crowded(others: DataFrame, radius: float) -> bool:
    """Whether those around a tile of twice the radius may be more than a task should hold."""
    tile = lambda c: F.floor(F.col(c) / max(float(radius), 1e-9))
    return 25 * (others.groupBy(tile("x"), tile("y")).count().agg(F.max("count")).first()[0] or 0) > 16 * PIECE


def local_places(targets: DataFrame, others: DataFrame, radius: float, day: str, days: float, reference: float, value: str, rank: bool) -> DataFrame:
    """id, _start and _end of each target with any at its start and at its end (as local_sums() has them): the upper medians of
    their values. With `rank` _end is the one that has the place among the values at the end that the target's value
    has among those at the start. A task holds all others around a tile, of which there may not be too many."""

    def work(a, b, *_):
        out = np.full((2, len(a["x"])), np.nan)
        some = np.zeros(len(a["x"]), bool)
        if len(a["x"]) and len(b["x"]):
            for i, s, e in _local(a, b, radius, day, days, reference, value):
                if not (len(s) and len(e)):
                    continue
                some[i] = True
                if rank:
                    at = int((s < a[value][i]).sum()) * (len(e) - 1) // len(s)
                else:
                    at, half = len(e) // 2, len(s) // 2
                    out[0, i] = np.partition(s, half)[half]
                out[1, i] = np.partition(e, at)[at]
        return {"_start": pa.array(out[0]), "_end": pa.array(out[1]), "some": pa.array(some)}

    met = gathered(targets, others, radius, work, "_start double, _end double, some boolean", t=[day, value], o=[day, value], whole=True, wide=2.0)
    return met.where("some").select(F.col("t_id").alias("id"), "_start", "_end")


def _medians(radius: float, power: float, value: str, sums: bool) -> Work:
    limit = float(radius) * radius

    def work(a, b, targets, others):
        order = pc.sort_indices(others.select([value, "id"]), sort_keys=[(value, "ascending"), ("id", "ascending")]).to_numpy()
        others, b = others.take(pa.array(order)), {c: v[order] for c, v in b.items()}
        n = len(a["x"])
        found, total, median = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.nan)
        for i, at, d2, own in within(a, b, _mates(targets, others), limit):
            np.maximum(d2, D.MIN_SQUARED_DISTANCE, out=d2)
            w = 1 / np.clip(d2 if power == 2 else d2 ** (power / 2), 1e-9, 1e10)
            w[own] = 0.0
            found[i] = len(at)
            if len(at):
                grown = np.cumsum(w)
                total[i] = grown[-1]
                if not sums:
                    # A sum that misses its goal by rounding alone ends at the last value.
                    half, before = (a["_half"][i], a["_before"][i]) if "_half" in a else (grown[-1] / 2, 0.0)
                    median[i] = b[value][at[min(np.searchsorted(before + grown, half), len(at) - 1)]]
        return {"found": pa.array(found), "total": pa.array(total), "median": pa.array(median)}

    return work


def distance_medians(targets: DataFrame, others: DataFrame, radius: float, power: float, value: str) -> DataFrame:
    """id, found and median of each target with any others in reach: the least value up to which, in order of values and ids,
    the weights of distance_sums() reach half of their sum. Others around a tile that are too many for a task are dealt by
    ranges of the value; a first pass then tells in which range a target's median is."""
    out = "found long, total double, median double"
    tile = lambda c: F.floor(F.col(c) / max(float(radius), 1e-9))
    most = others.groupBy(tile("x"), tile("y")).count().agg(F.max("count")).first()[0] or 0
    if 9 * most <= PIECE:
        found = gathered(targets, others, radius, _medians(radius, power, value, False), out, o=[value]).where("found > 0")
        return found.groupBy(F.col("t_id").alias("id")).agg(F.sum("found").alias("found"), F.max("median").alias("median"))
    m = -(-9 * most // PIECE)
    bounds = sorted(set(others.approxQuantile(value, [i / m for i in range(1, m)], 0.1 / m)))
    ranged = others.withColumn("_i", sum((F.when(F.col(value) > b, 1).otherwise(0) for b in bounds), F.lit(0)))
    each = targets.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    sums = saved(gathered(each, ranged, radius, _medians(radius, power, value, True), out, o=[value]).where("found > 0"))
    upto = Window.partitionBy("t_id").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({"_upto": F.sum("total").over(upto), "_all": F.sum("total").over(Window.partitionBy("t_id")), "n": F.sum("found").over(Window.partitionBy("t_id"))})
    inside = sums.where(F.col("_upto") >= F.col("_all") / 2).groupBy("t_id").agg(F.min(F.struct("_i", "_upto", "total", "_all", "n")).alias("at"))
    inside = saved(inside.select(F.col("t_id").alias("id"), "at._i", (F.col("at._upto") - F.col("at.total")).alias("_before"), (F.col("at._all") / 2).alias("_half"), "at.n"))
    last = gathered(targets.join(inside, "id"), ranged, radius, _medians(radius, power, value, False), out, t=["_before", "_half"], o=[value])
    return last.where("found > 0").select(F.col("t_id").alias("id"), "median").join(inside.select("id", F.col("n").alias("found")), "id").select("id", "found", "median")


def grid_sums(places: DataFrame, radius: float, low: float, step: float, steps: int, value: str) -> DataFrame:
    """id, found and sums of each place over all others within reach: for each exponent low + i x step of the distance that of
    weight x value, then that of weights, as distance_sums() has them. A weight is the one of the exponent before it times a
    ratio, so a pair costs two powers whatever the grid."""
    limit = float(radius) * radius

    def work(a, b, targets, others):
        found, sums = np.zeros(len(a["x"]), np.int64), np.zeros((len(a["x"]), 2 * steps))
        for i, at, d2, own in within(a, b, _mates(targets, others), limit):
            logs, both = np.log(np.maximum(d2, D.MIN_SQUARED_DISTANCE)), np.stack([b[value][at], np.ones(len(at))], axis=1)
            both[own] = 0.0
            w, ratio = np.exp(logs * (-low / 2)), np.exp(logs * (-step / 2))
            found[i] = len(at)
            ends = [logs.min(), logs.max()] if len(at) else [0.0]
            for j in range(steps):
                powers = [-e * (low + j * step) / 2 for e in ends]
                held = w if -23 < min(powers) and max(powers) < 20 else np.clip(w, 1e-10, 1e9)  # logarithms of the bounds
                sums[i, j], sums[i, steps + j] = held @ both
                w *= ratio
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * 2 * steps), pa.array(sums.ravel()))
        return {"found": pa.array(found), "sums": cells}

    return gathered(places, places, radius, work, "found long, sums array<double>", o=[value]).where("found > 0").drop("_i")


def first_within(targets: DataFrame, others: DataFrame, radius: float, most: int, value: str) -> DataFrame:
    """t_id, n_id, n_value: of each target the `most` others within the radius that have the smallest ids. Others are gone
    through in the order of ids, as far as some target still lacks one."""
    limit = float(radius) * radius
    kind = dict(others.dtypes)["id"]

    def work(a, b, targets, others):
        order = pc.sort_indices(others.column("id")).to_numpy()
        x, y = b["x"][order], b["y"][order]
        ids, values = others.column("id").combine_chunks().take(pa.array(order)), b[value][order]
        rows, taken = [[] for _ in a["x"]], np.zeros(len(a["x"]), np.int64)
        open_ = np.arange(len(taken))
        for i in range(0, len(x), 256):
            step = max(1, BLOCK // 256)
            for j in range(0, len(open_), step):
                part = open_[j : j + step]
                hit = (a["x"][part][:, None] - x[i : i + 256]) ** 2 + (a["y"][part][:, None] - y[i : i + 256]) ** 2 <= limit
                hit &= taken[part][:, None] + np.cumsum(hit, axis=1) <= most
                taken[part] += hit.sum(axis=1)
                for r, c in zip(*np.nonzero(hit)):
                    rows[part[r]].append(i + c)
            open_ = open_[taken[open_] < most]
            if not len(open_):
                break
        flat = np.array([c for r in rows for c in r], np.int64)
        ends = pa.array(np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(flat))), "values": pa.ListArray.from_arrays(ends, pa.array(values[flat]))}

    found = gathered(targets, others, radius, work, f"ids array<{kind}>, values array<double>", o=[value])
    found = found.select("t_id", F.explode(F.arrays_zip("ids", "values")).alias("_n")).select("t_id", F.col("_n.ids").alias("n_id"), F.col("_n.values").alias("n_value"))
    # Others around a tile may be dealt in pieces, each of which gives its first.
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy("n_id"))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


#: Tiles in which the nearest are looked for are so many times as wide as the radius searched.
WIDE = 8.0


def _nearest(k: int, radius: float, t: list[str], o: list[str]) -> Work:
    def work(a, b, targets, others):
        ids = others.column("id").combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.argsort(b["x"], kind="stable")
        x, y, rank = b["x"][order], b["y"][order], rank[order]
        chosen: list = [None] * len(a["x"])
        reach = radius
        # Neighbours follow each other, so the reach of one fits the next.
        for i in np.lexsort((a["y"], np.floor(a["x"] / radius))):
            tx, ty = a["x"][i], a["y"][i]
            while True:
                low, high = np.searchsorted(x, tx - reach, "left"), np.searchsorted(x, tx + reach, "right")
                dx, dy = tx - x[low:high], ty - y[low:high]
                d2 = dx * dx + dy * dy
                at = np.flatnonzero(d2 <= reach * reach)
                if len(at) >= k or reach >= radius:
                    break
                reach = min(radius, 2 * reach)
            d2, at = d2[at], at + low
            if len(at) > k:
                kept = d2 <= np.partition(d2, k - 1)[k - 1]
                d2, at = d2[kept], at[kept]
            at = order[at[np.lexsort((rank[at], d2))[:k]]]
            chosen[i] = at
            if len(at) == k:
                reach = min(radius, 1.25 * float(np.sqrt(d2.max())) + 1e-9 * radius)
        flat = pa.array(np.concatenate(chosen) if chosen else np.empty(0, np.int64))
        ends = pa.array(np.append(0, np.cumsum([len(c) for c in chosen])).astype(np.int32))
        lists = {f"n_{c}": pa.ListArray.from_arrays(ends, others.column(c).combine_chunks().take(flat)) for c in ("id", "x", "y", *o)}
        return lists | {f"t_{c}": targets.column(f"t_{c}") for c in ("x", "y", *t)}

    return work


def nearest_within(targets: DataFrame, others: DataFrame, radius: float, most: int) -> DataFrame:
    """t_id, n_id and rank of the `most` least dissimilar others of each target within the radius, by D.distance(): a target's own
    id comes first, then the distance, of at least 10 units, ties to the smaller id; ids are unique on either side. No pair
    is a row but of the few that a piece of a tile gives."""
    limit, least = float(radius) * radius, D.MIN_SQUARED_DISTANCE

    def work(a, b, targets, others):
        ids = others.column("id").combine_chunks()
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.argsort(b["x"], kind="stable")
        x, y, rank = b["x"][order], b["y"][order], rank[order]
        by, first, last = _mates(targets, others)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chosen, keys = [np.empty(0, np.int64)], [np.empty(0)]
        size, reach = np.zeros(len(a["x"]), np.int64), float(radius)
        for i in range(len(a["x"])):
            tx, ty, own = a["x"][i], a["y"][i], place[by[first[i] : last[i]]]
            reach = float(radius) if len(own) else max(min(reach, float(radius)), min(least**0.5, float(radius)))
            while True:
                edge = reach * (1 + 1e-9) + 1e-9 * abs(tx)
                low, high = np.searchsorted(x, tx - edge, "left"), np.searchsorted(x, tx + edge, "right")
                d2 = (tx - x[low:high]) ** 2 + (ty - y[low:high]) ** 2
                at = np.flatnonzero(d2 <= min(reach * reach, limit) if reach < radius else d2 <= limit)
                if len(at) >= most or reach >= radius:
                    break
                reach = min(float(radius), 2 * reach)
            key, at = np.maximum(d2[at], least), at + low
            if len(own):
                key[np.isin(at, own)] = 0.0
            if len(at) > most:
                kept = key <= np.partition(key, most - 1)[most - 1]
                key, at = key[kept], at[kept]
            best = np.lexsort((rank[at], key))[:most]
            if len(best) == most:
                reach = 1.25 * float(np.sqrt(key[best[-1]]))
            chosen.append(order[at[best]])
            keys.append(key[best])
            size[i] = len(best)
        ends = pa.array(np.append(0, np.cumsum(size)).astype(np.int32))
        return {"ids": pa.ListArray.from_arrays(ends, ids.take(pa.array(np.concatenate(chosen)))), "keys": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys)))}

    found = gathered(targets, others, radius, work, f"ids array<{dict(others.dtypes)['id']}>, keys array<double>", wide=WIDE)
    found = found.select("t_id", F.explode(F.arrays_zip("ids", "keys")).alias("_n")).select("t_id", F.col("_n.ids").alias("n_id"), F.col("_n.keys").alias("_key"))
    rank = F.row_number().over(Window.partitionBy("t_id").orderBy("_key", "n_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).drop("_key")


def nearest_rows(targets: DataFrame, others: DataFrame, k: int, t: list[str], o: list[str]) -> DataFrame | None:
    """Pairs (t_- and n_-prefixed: id, x, y and the numeric columns asked for) of each target with its k nearest others, ties to
    the smaller id, as far as they lie within the radius that holds some 4 k of evenly spread others: a target with k pairs has
    those of spatial.knn_join(), one with fewer is to be searched on. Others come to their tiles with their columns, so no pair is
    exchanged. None where there are fewer than k others, or places with too many for a task."""
    located = others.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    box = located.agg(F.count("*").alias("n"), *[g(c).alias(f"{n}{c}") for c in ("x", "y") for n, g in (("lo", F.min), ("hi", F.max))]).first()
    if box["n"] < k:
        return None
    wide, high = (max(box[f"hi{c}"] - box[f"lo{c}"], 1.0) for c in ("x", "y"))
    radius = max(1.0, (4.0 * k * wide * high / (box["n"] * 3.14159)) ** 0.5)
    # What rounding may lose at the edge of a tile's surroundings is not counted on.
    searched = radius * (1 - 1e-9)
    tile = lambda c: F.floor(F.col(c) / (WIDE * radius))
    if 2 * located.groupBy(tile("x"), tile("y")).count().agg(F.max("count")).first()[0] > PIECE:
        return None
    kinds = dict(others.dtypes)
    t, o = ([c for c in cols if c not in ("id", "x", "y")] for cols in (t, o))
    lists = {f"n_{c}": kinds[c] if c == "id" else "double" for c in ("id", "x", "y", *o)}
    out = ", ".join([f"{c} array<{kind}>" for c, kind in lists.items()] + [f"t_{c} double" for c in ("x", "y", *t)])
    # others are repeated around tiles no more than 1.6 times, and `whole` as no tile has too many.
    found = gathered(targets, others, radius, _nearest(k, searched, t, o), out, t=t, o=o, whole=True, wide=WIDE)
    zipped = found.select("t_id", *[f"t_{c}" for c in ("x", "y", *t)], F.explode(F.arrays_zip(*lists)).alias("_n"))
    return zipped.select(*[c for c in zipped.columns if c != "_n"], *[F.col(f"_n.{c}").alias(c) for c in lists])


def radius_or_nearest(targets: DataFrame, others: DataFrame, radius: float, least: int = 10) -> DataFrame:
    """Pairs (t_- and n_-prefixed) within radius, but the `least` nearest others at any distance for targets with fewer. Targets
    are counted first, so pairs are neither exchanged nor sorted for it."""
    found = radius_sums(targets.select("id", "x", "y"), others.select("id", "x", "y"), radius, lambda d2, *_: np.empty((len(d2), 0)), 0)
    enough = saved(found.where(F.col("found") >= least).select("id"))
    kept = radius_join(targets.join(enough, "id", "left_semi"), others, radius)
    few = saved(targets.join(enough, "id", "left_anti"))
    return kept if few.isEmpty() else kept.unionByName(knn_join(few, others, least).drop("knn_rank").select(*kept.columns))


def _below(y: np.ndarray, value: np.ndarray, first: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair of numbers how many of the first `first` points have a rank y (0, 1, ...) below `bound`, and the sum of their
    values. Points are parted by one bit of y after the other, the highest first, keeping their order otherwise."""
    count, total = np.zeros(len(first), np.int64), np.zeros(len(first))
    start, upto = np.zeros(len(first), np.int64), first.astype(np.int64)
    bits = int(len(y)).bit_length()
    for bit in range(bits - 1, -1, -1):
        zero = (y >> bit & 1) == 0
        zeros, sums = np.append(0, np.cumsum(zero)), np.append(0.0, np.cumsum(np.where(zero, value, 0.0)))
        one = (bound >> bit & 1) == 1
        # Those with a 0 where the bound has a 1 are below it; the others are told by the next bits.
        count += np.where(one, zeros[upto] - zeros[start], 0)
        total += np.where(one, sums[upto] - sums[start], 0.0)
        start, upto = (np.where(one, zeros[-1] + e - zeros[e], zeros[e]) for e in (start, upto))
        order = np.argsort(~zero, kind="stable")
        y, value = y[order], value[order]
    return count, total


def _held(rects: list[np.ndarray], x: np.ndarray, y: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points in each rectangle [xl, xh) x [yl, yh): differences of what is left of and below corners."""
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(y[order], kind="stable")] = np.arange(len(y))
    xs, ys, value = x[order], np.sort(y), value[order]
    xl, xh, yl, yh = rects
    count, total = np.zeros(len(xl), np.int64), np.zeros(len(xl))
    for ex, sx in ((xl, -1), (xh, 1)):
        for ey, sy in ((yl, -1), (yh, 1)):
            n, s = _below(rank, value, np.searchsorted(xs, ex, "left"), np.searchsorted(ys, ey, "left"))
            count += sx * sy * n
            total += sx * sy * s
    return count, total


#: Powers of two by which the classes of rectangles' sides differ.
CLASS = 4


def range_sums(rects: DataFrame, points: DataFrame, x: tuple[str, str], y: tuple[str, str], value: str, at: tuple[str, str] = ("x", "y"), unit: float = 1.0) -> DataFrame:
    """rects that hold any points (low <= coordinate < high in both directions) with n, their number, and total, the sum of
    their value; no pair is a row. As in spatial.range_join a rectangle meets two nodes at most on each axis, by classes of its
    sides, and points are repeated for each pair of classes that occurs. What nodes give is added up, so one with many points
    is dealt in pieces. Sums are differences of running sums, exact as long as these are, as of whole numbers below 2^53."""
    spark, (xl, xh), (yl, yh), (px, py) = rects.sparkSession, x, y, at
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = saved(rects.where((F.col(xl) < F.col(xh)) & (F.col(yl) < F.col(yh))).withColumn("_key", F.monotonically_increasing_id()))
    sized = held.select("_key", *[F.col(c).cast("double").alias(n) for c, n in ((xl, "_xl"), (xh, "_xh"), (yl, "_yl"), (yh, "_yh"))])
    for c in ("_x", "_y"):
        sized = sized.withColumns({f"{c}a": whole_cell(F.col(f"{c}l"), unit), f"{c}b": whole_cell(F.col(f"{c}h"), unit)})
        sized = sized.withColumn(f"{c}k", (F.ceil(F.length(F.bin(F.col(f"{c}b") - F.col(f"{c}a"))) / CLASS) * CLASS).cast("int"))
    classes = sorted((r[0], r[1]) for r in sized.select("_xk", "_yk").distinct().collect())  # 16 x 16 at most
    for c in ("_x", "_y"):
        node = lambda end, c=c: F.expr(f"shiftright({c}{end}, {c}k)")
        sized = sized.withColumn(f"{c}n", F.explode(F.array_distinct(F.array(node("a"), node("b")))))
    pairs = F.array(*[F.struct(F.lit(i).alias("xk"), F.lit(j).alias("yk")) for i, j in classes]) if classes else F.expr("array_repeat(named_struct('xk', 0, 'yk', 0), 0)")
    placed = points.where(F.col(px).isNotNull() & F.col(py).isNotNull()).select(F.col(px).cast("double").alias("_px"), F.col(py).cast("double").alias("_py"), F.col(value).cast("double").alias("_v"))
    placed = placed.withColumn("_c", F.explode(pairs)).withColumns({"_xk": F.col("_c.xk"), "_yk": F.col("_c.yk")}).drop("_c")
    placed = placed.withColumns({"_xa": whole_cell(F.col("_px"), unit), "_ya": whole_cell(F.col("_py"), unit)})
    placed = placed.withColumns({"_xn": F.expr("shiftright(_xa, _xk)"), "_yn": F.expr("shiftright(_ya, _yk)")}).drop("_xa", "_ya")
    keys = ["_xk", "_yk", "_xn", "_yn"]
    crowd = lambda df, c: df.groupBy(*keys).count().where(F.col("count") > PIECE).select(*keys, F.ceil(F.col("count") / PIECE).cast("int").alias(c))
    parts = saved(crowd(placed, "_m").join(crowd(sized, "_k"), keys, "full"))
    sized = sized.select("_key", "_xl", "_xh", "_yl", "_yh", *keys)
    if parts.isEmpty():
        sized, placed = (df.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for df in (sized, placed))
    else:
        some = lambda c: F.explode(F.expr(f"sequence(0, coalesce({c}, 1) - 1)"))
        one = lambda c, *of: F.pmod(F.xxhash64(*of), F.coalesce(F.col(c), F.lit(1))).cast("int")
        sized, placed = (df.join(F.broadcast(parts), keys, "left") for df in (sized, placed))
        sized = sized.withColumns({"_j": one("_k", "_key")}).withColumn("_i", some("_m")).drop("_m", "_k")
        placed = placed.withColumns({"_i": F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col("_m"), F.lit(1))).cast("int")}).withColumn("_j", some("_k")).drop("_m", "_k")
    keys += ["_i", "_j"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            a, n, s = a.slice(0, 0), np.zeros(0, np.int64), np.zeros(0)
        else:
            xs, ys, values = (b.column(c).to_numpy() for c in ("_px", "_py", "_v"))
            n, s = _held([a.column(c).to_numpy() for c in ("_xl", "_xh", "_yl", "_yh")], xs, ys, np.nan_to_num(values))
        some_ = pa.array(n > 0, pa.bool_())
        return pa.table({"_key": a.column("_key").filter(some_), "n": pa.array(n).filter(some_), "total": pa.array(s).filter(some_)})

    met = sized.repartition(shuffled, *keys).groupBy(*keys).cogroup(placed.repartition(shuffled, *keys).groupBy(*keys)).applyInArrow(run, "_key long, n long, total double")
    sums = met.groupBy("_key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return held.join(sums, "_key").drop("_key")


#: Cells along a side of the tiles whose links a task finds.
TILE = 16


def _met(x: np.ndarray, y: np.ndarray, one: np.ndarray, two: np.ndarray, limit: float) -> bool:
    """Whether a point of `one` lies within reach of one of `two` (places in x and y). Only points in reach of the other
    side's bounds are tested."""

    def facing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = [np.maximum(0.0, np.maximum(v[b].min() - v[a], v[a] - v[b].max())) for v in (x, y)]
        return a[(gap[0] ** 2 + gap[1] ** 2) * (1 - 1e-12) <= limit]

    if not (len(one) and len(two)):
        return False
    one, two = facing(one, two), facing(two, one)
    step = max(1, BLOCK // max(1, len(two)))
    return any((((x[one[i : i + step], None] - x[two]) ** 2 + (y[one[i : i + step], None] - y[two]) ** 2) <= limit).any() for i in range(0, len(one), step))


def _linked(cells: pa.Table, limit: float) -> list[tuple[int, int]]:
    """The pairs of cells, by the rows of their first points, that points link of which one at least is new. Cells that belong
    to the tile meet those around them, each pair once."""
    column = lambda c: cells.column(c).combine_chunks()
    group = column("by").dictionary_encode().indices.fill_null(-1).to_numpy()
    cx, cy, x, y = (column(c).to_numpy() for c in ("cx", "cy", "x", "y"))
    new, mine = (column(c).to_numpy(zero_copy_only=False) for c in ("new", "mine"))
    high, wide = int(np.ptp(cy)) + 5, int(np.ptp(cx)) + 5
    key = ((group.astype(np.int64) + 1) * wide + (cx - cx.min() + 2)) * high + (cy - cy.min() + 2)
    order = np.lexsort((~new, key))
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    ends, cell = np.append(start, len(order)), key[order][start]
    fresh = np.add.reduceat(new[order].astype(np.int64), start)
    own = np.flatnonzero(mine[order[start]])
    pairs = []
    for step in (di * high + dj for di in range(3) for dj in range(-2, 3) if di or dj > 0):
        there = np.minimum(np.searchsorted(cell, cell[own] + step), len(cell) - 1)
        some = (cell[there] == cell[own] + step) & ((fresh[own] > 0) | (fresh[there] > 0))
        pairs.append(np.stack([own[some], there[some]]))
    a, b = np.concatenate(pairs, axis=1)
    found, size = np.zeros(len(a), bool), np.diff(ends)
    # Most neighbours are told by a few of their points; cells of no more than that are gone through.
    left = np.arange(len(a))
    for few in (2, 4, 16):
        hit = np.zeros(len(left), bool)
        for i in range(few):
            for j in range(few):
                p, q = order[np.minimum(start[a[left]] + i, ends[a[left] + 1] - 1)], order[np.minimum(start[b[left]] + j, ends[b[left] + 1] - 1)]
                hit |= ((x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2 <= limit) & (new[p] | new[q])
        found[left] = hit
        left = left[~hit & (np.maximum(size[a[left]], size[b[left]]) > few)]
    for k in left:
        one, two = (order[start[c] : ends[c + 1]] for c in (a[k], b[k]))
        ours, theirs = fresh[a[k]], fresh[b[k]]
        found[k] = _met(x, y, one[:ours], two, limit) or _met(x, y, one[ours:], two[:theirs], limit)
    return [(int(order[start[i]]), int(order[start[j]])) for i, j in zip(a[found], b[found])]


def reach_links(rows: DataFrame, epsilon: float, by: str | None = None, fresh: str | None = None) -> DataFrame:
    """a_id, b_id: a few edges for each row that connect what the pairs within epsilon connect, those of one `by` only. Points of
    a cell whose diagonal is epsilon hang together, so each is linked to one of them; two cells are linked, by these, if any of
    their points are within reach. With `fresh` (a boolean column) only what needs a row that is: then other rows of a cell
    are taken to hang together as it is, and one of them is what the cell's rows are linked to."""
    limit, side = float(epsilon) ** 2, max(float(epsilon), 1e-9) / 2**0.5 * (1 - 1e-9)
    cells = ["by", "cx", "cy"]
    here = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    here = here.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y")], (F.col(by) if by else F.lit(0)).alias("by"), (F.col(fresh) if fresh else F.lit(True)).alias("new"))
    here = here.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in ("x", "y")})
    reps = saved(here.groupBy(*cells).agg(F.coalesce(F.min(F.when(~F.col("new"), F.col("id"))), F.min("id")).alias("rep"), F.max("new").alias("new")))
    same = F.col("by").eqNullSafe(F.col("_by")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy"))
    least = reps.where("new").select(*[F.col(c).alias(f"_{c}") for c in cells], "rep")
    stars = here.where("new").join(least, same).where("id <> rep").select(F.col("rep").alias("a_id"), F.col("id").alias("b_id"))
    # A tile is its cells and the two rows of cells around it that its own may reach; a place is tested once.
    tile = lambda c, i: F.floor((F.col(c) + i) / TILE)
    tiles = F.array_distinct(F.array(*[F.struct(tile("cx", i).alias("x"), tile("cy", j).alias("y")) for i in (-2, 0) for j in (-2, 0, 2)]))
    places = here.groupBy(*cells, "x", "y").agg(F.max("new").alias("new")).withColumn("_t", F.explode(tiles))
    places = places.select(*cells, "x", "y", "new", F.col("_t.x").alias("tx"), F.col("_t.y").alias("ty"), ((F.col("_t.x") == tile("cx", 0)) & (F.col("_t.y") == tile("cy", 0))).alias("mine"))
    kind = dict(here.dtypes)["by"]
    ends = [f"{p}{c}" for p in "ab" for c in cells]

    def run(part: pa.Table) -> pa.Table:
        found = _linked(part, limit)
        sides = [part.select(cells).take(pa.array([pair[k] for pair in found], pa.int64())) for k in (0, 1)]
        return pa.table([c for side in sides for c in side.columns], names=ends)

    linked = places.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tx", "ty").groupBy("tx", "ty").applyInArrow(run, ", ".join(f"{c} {kind if c[1:] == 'by' else 'long'}" for c in ends))
    for p in "ab":
        side_ = reps.select(*[F.col(c).alias(f"_{c}") for c in cells], F.col("rep").alias(f"{p}_id"))
        linked = linked.join(side_, F.col(f"{p}by").eqNullSafe(F.col("_by")) & (F.col(f"{p}cx") == F.col("_cx")) & (F.col(f"{p}cy") == F.col("_cy"))).drop("_by", "_cx", "_cy")
    return stars.unionByName(linked.select("a_id", "b_id"))
