"""Dissimilarities of two records, as columns over `t_` (target) and `n_` (comparable) prefixed pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compval.functions import scalars as S
from compval.schema import FEATURES

INF = float("inf")
MIN_SQUARED_DISTANCE = 100.0
#: Weights whose sum is no more than this count as none.
NO_WEIGHT = 2.220446049250313e-16

#: The weight of what is infinitely dissimilar.
LEAST_WEIGHT = 1 / 1e10

#: Builds the column from the prefixes of the two records.
Dissimilarity = Callable[[str, str], Column]


def sqm_price_difference() -> Dissimilarity:
    return lambda a, b: F.pow(F.col(a + "sqm") - F.col(b + "sqm"), 2)


def omniscient(price: str = "known_price") -> Dissimilarity:
    """The difference of known prices, as join_known_prices() adds them: for analysis only, as targets' prices are in it."""
    return lambda a, b: F.abs(F.col(a + price) - F.col(b + price))


@dataclass(frozen=True)
class Distance:
    """Distance to a power, of at least 10 units; 0 for the same record."""

    power: float = 2.0

    def __call__(self, a: str, b: str) -> Column:
        return F.when(F.col(a + "id") == F.col(b + "id"), 0.0).otherwise(F.pow(F.greatest(S.squared_distance(a, b), F.lit(MIN_SQUARED_DISTANCE)), self.power / 2))


def distance(power: float = 2.0) -> Dissimilarity:
    return Distance(power)


def constant(value: float) -> Dissimilarity:
    return lambda a, b: F.when(F.col(a + "id") == F.col(b + "id"), 0.0).otherwise(float(value))


def closure(function: Dissimilarity) -> Dissimilarity:
    return function


def _total(cs: list[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0))


def squared_norm(prefix: str = "") -> Column:
    return _total([F.col(prefix + f).cast("double") * F.col(prefix + f).cast("double") for f in FEATURES])


def inner_product(a: str, b: str) -> Column:
    return _total([F.col(a + f).cast("double") * F.col(b + f).cast("double") for f in FEATURES])


def cosine_of(norms: Column, inner: Column) -> Column:
    """Of the product of the squared norms and the inner product; columns of their own, as both are used twice."""
    return F.when((norms == 0) | (inner == 0), INF).otherwise(F.sqrt(norms) / inner)


def cosine() -> Dissimilarity:
    """Product of the norms over the inner product; slots that are null in either record count only in the other's norm."""
    return lambda a, b: cosine_of(squared_norm(a) * squared_norm(b), inner_product(a, b))


def lp(p: float = 2.0, scale: dict[str, tuple[float, float]] | None = None) -> Dissimilarity:
    """The Lp distance over the slots that both records have; scale maps a slot to (shift, factor). Its attribute `columns` has
    the slots that count."""
    factors = {f: 1.0 if scale is None else scale.get(f, (0.0, 0.0))[1] for f in FEATURES}

    def of(a: str, b: str) -> Column:
        out = F.lit(0.0)
        for f, factor in factors.items():
            if factor:
                d = F.abs(F.col(a + f).cast("double") - F.col(b + f).cast("double")) * factor
                out = out + F.coalesce(F.pow(d, p), F.lit(0.0))
        return F.pow(out, 1 / p)

    of.columns = [f for f, factor in factors.items() if factor]
    return of


def columns_of(d: Dissimilarity) -> list[str] | None:
    """The numeric columns that a dissimilarity reads besides the ids, if it tells them."""
    if isinstance(d, Filtered):
        return columns_of(d.inner) if d.guards == Guards(**{f: getattr(d.guards, f) for f in d.guards.__dataclass_fields__ if f.endswith("_by_category")}) else None
    return getattr(d, "columns", None)


def _stats(train: DataFrame, low, high) -> dict[str, tuple[float | None, float | None]]:
    row = train.agg(*[g(F.col(f).cast("double")).alias(f"{k}_{f}") for f in FEATURES for k, g in (("a", low), ("b", high))]).first()
    return {f: (row[f"a_{f}"], row[f"b_{f}"]) for f in FEATURES}


def min_max_scale(train: DataFrame, weights: list[float] | None = None) -> dict[str, tuple[float, float]]:
    """Slot -> (minimum, weight / range); slots without a range don't count. One aggregation."""
    out = {}
    for (f, (lo, hi)), w in zip(_stats(train, F.min, F.max).items(), weights or [1.0] * len(FEATURES)):
        lo, hi = (0.0, 1.0) if lo is None else (lo, hi)
        out[f] = (lo, 0.0 if hi - lo < 1e-9 else w / (hi - lo))
    return out


def z_scale(train: DataFrame, weights: list[float] | None = None, strict: bool = False) -> dict[str, tuple[float, float]]:
    """Slot -> (mean, weight / population deviation); with strict, an empty slot is an error."""
    out = {}
    for (f, (mean, dev)), w in zip(_stats(train, F.avg, F.stddev_pop).items(), weights or [1.0] * len(FEATURES)):
        if mean is None and strict:
            raise ValueError(f"no value of {f} to train on")
        out[f] = (mean or 0.0, 0.0 if dev is None or dev <= 1e-9 else w / dev)
    return out


#: What guards and similarities derive of one record.
DERIVED = {"_object": S.object_category, "_house": S.is_house, "_years": S.year_category, "_lots": S.lot_category, "_areas": S.area_category, "_norm": squared_norm}


def derived(rows: DataFrame) -> DataFrame:
    """rows with what `ready` guards and similarities read, so that it is derived once a record and not once a pair."""
    return rows.withColumns({name: of("") for name, of in DERIVED.items()})


def _derived(name: str, prefix: str, ready: bool) -> Column:
    return F.col(prefix + name) if ready else DERIVED[name](prefix)


@dataclass(frozen=True)
class Guards:
    """Most that two records may differ by; None for any. A difference to an unknown value fails, two unknown ones pass."""

    regiotyp: float | None = None
    objektunterart_category: float | None = None
    zustand: float | None = None
    urbanity_score: float | None = None
    balcony_area: float | None = None
    convenience_store_distance: float | None = None
    distance_elem_school: float | None = None
    distance_jun_highschool: float | None = None
    distance_parking: float | None = None
    walking_distance: float | None = None
    floor_no: float | None = None
    baujahr: float | None = None
    baujahr_by_category: bool = True
    ausstattung: float | None = None
    grundstuecksgroesse: float | None = None
    grundstuecksgroesse_by_category: bool = True
    wohnflaeche: float | None = None
    wohnflaeche_by_category: bool = True
    days: float | None = None
    kilometres: float | None = None

    PLAIN = ("regiotyp", "zustand", "urbanity_score", "balcony_area", "convenience_store_distance", "distance_elem_school", "distance_jun_highschool", "distance_parking", "walking_distance", "floor_no")

    def passes(self, a: str, b: str, ready: bool = False) -> Column:
        """Cheap guards first; never null. With `ready` both records are derived()."""
        of = lambda name, prefix: _derived(name, prefix, ready)
        out = F.lit(True)
        for name in self.PLAIN:
            if (most := getattr(self, name)) is not None:
                out = out & within(F.col(a + name), F.col(b + name), most)
        ca, cb = of("_object", a), of("_object", b)
        if self.objektunterart_category is not None:
            out = out & within(ca, cb, self.objektunterart_category)
        either = lambda by, name, category: (of(category, a), of(category, b)) if by else (F.col(a + name), F.col(b + name))
        if self.baujahr is not None:
            out = out & within(*either(self.baujahr_by_category, "baujahr", "_years"), self.baujahr)
        if self.ausstattung is not None:
            flats = F.coalesce((ca == 3) & (cb == 3), F.lit(False))
            out = out & (~flats | within(F.col(a + "ausstattung"), F.col(b + "ausstattung"), self.ausstattung))
        if self.grundstuecksgroesse is not None:
            out = out & (~(of("_house", a) & of("_house", b)) | within(*either(self.grundstuecksgroesse_by_category, "grundstuecksgroesse", "_lots"), self.grundstuecksgroesse))
        if self.wohnflaeche is not None:
            out = out & (~ca.eqNullSafe(cb) | within(*either(self.wohnflaeche_by_category, "wohnflaeche", "_areas"), self.wohnflaeche))
        if self.days is not None:
            apart = F.abs(F.datediff(F.col(a + "wertermittlungsstichtag"), F.col(b + "wertermittlungsstichtag")))
            out = out & F.coalesce(apart < self.days, F.lit(True))
        if self.kilometres is not None:
            out = out & F.coalesce(S.squared_distance(a, b) <= (1000 * self.kilometres) ** 2, F.lit(True))
        return out


    def keys(self, prefix: str) -> list[Column]:
        """What two records that pass have in common: the values that may not differ."""
        out = [F.col(prefix + name) for name in self.PLAIN if getattr(self, name) == 0]
        same = lambda most, by: most is not None and (most < 1 if by else most == 0)
        if same(self.baujahr, self.baujahr_by_category):
            out.append(S.year_category(prefix) if self.baujahr_by_category else F.col(prefix + "baujahr"))
        if same(self.objektunterart_category, True):
            out.append(S.object_category(prefix))
            if same(self.wohnflaeche, self.wohnflaeche_by_category):
                out.append(S.area_category(prefix) if self.wohnflaeche_by_category else F.col(prefix + "wohnflaeche"))
            if same(self.grundstuecksgroesse, self.grundstuecksgroesse_by_category):
                out.append(F.when(S.is_house(prefix), S.lot_category(prefix) if self.grundstuecksgroesse_by_category else F.col(prefix + "grundstuecksgroesse")))
            if same(self.ausstattung, False):
                out.append(F.when(S.object_category(prefix) == 3, F.col(prefix + "ausstattung")))
        # 0.0 and -0.0 are one value.
        return [c.cast("double") + 0.0 for c in out]


def within(a: Column, b: Column, most: float) -> Column:
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(F.abs(a - b) <= most, F.lit(False)))


def gaps(a: str, b: str, names: list[str]) -> list[Column]:
    """By how much two records differ in each of the guards named, sizes and years as numbers: a guard passes where its limit
    is at least that. -1 passes any limit, infinite none."""

    def apart(x: Column, y: Column) -> Column:
        return F.when(x.isNull() & y.isNull(), -1.0).otherwise(F.coalesce(F.abs(x - y).cast("double"), F.lit(INF)))

    ca, cb = S.object_category(a), S.object_category(b)
    plain = lambda name: apart(F.col(a + name), F.col(b + name))
    only = lambda where, name: F.when(where, plain(name)).otherwise(-1.0)
    # Days are whole and must be fewer than the limit.
    days = F.abs(F.datediff(F.col(a + "wertermittlungsstichtag"), F.col(b + "wertermittlungsstichtag"))) + 0.5
    special = {
        "objektunterart_category": lambda: apart(ca, cb),
        "ausstattung": lambda: only(F.coalesce((ca == 3) & (cb == 3), F.lit(False)), "ausstattung"),
        "grundstuecksgroesse": lambda: only(S.is_house(a) & S.is_house(b), "grundstuecksgroesse"),
        "wohnflaeche": lambda: only(ca.eqNullSafe(cb), "wohnflaeche"),
        "days": lambda: F.coalesce(days.cast("double"), F.lit(-1.0)),
    }
    return [special[name]() if name in special else plain(name) for name in names]


@dataclass(frozen=True)
class Filtered:
    """inner, but infinite where a guard fails. With `ready` the records are derived()."""

    guards: Guards
    inner: Dissimilarity
    ready: bool = False

    def __call__(self, a: str, b: str) -> Column:
        return F.when(self.guards.passes(a, b, self.ready), self.inner(a, b)).otherwise(INF)


def filtered(guards: Guards, inner: Dissimilarity) -> Dissimilarity:
    return Filtered(guards, inner)


@dataclass(frozen=True)
class Expert:
    """A similarity of 0 to 100 from two weighted means of partial similarities, and its inverse as dissimilarity. With `ready`
    the records are derived()."""

    cutoff: float | None = None
    part_weight: float = 0.9
    year_factor: float = 2.0
    house_area_factor: float = 0.4
    flat_area_factor: float = 2.0
    distance_factor: float = 2.5
    location_factor: float = 10.0
    lot_factor: float = 0.2
    parking_factor: float = 25.0
    room_factor: float = 50.0
    weights: dict[str, float] = field(default_factory=dict)
    ready: bool = False

    @staticmethod
    def _near(a: Column, b: Column, factor) -> Column:
        return F.coalesce(F.greatest(F.lit(0.0), 100.0 - F.abs(a - b) * factor), F.lit(0.0))

    @staticmethod
    def _mean(parts: list[tuple[Column, float, Column]]) -> Column:
        """The weighted mean of what applies (1 or 0); the plain mean of it where it has no weight."""
        total = lambda f: sum((f(v, w, on) for v, w, on in parts), F.lit(0.0))
        w = total(lambda _, w, on: on * w)
        return F.when(F.abs(w) <= NO_WEIGHT, total(lambda v, _, on: v * on) / total(lambda _, __, on: on)).otherwise(total(lambda v, w, on: v * on * w) / w)

    def parts(self, a: str, b: str) -> tuple[Column, Column]:
        """The two means: of year, area, distance, location and lot; of parking, rooms, usage and cellar. Lots are of houses,
        cellars of a target that is one."""
        w = lambda k: float(self.weights.get(k, 1.0))
        always = F.lit(1.0)
        house = F.when(_derived("_house", a, self.ready), 1.0).otherwise(0.0)
        both = F.when(_derived("_house", a, self.ready) & _derived("_house", b, self.ready), 1.0).otherwise(0.0)
        area = F.when(_derived("_house", a, self.ready), self.house_area_factor).otherwise(self.flat_area_factor)
        one = [
            (self._near(S.year_of(a), S.year_of(b), self.year_factor), w("year"), always),
            (self._near(F.col(a + "wohnflaeche"), F.col(b + "wohnflaeche"), area), w("area"), always),
            (self._near(F.sqrt(S.squared_distance(a, b)) / 1000, F.lit(0.0), self.distance_factor), w("distance"), always),
            (self._near(S.location_score(a), S.location_score(b), self.location_factor), w("location"), always),
            (self._near(F.col(a + "grundstuecksgroesse"), F.col(b + "grundstuecksgroesse"), self.lot_factor), w("lot"), both),
        ]
        same = lambda c: F.when(F.col(a + c) == F.col(b + c), 100.0).otherwise(0.0)
        two = [
            (self._near(F.col(a + "anzahl_stellplaetze"), F.col(b + "anzahl_stellplaetze"), self.parking_factor), w("parking"), always),
            (self._near(F.col(a + "anzahl_zimmer"), F.col(b + "anzahl_zimmer"), self.room_factor), w("rooms"), always),
            (same("verwendung"), w("usage"), always),
            (same("keller"), w("cellar"), house),
        ]
        return tuple(F.least(F.lit(100.0), F.greatest(F.lit(0.0), self._mean(x))) for x in (one, two))

    def similarity(self, a: str, b: str) -> Column:
        one, two = self.parts(a, b)
        return one * self.part_weight + two * (1 - self.part_weight)

    def __call__(self, a: str, b: str) -> Column:
        s = self.similarity(a, b)
        out = similarity_to_dissimilarity(s)
        return out if self.cutoff is None else F.when(s < 100 * self.cutoff, INF).otherwise(out)


#: Guards of the expert dissimilarity.
EXPERT_GUARDS = Guards(regiotyp=0, objektunterart_category=0, wohnflaeche=0, grundstuecksgroesse=0, baujahr=0, days=5 * 366, kilometres=40, zustand=1, ausstattung=1)


def similarity_to_dissimilarity(s: Column) -> Column:
    return F.when(s == 0, INF).when(s == 100, 0.0).otherwise(1 / s)


def weight_of(dissimilarity: Column, a: str = "t_", b: str = "n_") -> Column:
    """0 for the target itself, else the inverse of the dissimilarity within [1e-9, 1e10]; not a number counts as 1e-9's."""
    clamped = F.least(F.greatest(F.nanvl(dissimilarity, F.lit(1e-9)), F.lit(1e-9)), F.lit(1e10))
    return F.when(F.col(a + "id") == F.col(b + "id"), 0.0).otherwise(1 / clamped)
