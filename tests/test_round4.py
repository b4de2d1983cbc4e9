"""What the fourth round's findings were about."""

import random

import pytest
from pyspark.sql import functions as F

from compval import queries
from compval.functions import dissimilarity as D
from compval.operators import fields, normalizers, predictors, spatial
from compval.operators.spatial import prefixed
from compval.schema import completed

SF = "/root/testdata/sf0.001"


def scattered(spark, n: int, seed: int, wide: int = 4000):
    """Places of whole numbers with a crowd, ids that repeat, and rows without a place."""
    rnd = random.Random(seed)
    rows = [(f"i{i % (n - 3):04}", float(rnd.randint(0, wide)), float(rnd.randint(-wide, 90)), rnd.uniform(1, 9)) for i in range(n)]
    rows += [(f"c{i:03}", 1000.0, -1000.0 + i % 3, 2.5) for i in range(40)] + [("none", None, 1.0, 2.0), ("far", 9e6, -9e6, 3.0)]
    return spark.createDataFrame(rows, "id string, x double, y double, sqm double")


@pytest.mark.parametrize("piece, own, radius", [(fields.PIECE, False, 700.0), (50, True, 700.0), (50, False, 0), (fields.PIECE, True, 5000.0)])
def test_disc_sums_are_those_of_the_join(spark, monkeypatch, piece, own, radius):
    monkeypatch.setattr(fields, "PIECE", piece)
    monkeypatch.setattr(fields, "EDGE", 64)
    targets, others = scattered(spark, 60, 1), scattered(spark, 200, 2)
    pairs = spatial.radius_join(targets, others, radius, exclude_self=own)
    d2 = (F.col("t_x") - F.col("n_x")) ** 2 + (F.col("t_y") - F.col("n_y")) ** 2
    want = {r["t_id"]: (r["n"], r["v"], r["d2"]) for r in pairs.groupBy("t_id").agg(F.count("*").alias("n"), F.sum("n_sqm").alias("v"), F.sum(d2).alias("d2")).collect()}
    got = {r["id"]: (r["found"], *r["s"]) for r in fields.disc_sums(targets, others, radius, ["sqm"], squares=True, exclude_self=own).collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        # Whole numbers are exact, prices are differences of running sums.
        assert (got[i][0], got[i][2]) == (v[0], v[2]) and got[i][1] == pytest.approx(v[1], rel=1e-9)


@pytest.mark.parametrize("name", ["join_radius", "join_radius_self"])
def test_counts_within_a_radius_join_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(spatial, "radius_join", lambda *_, **__: pytest.fail("pairs were joined"))
    assert queries.QUERIES[name](spark, SF).count()


@pytest.mark.parametrize("piece", [fields.PIECE, 60])
def test_local_levels_are_those_of_lists_of_neighbours(spark, monkeypatch, piece):
    """Rows without a date or a place, ones of a crowd, and ones without neighbours at their start or end."""
    monkeypatch.setattr(fields, "PIECE", piece)
    when = F.when(F.substring("id", 4, 1) != "7", F.expr("date_add(DATE '2016-03-01', CAST(pmod(hash(id), 700) AS INT))"))
    targets, others = (scattered(spark, n, seed).dropDuplicates(["id"]).withColumn(normalizers.DATE, when) for n, seed in ((60, 1), (250, 2)))
    row = lambda df: {r["id"]: r["adjusted_sqm"] for r in df.collect()}
    want = {mode: row(normalizers.Local(mode, 700.0, 90, "2017-01-01")._listed(targets, others)) for mode in ("median", "rank")}
    monkeypatch.setattr(normalizers, "radius_join", lambda *_, **__: pytest.fail("pairs were joined"))
    monkeypatch.setattr(fields, "crowded", lambda *_: False)
    for mode in want:
        assert row(normalizers.Local(mode, 700.0, 90, "2017-01-01").adjusted(targets, others)) == want[mode]
    pairs = spatial.radius_join(targets, others, 700.0)
    near = lambda c: F.when(F.abs(F.datediff(f"n_{normalizers.DATE}", c)) <= 90, F.col("n_sqm"))
    mean = pairs.groupBy("t_id", "t_sqm").agg((F.avg(near(F.lit("2017-01-01").cast("date"))) / F.avg(near(F.col(f"t_{normalizers.DATE}")))).alias("q"))
    ratio = {r["t_id"]: r["t_sqm"] * (1.0 if r["q"] is None else r["q"]) for r in mean.collect()}
    got = row(normalizers.Local("average", 700.0, 90, "2017-01-01").adjusted(targets, others))
    assert got == pytest.approx({r["id"]: ratio.get(r["id"], r["sqm"]) for r in targets.collect()}, rel=1e-12)
    assert sum(got[i] != r for i, r in ((r["id"], r["sqm"]) for r in targets.collect())) > 20


@pytest.mark.parametrize("piece", [fields.PIECE, 40])
def test_the_most_similar_by_distance_are_those_of_a_window(spark, monkeypatch, piece):
    """Ties, within 10 m by id, targets that are others elsewhere, and a kind that keeps all."""
    monkeypatch.setattr(fields, "PIECE", piece)
    kinds = F.element_at(F.array(*map(F.lit, ("Eigentumswohnung", "Einfamilienhaus", "Reihenhaus", "Mehrfamilienhaus"))), (F.pmod(F.hash("id"), F.lit(4)) + 1).cast("int"))
    sets = [scattered(spark, n, seed, 1500).dropDuplicates(["id"]).withColumns({"objektunterart": kinds, "marktwert": F.lit(1e5), "wohnflaeche": F.lit(50.0)}) for n, seed in ((50, 1), (200, 2))]
    model = predictors.WeightedAverage(D.distance(2.0), radius=300, fallback=None, most_similar_by_category={1: 1, 2: 2, 3: 4}).train(sets[1])
    want = sorted(tuple(r) for r in model._weighed(model.neighbours(sets[0])).select("t_id", "n_id", "dissim", "weight").collect())
    found = model.scored(sets[0]).select("t_id", "n_id", "dissim", "weight")
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 100


def test_norms_are_derived_once_a_record(spark):
    plan = queries.QUERIES["dissim_cosine"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "t__norm" in plan and "n__norm" in plan
    rows = D.derived(completed(spark.createDataFrame([(1, 3.0, None, 2), (2, 0.0, 0.0, 0), (3, None, 5.0, 7)], "id long, x double, y double, zustand int")))
    pairs = prefixed(rows, "t_").crossJoin(prefixed(rows, "n_"))
    for r in pairs.select(D.cosine()("t_", "n_").alias("a"), D.cosine_of(F.col("t__norm") * F.col("n__norm"), D.inner_product("t_", "n_")).alias("b")).collect():
        assert r["a"] == r["b"]
