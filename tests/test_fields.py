"""Sums over all others within a radius, and over intervals, against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from compval import queries
from compval.functions import dissimilarity as D
from compval.operators import clustering, environment, fields, predictors, spatial


def points(n: int, seed: int, first: int = 0) -> list:
    rnd = random.Random(seed)
    out = [(first + i, float(rnd.randint(0, 3000)), float(rnd.randint(-3000, 100)), rnd.uniform(1, 9)) for i in range(n)]
    return out + [(first + n, out[0][1], out[0][2], 5.0), (first + n + 1, None, 1.0, 2.0)]


@pytest.mark.parametrize("piece", [fields.PIECE, 7])
def test_sums_are_those_of_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(fields, "PIECE", piece)
    schema = "id long, x double, y double, sqm double"
    targets, others = points(40, 1, 100), points(150, 2)  # ids 100 to 141 are on both sides
    got = fields.distance_sums(spark.createDataFrame(targets, schema), spark.createDataFrame(others, schema), 500, 1.5, "sqm").collect()
    want = {}
    for i, x, y, _ in targets:
        near = [(j, (x - u) ** 2 + (y - v) ** 2, q) for j, u, v, q in others if None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 500**2]
        w = [0 if j == i else max(d2, 100.0) ** -0.75 for j, d2, _ in near]
        if near:
            want[i] = (len(near), sum(a * q for a, (_, _, q) in zip(w, near)), sum(w))
    assert {r["id"] for r in got} == set(want)
    for r in got:
        assert (r["found"], *r["s"]) == pytest.approx(want[r["id"]], rel=1e-12)


def test_a_prediction_by_distance_has_no_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr("compval.operators.spatial.radius_join", lambda *_, **__: pytest.fail("pairs were joined"))
    rows = spark.createDataFrame([(str(i), 50.0 * i, 0.0, 100.0, 1e5 + i) for i in range(30)], "id string, x double, y double, wohnflaeche double, marktwert double")
    assert predictors.dully().train(rows).predict(rows.drop("marktwert")).where("pred_sqm is null").isEmpty()


def test_environment_without_values(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 30.0, 0.0, None), (3, 0.0, 40.0, 7.0), (4, 9e5, 0.0, 1.0)], "id long, x double, y double, sqm double")
    price = D.sqm_price_difference()
    one, two = ({r["id"]: r["u"] for r in environment.environment(rows, d, 100).collect()} for d in (None, lambda a, b: price(a, b)))
    assert one == pytest.approx(two)


@pytest.mark.parametrize("value", [None, "x"])
def test_interval_sums_are_those_of_the_join(spark, monkeypatch, value):
    rnd = random.Random(3)
    places = spark.createDataFrame([(float(rnd.randint(0, 40)),) for _ in range(300)] + [(None,)], "x double")
    bounds = [(i, float(rnd.randint(-5, 45)), float(rnd.randint(-5, 45))) for i in range(60)] + [(60, -1e300, 1e12), (61, None, 3.0), (62, 7.0, 7.0), (60, 0.0, 1.0)]
    spans = spark.createDataFrame(bounds, "k long, lo double, hi double")
    joined = spatial.interval_join(places, spans, "x", "lo", "hi").groupBy("k", "lo", "hi").agg(F.count("*").alias("n"), F.sum("x").alias("total"))
    monkeypatch.setattr(spatial, "interval_join", lambda *_: pytest.fail("pairs were joined"))
    got = spatial.interval_sums(places, spans, "x", "lo", "hi", value)
    assert sorted(got.collect()) == sorted(joined.select(*got.columns).collect())


@pytest.mark.parametrize("name", ["join_interval", "join_interval_wide", "interval_index"])
def test_counts_of_intervals_join_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(spatial, "interval_join", lambda *_: pytest.fail("pairs were joined"))
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_fallback_counts_without_a_window_over_pairs(spark):
    schema = "id long, x double, y double, sqm double"
    targets, others = (spark.createDataFrame(points(n, s), schema).select("id", "x", "y") for n, s in ((40, 1), (150, 2)))
    want = spatial.with_fallback(spatial.radius_join(targets, others, 300), targets, others, 5).collect()
    got = fields.radius_or_nearest(targets, others, 300, 5)
    assert "Window" not in fields.radius_or_nearest(targets.limit(0), others, 300, 5)._jdf.queryExecution().toString()
    assert sorted(got.collect()) == sorted(want)


@pytest.mark.parametrize("epsilon", [60.0, 200.0, 900.0])
def test_links_connect_what_pairs_within_reach_connect(spark, epsilon):
    rows = spark.createDataFrame([(*p, "ab"[p[0] % 2] if p[0] % 7 else None) for p in points(220, 5)], "id long, x double, y double, sqm double, block string")
    edges, links = spatial.epsilon_edges(rows, epsilon), fields.reach_links(rows, epsilon)
    assert sorted(clustering.components(rows, links).collect()) == sorted(clustering.components(rows, edges).collect())
    inner = edges.where(F.col("a_block").eqNullSafe(F.col("b_block")))
    assert sorted(clustering.components(rows, fields.reach_links(rows, epsilon, by="block")).collect()) == sorted(clustering.components(rows, inner).collect())
    old, new = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    found = clustering.components(old, fields.reach_links(old, epsilon))
    assert sorted(clustering.components_extended(found, new, clustering.links_added(old, new, epsilon)).collect()) == sorted(clustering.components(rows, edges).collect())


def test_links_are_few_in_a_crowd(spark):
    crowd = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    assert fields.reach_links(crowd, 50).count() < 3 * 400  # all 79,800 pairs are within reach


@pytest.mark.parametrize("piece", [fields.PIECE, 60])
def test_medians_are_those_of_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(fields, "PIECE", piece)
    schema = "id long, x double, y double, sqm double"
    targets, others = points(40, 1, 100), points(150, 2)
    got = fields.distance_medians(spark.createDataFrame(targets, schema), spark.createDataFrame(others, schema), 500, 2.0, "sqm").collect()
    want = {}
    for i, x, y, _ in targets:
        near = sorted((q, j, 0 if j == i else 1 / max((x - u) ** 2 + (y - v) ** 2, 100.0)) for j, u, v, q in others if None not in (x, u) and (x - u) ** 2 + (y - v) ** 2 <= 500**2)
        total, grown = sum(w for *_, w in near), 0.0
        for q, _, w in near:
            grown += w
            if grown >= total / 2 * (1 - 1e-12):
                want[i] = (len(near), q)
                break
    assert {r["id"]: (r["found"], r["median"]) for r in got} == want


def test_medians_and_grids_have_no_row_a_pair(spark, monkeypatch):
    monkeypatch.setattr("compval.operators.spatial.radius_join", lambda *_, **__: pytest.fail("pairs were joined"))
    rows = spark.createDataFrame([(str(i), 50.0 * i, 0.0, 100.0, 1e5 + i) for i in range(30)], "id string, x double, y double, wohnflaeche double, marktwert double")
    assert predictors.WeightedAverage(median=True).train(rows).predict(rows.drop("marktwert")).where("pred_sqm is null").isEmpty()
    assert predictors.LearningDully(steps=3).errors(rows).count() == 3


def test_guards_join_what_may_pass_alone(spark, monkeypatch):
    rnd = random.Random(8)
    some = lambda *xs: rnd.choice(xs)
    rows = [(f"{i:03}", float(rnd.randint(0, 300)), float(rnd.randint(0, 300)), some("Reihenhaus", "Eigentumswohnung", "Mehrfamilienhaus", None), some(0.0, -0.0, 3.0, None), some(50.0, 90.0, 170.0), some(1930, 1980, None), 1e5 + i) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, x double, y double, objektunterart string, regiotyp double, wohnflaeche double, baujahr int, marktwert double")
    train, test = df.where("id >= '020'"), df.where("id < '050'")  # some are on both sides
    guards = D.Guards(regiotyp=0, objektunterart_category=0, wohnflaeche=0, baujahr=0)
    for piece, more in ((fields.PIECE, {}), (40, {"most_similar_by_category": {1: 2, 3: 4}}), (fields.PIECE, {"most_similar": 3})):
        monkeypatch.setattr(fields, "PIECE", piece)
        model = predictors.WeightedAverage(D.filtered(guards, D.Expert()), radius=120, fallback=None, **more).train(train)
        want = {r["id"]: r["pred_sqm"] for r in model._prices(model.neighbours(test)).collect()}
        with monkeypatch.context() as m:
            m.setattr(predictors.WeightedAverage, "_pairs", lambda *_: pytest.fail("all pairs were joined"))
            got = {r["id"]: r["pred_sqm"] for r in model.predict(test).collect()}
        assert set(want) <= set(got) and len(want) > 20
        assert {i: got[i] for i in want} == pytest.approx(want, rel=1e-9, nan_ok=True)


@pytest.mark.parametrize("piece", [fields.PIECE, 9])
def test_range_sums_are_those_of_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(fields, "PIECE", piece)
    monkeypatch.setattr(spatial, "range_join", lambda *_: pytest.fail("pairs were joined"))
    rnd = random.Random(4)
    span = lambda: (lambda lo, w: (lo, lo + w))(float(rnd.randint(-500, 500)), 2.0 ** rnd.randint(-3, 12))
    rects = [(i, *span(), *span()) for i in range(60)] + [(90, 0.0, 0.0, 0.0, 9.0), (91, None, 1.0, 0.0, 1.0), (92, -1e15, 1e15, -1.0, 1.0), (92, -9.0, 99.0, -99.0, 9.0)]
    pts = [(i, float(rnd.randint(-600, 600)), float(rnd.randint(-60, 60))) for i in range(150)] + [(200, None, 1.0), (201, 0.0, 0.0), (202, 0.0, 0.0)]
    a, b = spark.createDataFrame(rects, "r int, xl double, xh double, yl double, yh double"), spark.createDataFrame(pts, "p int, x double, y double")
    got = fields.range_sums(a, b, ("xl", "xh"), ("yl", "yh"), "x").select("r", "xl", "n", "total").collect()
    want = []
    for r, xl, xh, yl, yh in rects:
        held = [x for _, x, y in pts if None not in (xl, x) and xl <= x < xh and yl <= y < yh]
        if held:
            want.append((r, xl, len(held), sum(held)))
    assert sorted(map(tuple, got)) == sorted(want)
    assert fields.range_sums(a.limit(0), b, ("xl", "xh"), ("yl", "yh"), "x").count() == 0
