"""What the third round's findings were about."""

from itertools import product

from pyspark.sql import functions as F

from compval import queries
from compval.functions import dissimilarity as D
from compval.llm import extraction
from compval.operators import evolution, fields, predictors, spatial
from compval.operators.spatial import prefixed
from compval.schema import FEATURES, completed

SF = "/root/testdata/sf0.001"


def records(spark):
    """Kinds, areas, lots and years around the bounds of their categories, nulls too."""
    kinds, sizes = [None, "Einfamilienhaus", "Doppelhaushaelfte", "Eigentumswohnung", "Mehrfamilienhaus", "?"], [None, 39.0, 95.0, 300.0]
    rows = [(f"{i:03}", 10.0 * i, 0.0, kind, size, size and size * 6, year, 1 + i % 5, i % 3 == 0) for i, (kind, size, year) in enumerate(product(kinds, sizes, [None, 1930, 1975]))]
    return completed(spark.createDataFrame(rows, "id string, x double, y double, objektunterart string, wohnflaeche double, grundstuecksgroesse double, baujahr int, ausstattung int, keller boolean"))


def test_what_a_record_gives_is_derived_once_and_gives_the_same(spark):
    rows = D.derived(records(spark))
    pairs = prefixed(rows, "t_").crossJoin(prefixed(rows, "n_"))
    for guards in (queries.GUARDED, D.EXPERT_GUARDS):
        a, b = (D.Filtered(guards, D.Expert(ready=ready), ready)("t_", "n_") for ready in (False, True))
        both = pairs.select(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"), F.count(F.when(F.col("a").eqNullSafe(F.col("b")), 1)).alias("same"), F.count(F.when(F.col("b") < D.INF, 1)).alias("passed")).first()
        assert both["n"] == both["same"] and 72 <= both["passed"] < both["n"]


def test_pairs_are_priced_without_the_kinds_of_their_records(spark):
    for name in ("dissim_filtered", "dissim_expert"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "t__object" in plan or "t__house" in plan, name
        assert "t_objektunterart" not in plan, name
        assert plan.count("REPARTITION_BY_NUM") >= 2, name


def test_nearest_in_tiles_are_those_of_the_join(spark):
    """Ties, nulls, targets that are others too, and ones far from all others."""
    places = [(f"o{i:03}", float(i * 37 % 60), float(i * 53 % 60), 900.0 + i % 7, None if i % 5 == 0 else float(i % 9)) for i in range(300)]
    others = completed(spark.createDataFrame(places, "id string, x double, y double, sqm double, zustand double").repartition(3))
    rows = [*places[:60], ("t1", 30.5, 29.5, 1.0, 2.0), ("t2", 500.0, 10.0, 1.0, 2.0), ("t3", -200.0, -200.0, 1.0, None), ("t4", None, 3.0, 1.0, 2.0)]
    targets = completed(spark.createDataFrame(rows, "id string, x double, y double, sqm double, zustand double"))
    for k in (1, 7):
        cols = ["t_id", "t_zustand", "n_id", "n_sqm", "n_zustand"]
        want, got = {}, {}
        for found, df in ((want, spatial.knn_join(targets, others, k)), (got, fields.nearest_rows(targets, others, k, ["x", "zustand"], ["x", "zustand", "sqm"]))):
            for r in df.select(*cols).collect():
                found.setdefault(r["t_id"], set()).add(tuple(r))
        assert len([i for i, pairs in got.items() if len(pairs) == k]) >= 50
        assert {"t2", "t3", "t4"}.isdisjoint(got)
        assert all(got[i] == want[i] for i in got if len(got[i]) == k)
    assert fields.nearest_rows(targets, others.limit(5), 7, [], ["sqm"]) is None

    for guards in (None, D.Guards()):
        d = D.lp(2.0, {"zustand": (0.0, 0.5), "x": (0.0, 1.0)})
        model = predictors.WeightedAverage(d if guards is None else D.filtered(guards, d), k=7, most_similar=3).train(others.withColumn("marktwert", F.col("sqm") * 50).withColumn("wohnflaeche", F.lit(50.0)))
        asked = targets.withColumn("wohnflaeche", F.lit(50.0))
        by_rounds = model._prices(model._pairs(model._hidden(asked)))
        want = {r["id"]: r["pred_sqm"] for r in by_rounds.collect()}
        got = {r["id"]: r["pred_sqm"] for r in model.predict(asked).collect() if r["pred_sqm"] is not None}
        assert want.keys() == got.keys() and "t3" in got and all(abs(want[i] - got[i]) < 1e-9 for i in want)
    assert D.columns_of(D.lp(2.0, {"x": (0.0, 1.0)})) == ["x"] and D.columns_of(D.filtered(D.Guards(days=3), D.lp())) is None


def test_the_first_genome_takes_its_nearest_from_tiles(spark):
    found = evolution.lp_predictor(evolution.lp_genome(), {f: (0.0, 1.0) for f in FEATURES})
    assert found.k == 100 and D.columns_of(found.dissimilarity) == []


def test_suffixes_in_order_tell_what_pages_repeat(spark):
    """Runs go over batches and ranges; a string that one page repeats is none."""
    rows = [("h", page, [(0, 1, head) for head in heads]) for page, heads in [(5, [1, 1, 2, 9]), (6, [2, 3]), (7, [2, 4, 4]), (8, [9])]]
    rows += [("g", 5, [(0, 1, 3)]), ("g", 9, [(0, 1, 1)])] + [("h", 100 + i, [(0, 1, 77)]) for i in range(50)]
    streams = spark.createDataFrame(rows, "host string, page long, heads array<struct<start:int,stop:int,head:long>>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = extraction.repeated(streams)
        assert {tuple(r) for r in found.collect()} == {("h", 2), ("h", 9), ("h", 77)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(host" in plan and "Sort [host" in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
