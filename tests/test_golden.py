"""Worked examples and invariants."""

import math
import random
from collections import defaultdict
from dataclasses import replace
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compval.functions import costs as C
from compval.functions import dissimilarity as D
from compval.functions import scalars as S
from compval.operators import aggregates, cleaning, clustering, environment, evolution, features, normalizers, predictors, spatial, splits
from compval.plans import driver
from compval.schema import FEATURES, completed
from compval.sources import readers, sinks
from compval.sources.filters import compiled


def rows(spark, *records):
    keys = {k: v for r in records for k, v in r.items()}
    kinds = {str: "string", int: "int", float: "double", bool: "boolean", date: "date"}
    schema = ", ".join(f"{k} {kinds[type(next(r[k] for r in records if r.get(k) is not None))]}" for k in keys)
    return completed(spark.createDataFrame([tuple(r.get(k) for k in keys) for r in records], schema))


def points(spark, xs, prices=None, **more):
    prices = prices or [1.0] * len(xs)
    return aggregates.with_sqm(rows(spark, *[{"id": f"{i:03}", "x": float(x), "y": float(y), "marktwert": float(p), "wohnflaeche": 1.0, **more} for i, ((x, y), p) in enumerate(zip(xs, prices))]))


@pytest.mark.parametrize(
    "key,seed,byte",
    [
        ("610ce9d3d1a638258e871b95", "seeed", 227),
        ("abcdef1234567890abcdef12", "42", 81),
        ("103456107ab5ebc42e4ea103", "dnn-ea-cbr-los-randomness-is-deterministic", 238),
        ("1303abec1032cdf442323e20", "hund sind able(n/c)kend", 26),
        ("123cde212376abc125666666", "numberphile", 155),
    ],
)
def test_hash_split_key(spark, key, seed, byte):
    assert spark.range(1).select(S.hash_byte(seed, F.lit(key))).first()[0] == byte


def expert_pair(spark, a, b):
    base = {"micro_all": 0.0, "x": 0.0}
    left, right = ({**base, **r, "id": i} for i, r in (("a", a), ("b", b)))
    df = rows(spark, left, right)
    pair = spatial.prefixed(df.where("id = 'a'"), "t_").join(spatial.prefixed(df.where("id = 'b'"), "n_"), F.lit(True))
    one, two = D.Expert().parts("t_", "n_")
    return pair.select(one, two, 1 / D.Expert()("t_", "n_")).first()


def macro(v):
    return {"macro_social_status": v, "macro_economic_status": v, "macro_market_dynamics": v}


def test_expert_of_flats(spark):
    a = {"objektunterart": "Eigentumswohnung", "baujahr": 1990, "wohnflaeche": 100.0, "y": 0.0, "anzahl_stellplaetze": 1, "anzahl_zimmer": 3.0, "verwendung": "own", "keller": False, "micro_all": 50.0, **macro(50.0)}
    b = {"objektunterart": "Eigentumswohnung", "baujahr": 2021, "wohnflaeche": 120.0, "y": 1000.0, "anzahl_stellplaetze": 2, "anzahl_zimmer": 4.5, "verwendung": "both", "keller": True, "micro_all": 100.0, **macro(100.0)}
    assert list(expert_pair(spark, a, b)) == pytest.approx([48.875, 100 / 3, 47.32083], abs=1e-4)


def test_expert_of_houses(spark):
    a = {"objektunterart": "Einfamilienhaus", "baujahr": 1949, "wohnflaeche": 110.0, "grundstuecksgroesse": 100.0, "y": 0.0, "anzahl_stellplaetze": 1, "anzahl_zimmer": 5.0, "verwendung": "own", "keller": True, "micro_all": 100.0, **macro(100.0)}
    b = {"objektunterart": "Doppelhaushaelfte", "baujahr": 1953, "wohnflaeche": 140.0, "grundstuecksgroesse": 230.0, "y": 4000.0, "anzahl_stellplaetze": 3, "anzahl_zimmer": 6.0, "verwendung": "own", "keller": False, "micro_all": 100.0, **macro(90.0)}
    assert list(expert_pair(spark, a, b)) == pytest.approx([78.8, 50.0, 75.92], abs=1e-4)


def test_weighted_mean_and_median(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 0.0)], "v double, w double")
    assert df.agg(aggregates.weighted_mean(F.col("v"), F.col("w"))).first()[0] == pytest.approx(4 / 3)
    median = lambda ws: aggregates.weighted_median(spark.createDataFrame([(1, float(i + 1), float(w)) for i, w in enumerate(ws)], "g int, v double, w double"), ["g"], "v", "w", "m").first()["m"]
    assert median([2, 1, 0]) == 1 and median([0, 0, 1]) == 3 and median([0, 0, 0]) == 1


def test_radius_predictor(spark):
    df = points(spark, [(0, 0), (0, 1), (0, 2)], [1, 42, 4])
    model = predictors.WeightedAverage(D.constant(1.0), radius=1.0, fallback=None)
    out = driver.leave_one_out(model, df).orderBy("id")
    assert [r["pred_sqm"] for r in out.collect()] == [42.0, 2.5, 42.0]


def test_sweep(spark):
    df = points(spark, [(0, 0), (1, 2), (3, 3)])
    found = defaultdict(set)
    for r in spatial.radius_join(df, df, 3, exclude_self=True).collect():
        found[r["t_id"]].add(r["n_id"])
    assert found == {"000": {"001"}, "001": {"000", "002"}, "002": {"001"}}


def test_joins_against_brute_force(spark):
    rnd = random.Random(3)
    xs = [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(60)]
    df = points(spark, xs)
    d2 = lambda i, j: (xs[i][0] - xs[j][0]) ** 2 + (xs[i][1] - xs[j][1]) ** 2
    got = {(r["t_id"], r["n_id"]) for r in spatial.radius_join(df, df, 17.0).collect()}
    assert got == {(f"{i:03}", f"{j:03}") for i in range(60) for j in range(60) if d2(i, j) <= 17.0**2}
    near = {(r["t_id"], r["n_id"], r["knn_rank"]) for r in spatial.knn_join(df, df, 4, radius=1.0).collect()}
    assert near == {(f"{i:03}", f"{j:03}", k) for i in range(60) for k, j in enumerate(sorted(range(60), key=lambda j: (d2(i, j), j))[:4], 1)}
    few = {(r["t_id"], r["n_id"], r["knn_rank"]) for r in spatial.knn_join(df, df.limit(3), 10).collect()}
    assert len(few) == 180


def test_interval_join(spark):
    rnd = random.Random(4)
    ps, ivs = [rnd.uniform(0, 100) for _ in range(80)], [(lo := rnd.uniform(0, 100), lo + rnd.choice([0, 1, 30])) for _ in range(30)]
    a = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    b = spark.createDataFrame([(j, lo, hi) for j, (lo, hi) in enumerate(ivs)], "j int, lo double, hi double")
    got = {(r["i"], r["j"]) for r in spatial.interval_join(a, b, "p", "lo", "hi", 7.0).collect()}
    assert got == {(i, j) for i, p in enumerate(ps) for j, (lo, hi) in enumerate(ivs) if lo <= p < hi}


def test_environment_of_a_single_neighbour(spark):
    df = points(spark, [(0, 0), (3, 4)], [4.2, 0.05])
    assert [r["u"] for r in environment.environment(df).collect()] == pytest.approx([4.15**2] * 2)
    assert environment.environment(points(spark, [(0, 0)])).first()["u"] == 0.0


def test_capped_cost(spark):
    df = points(spark, [(0, 0), (0, 1), (0, 2)], [10, 20, 10.5]).withColumn("u", F.lit(0.0))
    costs = {(r["a_id"], r["b_id"]): r["cost"] for r in clustering.edges_with_cost(df, 5, C.capped(C.discrete(), 0.1)).collect()}
    assert costs == {("000", "001"): math.inf, ("001", "002"): math.inf, ("000", "002"): 1.0}


def test_guards_and_missing_values(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, 1), (1, 2), (1, 4)], "a int, b int")
    assert [r[0] for r in df.select(D.within(F.col("a"), F.col("b"), 1)).collect()] == [True, False, False, True, False]


def test_zip_growth(spark):
    df = rows(spark, {"id": "a", "plz": "1", "marktwert": 100.0, "wertermittlungsstichtag": date(2019, 1, 2)})
    zips = spark.createDataFrame([("1", 100 * (1.2**5 - 1))], "plz string, percent double")
    assert normalizers.ZipGrowth(zips).normalise(df).first()["marktwert"] == pytest.approx(144.0)


def test_normalisation_is_undone(spark):
    rnd = random.Random(1)
    df = rows(spark, *[{"id": str(i), "marktwert": rnd.uniform(1e4, 1e6) if i % 7 else None, "ags0": str(i % 3), "wertermittlungsstichtag": date(2008 + i % 12, 1 + i % 12, 3)} for i in range(40)])
    for n in (normalizers.Identity(), normalizers.Handcrafted(), normalizers.Regression().fit(df), normalizers.Pipeline([normalizers.Handcrafted(), normalizers.Regression()]).fit(df)):
        back = {r["id"]: r["marktwert"] for r in n.denormalise(n.normalise(df)).collect()}
        for r in df.collect():
            assert back[r["id"]] == (None if r["marktwert"] is None else pytest.approx(r["marktwert"]))


def test_constant_prices_give_constant_predictions(spark):
    rnd = random.Random(2)
    df = points(spark, [(rnd.uniform(0, 20), rnd.uniform(0, 20)) for _ in range(40)], [7.0] * 40)
    for model in (predictors.dully(radius=5.0), predictors.WeightedAverage(k=3, median=True), predictors.WeightedAverage(D.lp(1.5), most_similar=2)):
        assert {round(r["pred_sqm"], 9) for r in driver.leave_one_out(model, df).collect()} == {7.0}


def test_evaluation_errors(spark):
    pairs = lambda *r: spark.createDataFrame(list(r), "sqm double, pred_sqm double")
    for bad in ([], [(None, 1.0)], [(2.0, float("nan"))], [(1.0, 2.0)]):
        with pytest.raises(ValueError):
            aggregates.evaluate(pairs(*bad))
    k = aggregates.evaluate(pairs((10.0, 11.0), (10.0, 8.0), (10.0, 10.0))).first()
    assert (k["mae"], k["mape"], k["median_ape"], k["pe10"]) == pytest.approx((1.0, 0.1, 0.2, 2 / 3))


@settings(max_examples=8, deadline=None)
@given(n=st.integers(0, 40), ratio=st.sampled_from([0.0, 0.3, 0.8, 1.0]))
def test_splits_keep_every_row_once(spark, n, ratio):
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 24, "0").alias("id"), F.when(F.col("id") % 3 > 0, F.date_add(F.lit("2015-01-01").cast("date"), F.col("id").cast("int"))).alias("wertermittlungsstichtag"))
    for a, b in (splits.by_date_ratio(df, ratio), splits.by_hash(df, ratio, "s")):
        left, right = [r["id"] for r in a.collect()], [r["id"] for r in b.collect()]
        assert sorted(left + right) == [f"{i:024}" for i in range(n)]
        assert len(left) == (n if n <= 1 else int(n * ratio + 1e-9))
    a, b = splits.at_date(df, "2015-01-10")
    assert a.count() + b.count() == n


def test_ordered_rewrites_are_composed():
    rewrites = [("A", "B"), ("B", "C"), ("C", "A"), ("X", "Y"), ("X", "Z")]

    def one_by_one(v):
        for old, new in rewrites:
            v = new if v == old else v
        return v

    table = cleaning.composed(rewrites)
    assert {v: table.get(v, v) for v in "ABCXYZQ"} == {v: one_by_one(v) for v in "ABCXYZQ"}


def test_filter_documents(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0], ("x",)), (None, None, None)], "a int, p array<double>, s struct<t:string>")
    count = lambda doc: df.where(compiled(doc)).count()
    assert count({"a": {"$ne": 1}}) == 1 and count({"a": {"$ne": 2}}) == 2 and count({"p.0": {"$gt": 4}}) == 1
    assert count({"s.t": "x"}) == 1 and count({"a": {"$exists": False}}) == 1 and count({"$nor": [{"a": 1}]}) == 1
    assert count({"a": {"$in": [1, None]}}) == 2
    with pytest.raises(ValueError):
        compiled({"a": {"$near": 1}})


def test_flat_record(spark):
    doc = '{"_id":"AB","marktwert":285000,"plane_location":[3333200.5,5709890.8],"kurzgutachten":{"objektangabenWohnflaeche":176,"objektangabenZustand":"gut","objektangabenAnzahlGaragen":3,"objektangabenAnzahlCarport":1,"objektangabenStellplaetzeInnen":9,"objektangabenAnzahlStellplaetzeInnen":2,"objektangabenUnterkellerungsgrad":"75%","vermietbarkeit":"ja","drittverwendungsfaehigkeit":"nein"},"objektunterart":"Einfamilienhaus","scores":{"ALL":74}}'
    r = readers.flat_record(spark.read.json(spark.sparkContext.parallelize([doc]))).first()
    assert (r["id"], r["marktwert"], r["x"], r["wohnflaeche"], r["zustand"], r["anzahl_stellplaetze"]) == ("ab", 285000.0, 3333200.5, 176.0, 4, 6)
    assert (r["unterkellerungsgrad"], r["vermietbarkeit"], r["drittverwendungsfaehigkeit"], r["objektunterart"], r["micro_all"], r["plz"]) == (0.75, True, False, "Einfamilienhaus", 74.0, None)


def test_offers(spark, tmp_path):
    (tmp_path / "o.csv").write_text(";".join(readers.OFFER_COLUMNS) + "\n1;kauf;2019-05-06;Weg 1;12345;Ort;Kreis;80,5;200000;0;1990;3;1;gut;normal;ETW-Whg;\n2;tausch;2019-05-06;;1;;;1;1;0;;;;;;;\n3;miete;x;;12345;;;70;900;01;;;;;;EFH;\n")
    out = cleaning.parsed_offers(readers.read_offers(spark, str(tmp_path / "o.csv"))).orderBy("angebot_id").collect()
    assert [(r["offertype"], r["wohnflaeche"], r["objektunterart"], r["ausstattung_note"], r["zustand"], r["realistic_costs"]) for r in out] == [("Sell", 80.5, "Eigentumswohnung", 4, "mittel", True), ("Rent", 70.0, "Einfamilienhaus", None, None, False)]
    assert out[0]["address"] == "Weg 1, 12345 Ort" and out[1]["address"] is None and out[0]["wertermittlungsstichtag"].hour == 23
    assert cleaning.relevant_offers(cleaning.parsed_offers(readers.read_offers(spark, str(tmp_path / "o.csv")))).count() == 1


def test_predictions_and_partitions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "id string, pred_marktwert double")
    for key in ("one", "two", "one"):
        sinks.write_predictions(df, str(tmp_path), key)
    assert [tuple(r) for r in readers.Store(str(tmp_path)).predictions(spark, ["one", "two"]).collect()] == [("a", 1.0, 1.0)]
    sinks.write_partition(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, block string"), str(tmp_path / "p"), epsilon=300)
    assert sorted(r["ids"] for r in spark.read.json(str(tmp_path / "p")).collect()) == [["a", "b"], ["c"]]
    (tmp_path / "q.json").write_text('{"partition": [["a", "b"], ["c"]], "epsilon": 1.0}')
    assert {tuple(r) for r in readers.read_partition(spark, str(tmp_path / "q.json")).collect()} == {(0, "a"), (0, "b"), (1, "c")}
    sinks.write_result(df, str(tmp_path / "deep/r.json"))
    assert (tmp_path / "deep/r.json").exists()


def brute_contract(ids, reach, cost):
    blocks = [{i} for i in ids]
    while True:
        best = None
        for i, a in enumerate(blocks):
            for b in blocks[i + 1 :]:
                if any((min(x, y), max(x, y)) in reach for x in a for y in b):
                    key = (sum(2 * cost(x, y) for x in a for y in b), *sorted((min(a), min(b))))
                    if key[0] < -clustering.EPS and (best is None or key < best[0]):
                        best = (key, a, b)
        if best is None:
            return {i: min(b) for b in blocks for i in b}
        _, a, b = best
        blocks = [x for x in blocks if x is not a and x is not b] + [a | b]


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 10_000))
def test_contraction_leaves_no_negative_pair(seed):
    rnd = random.Random(seed)
    ids = [f"{i:02}" for i in range(rnd.randint(1, 9))]
    costs = {(a, b): rnd.choice([-3.0, -2.0, -1.0, 1.0, 2.0, 0.5]) for a in ids for b in ids if a < b}
    of = lambda x, y: costs[min(x, y), max(x, y)]
    reach = {p for p in costs if rnd.random() < 0.6}
    got = clustering.contract(ids, reach, of)
    assert got == brute_contract(ids, reach, of)
    total = lambda blocks: sum(2 * c for (a, b), c in costs.items() if blocks[a] == blocks[b])
    stable = clustering.make_one_stable(got, reach, of)
    assert set(stable) == set(ids) and total(stable) <= total(got) + 1e-9


def test_clusters_hang_together(spark):
    df = points(spark, [(0, 0), (0, 1), (0, 2), (50, 50)], [10, 10, 10, 10])
    found = clustering.cluster(df, 1.5, C.negative_discrete())
    assert {r["id"]: r["block"] for r in found.collect()} == {"000": "000", "001": "000", "002": "000", "003": "003"}
    assert all(r["connected"] for r in clustering.blocks_connected(found, spatial.epsilon_edges(df, 1.5)).collect())
    apart = spark.createDataFrame([("000", "p"), ("002", "p"), ("001", "q"), ("003", "q")], "id string, block string")
    assert not any(r["connected"] for r in clustering.blocks_connected(apart, spatial.epsilon_edges(df, 1.5)).collect())
    assert {r["cost"] for r in clustering.total_cost(found, df, C.negative_discrete()).collect()} == {-6.0, 0.0}


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 1000))
def test_genomes_keep_their_bounds(seed):
    rng = random.Random(seed)
    g = evolution.lp_genome()
    cfg = evolution.Mutation(rate=1.0, sigma=3.0, switch=0.5)
    for _ in range(5):
        h = g.mutate(rng, cfg)
        g = h.crossover(g.regenerate(rng), rng).step_from(g, 0.7)
        assert 0.1 <= g["exponent"].value <= 5 and all(0 <= w.value <= 1 for w in g["weights"])
        assert g.distance(g) == 0 and 0 <= g.distance(h) <= 1


def test_expert_genome_keeps_its_bounds_and_makes_a_predictor(spark):
    rng, g = random.Random(3), evolution.expert_genome()
    for _ in range(20):
        h = g.mutate(rng, evolution.Mutation(rate=1.0, sigma=2.0, switch=0.5))
        for (v, lo, hi), w in zip(evolution.GUARD_BOUNDS.values(), h["guards"]):
            assert lo <= w.inner.value <= hi
        assert 0 <= g.distance(h) <= 1
        g = g.crossover(h, rng)
    df = points(spark, [(0, 0), (0, 1), (5, 5)], [9.0, 9.0, 9.0], objektunterart="Eigentumswohnung")
    out = driver.leave_one_out(evolution.expert_predictor(g), df)
    assert {round(r["pred_sqm"], 9) for r in out.collect() if r["pred_sqm"] == r["pred_sqm"]} <= {9.0}


def test_cellar_share(spark):
    from compval.functions.enums import cellar_share

    df = spark.createDataFrame([("nicht unterkellert", "75%"), ("unterkellert", "75%"), (None, "5"), (None, None)], "k string, p string")
    assert [r[0] for r in df.select(cellar_share(F.col("k"), F.col("p"))).collect()] == [0, 75, None, None]


def test_mean_over_folds(spark):
    df = spark.createDataFrame([(0, 10.0, 11.0), (1, 10.0, 13.0)], "fold int, sqm double, pred_sqm double")
    assert aggregates.fold_mean(df).first()["mape"] == pytest.approx(0.2)


def test_fitness_sharing():
    a = evolution.Genome((("v", evolution.Bounded(0.0, 0.0, 1.0)),))
    b = evolution.Genome((("v", evolution.Bounded(0.1, 0.0, 1.0)),))
    c = evolution.Genome((("v", evolution.Bounded(0.2, 0.0, 1.0)),))
    assert evolution.shared_errors([1, 1, 1], [a, b, c], 0.5, 2)[1] == pytest.approx(1 + 2 * (1 - 0.04))


def test_search_finds_a_minimum():
    start = evolution.Genome((("v", evolution.Bounded(0.9, 0.0, 1.0)),))
    error = lambda gs: [abs(g["v"].value - 0.3) for g in gs]
    _, e, history = evolution.evolve(error, start, evolution.Config(population=8, generations=25, mutation=evolution.Mutation(rate=0.9)))
    assert e < 0.1 and history == sorted(history, reverse=True)
    assert evolution.local_search(error, start, 60, mutation=evolution.Mutation(rate=0.9))[1] < 0.1


def test_features(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    out = [r["v"] for r in features.scaled(df, ["v"], "symmetric").collect()]
    assert out == [-1.0, 0.0, 1.0, None]
    pois = spark.createDataFrame([({"a": [1.0], "PlaceCityDriving-car": [2.0]},)], "p map<string,array<double>>")
    got = pois.select(features.padded_distances(F.col("p"), 3)).first()[0]
    assert got == {"a": [1.0, 10000.0, 10000.0]}
    _, k = features.box_cox(spark.range(1, 200).select(F.exp(F.col("id") / 40).alias("v")), "v")
    assert abs(k) < 0.6


def test_stream(spark, tmp_path):
    from compval.streaming import prices

    df = rows(spark, {"id": "a", "x": 0.0, "y": 0.0, "marktwert": 3e5, "wohnflaeche": 100.0, "baujahr": 1990, "wertermittlungsstichtag": date(2019, 1, 1)}, {"id": "b", "marktwert": 1.0, "wohnflaeche": 100.0})
    df.write.parquet(str(tmp_path / "in"))
    stream = prices.normalised_stream(prices.cleaned_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("prices").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert [(r["id"], r["marktwert"]) for r in spark.table("prices").collect()] == [("a", 3e5)]


def market(spark, n, seed=1):
    rng = random.Random(seed)
    return points(spark, [(rng.uniform(0, 20_000), rng.uniform(0, 20_000)) for _ in range(n)], [rng.uniform(1, 9) for _ in range(n)])


def test_fitness_takes_all_rows_or_a_new_batch_a_call(spark):
    train, test = market(spark, 60), market(spark, 30, 2).withColumn("id", F.concat(F.lit("v"), "id"))
    seen = lambda f: (f([evolution.lp_genome()]), {r[0] for r in f.pairs.select("t_id").distinct().collect()})[1]
    assert len(seen(evolution.Fitness(train, test, batch=None))) == 30
    some = evolution.Fitness(train, test, batch=8)
    first, second = seen(some), seen(some)
    assert len(first) == len(second) == 8 and first != second


def lp_variant(radius=None, k=1, most_similar=None, weight=1.0, cap=None, **on):
    reach = evolution.Either(evolution.Bounded(radius or 10.0, 10.0, 10_000.0), evolution.Bounded(k, 1, 2000, True), radius is not None)
    most = evolution.Optional(evolution.Bounded(most_similar or 1, 1, 500, True), most_similar is not None)
    weights = tuple(evolution.Bounded(weight, 0.0, 1.0) for _ in FEATURES)
    guards = tuple(replace(w, on=name in on, inner=replace(w.inner, value=on.get(name, w.inner.value))) for name, w in zip(evolution.GUARD_BOUNDS, evolution.guard_weights()))
    parts = {**dict(evolution.lp_genome().parts), "reach": reach, "most_similar": most, "weights": weights, "guards": guards}
    return replace(evolution.lp_genome(cap_kilometres=cap), parts=tuple(parts.items()))


def predictor_mape(genome, train, test):
    out = evolution.lp_predictor(genome, D.min_max_scale(train)).train(train).predict(test)
    return out.agg(F.avg(F.coalesce(F.nanvl(F.abs(F.col("sqm") - F.col("pred_sqm")) / F.col("sqm"), F.lit(None)), F.lit(1.0)))).first()[0]


@pytest.mark.parametrize("batch", [None, 30])
def test_fitness_reaches_as_far_as_the_genomes(spark, batch):
    train, test = market(spark, 500), market(spark, 30, 2).withColumn("id", F.concat(F.lit("v"), "id"))
    genomes = [lp_variant(radius=9000.0), lp_variant(radius=7000.0, most_similar=7), lp_variant(k=300), lp_variant(k=450, most_similar=20)]
    want = [predictor_mape(g, train, test) for g in genomes]
    assert len({round(w, 9) for w in want}) == 4
    assert evolution.Fitness(train, test, batch)(genomes) == pytest.approx(want)


def homes(spark, n, seed=1):
    """Records with gaps in every part that guards and the expert similarity read."""
    rng = random.Random(seed)
    some = lambda v: None if rng.random() < 0.2 else v
    rows = []
    for i in range(n):
        area, price = rng.uniform(30, 200), rng.uniform(1e5, 9e5)
        kind = some(rng.choice(["Eigentumswohnung", "Einfamilienhaus", "Reihenhaus", "Mehrfamilienhaus"]))
        day = some(date(2010 + rng.randrange(10), 1 + rng.randrange(12), 1 + rng.randrange(28)))
        numbers = [some(float(rng.randrange(k))) for k in (50, 6, 5, 4, 30)]
        rows.append((f"{seed}-{i:04}", rng.uniform(0, 30_000), rng.uniform(0, 30_000), area, price, price / area, some(1950 + rng.randrange(60)), some(rng.uniform(100, 900)), kind, day, *numbers, some(rng.choice("ab")), some(rng.random() < 0.5), some(float(rng.randrange(1, 7)))))
    names = "id string, x double, y double, wohnflaeche double, marktwert double, sqm double, baujahr int, grundstuecksgroesse double, objektunterart string, wertermittlungsstichtag date, regiotyp double, zustand double, ausstattung double, anzahl_stellplaetze double, balcony_area double, verwendung string, keller boolean, anzahl_zimmer double"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("median", [False, True])
def test_fitness_with_guards_and_a_cap(spark, median):
    train, test = homes(spark, 300), homes(spark, 25, 2)
    genomes = [
        lp_variant(radius=9000.0, baujahr=10.0, days=900, zustand=1),
        lp_variant(k=40, wohnflaeche=40.0, grundstuecksgroesse=200.0, objektunterart_category=0, regiotyp=9),
        lp_variant(k=60, cap=6.0, ausstattung=0, balcony_area=5.0, most_similar=4),
        lp_variant(radius=8000.0, cap=5.0, weight=0.0, most_similar=12),
    ]
    got = evolution.Fitness(train, test, batch=None, median=median)(genomes)
    mape = lambda g: evolution.lp_predictor(g, D.min_max_scale(completed(train)), median).train(train).predict(test).agg(F.avg(F.abs(F.col("sqm") - F.col("pred_sqm")) / F.col("sqm"))).first()[0]
    assert len({round(x, 9) for x in got}) == 4
    assert got == pytest.approx([mape(g) for g in genomes])


def test_fitness_of_expert_genomes(spark):
    train, test, rng = homes(spark, 200), homes(spark, 20, 2), random.Random(5)
    off = lambda g: replace(g, parts=tuple((k, tuple(replace(w, on=False) for w in v) if k == "guards" else v) for k, v in g.parts))
    unweighed = lambda g: replace(g, parts=tuple((k, tuple(replace(w, value=0.0) for w in v) if k == "weights" else v) for k, v in g.parts))
    start = evolution.expert_genome()
    genomes = [off(start), unweighed(off(start)), start.mutate(rng, evolution.Mutation(rate=0.5, switch=0.3))]
    mape = lambda g: evolution.expert_predictor(g).train(train).predict(test).agg(F.avg(F.abs(F.col("sqm") - F.col("pred_sqm")) / F.col("sqm"))).first()[0]
    got = evolution.Fitness(train, test, batch=None, expert=True)(genomes)
    assert got == pytest.approx([mape(g) for g in genomes])
    best, error, _ = evolution.evolve(evolution.Fitness(train, test, batch=None, expert=True), off(start), evolution.Config(population=4, generations=2))
    assert error <= got[0] + 1e-9 and set(dict(best.parts)) == set(dict(start.parts))


def test_fitness_at_the_level_of_a_normalizer(spark):
    class Doubling(normalizers.Normalizer):
        """Prices double with every year."""

        def factored(self, df):
            return df.withColumn("_factor", F.pow(F.lit(2.0), 2015 - F.coalesce(F.year("wertermittlungsstichtag"), F.lit(2015))))

    train, test, genome = homes(spark, 120), homes(spark, 20, 2), lp_variant(k=15)
    found = predictors.Normalizing(evolution.lp_predictor(genome, D.min_max_scale(completed(train))), Doubling()).train(train).predict(test)
    want = found.agg(F.avg(F.abs(F.col("marktwert") - F.col("pred_marktwert")) / F.col("marktwert"))).first()[0]
    assert evolution.Fitness(train, test, normalizer=Doubling())([genome]) == pytest.approx([want])
    assert evolution.Fitness(train, test)([genome]) != pytest.approx([want])


def test_expert_means_only_what_applies(spark):
    """Without weights: a flat has no lot and no cellar."""
    one = {"id": "a", "x": 0.0, "y": 0.0, "wohnflaeche": 100.0, "baujahr": 2000, "anzahl_stellplaetze": 1.0, "anzahl_zimmer": 3.0, "verwendung": "w", "grundstuecksgroesse": 5.0, "keller": True}
    df = spark.createDataFrame([{**one, "objektunterart": "Eigentumswohnung"}, {**one, "id": "b", "objektunterart": "Einfamilienhaus"}])
    df = completed(df)
    pairs = spatial.radius_join(df, df, 1.0).where("t_id = n_id")
    parts = D.Expert(weights=dict.fromkeys(evolution.PARTS, 0.0)).parts("t_", "n_")
    got = {r[0]: (r[1], r[2]) for r in pairs.select("t_id", *parts).collect()}
    # Year, area and distance agree; no location score; the house's lot and cellar agree.
    assert got["a"] == (75.0, 100.0) and got["b"] == (80.0, 100.0)


def test_crossover_keeps_the_mothers_exponent_and_ignored_guards_stay_off():
    rng = random.Random(2)
    genome = evolution.lp_genome(ignore_guards=True, most_similar_limit=3, exponent=1.5)
    for _ in range(20):
        genome = genome.regenerate(rng).mutate(rng, evolution.Mutation(rate=1.0, switch=1.0))
        assert all(w.value is None for w in genome["guards"])
        assert genome["exponent"].value == 1.5 and 1 <= genome["most_similar"].value <= 3
    mother, father = evolution.lp_genome().regenerate(rng), evolution.lp_genome().regenerate(rng)
    children = [mother.crossover(father, rng) for _ in range(20)]
    assert {c["exponent"] for c in children} == {mother["exponent"]} and len({c["weights"] for c in children}) > 1


def test_settings_from_json(tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"population": 7, "mutation": {"rate": 0.5}, "cap_kilometres": 4, "exponent": 2.5}')
    found = evolution.Config.load(str(path))
    assert found.population == 7 and found.mutation.rate == 0.5 and found.generations == 200 and found.replace_ratio == 0.85
    assert found.genome().cap_kilometres == 4 and found.genome()["exponent"].value == 2.5
    with pytest.raises(ValueError):
        evolution.Config(expert=True, ignore_guards=True).genome()


def test_fitness_counts_every_target(spark):
    """Few or no comparables within reach, the target itself among the training rows, and one target without a place."""
    train = market(spark, 60)
    other = market(spark, 20, 2).withColumns({"id": F.concat(F.lit("v"), "id"), "x": F.when(F.col("id") != "003", F.col("x"))})
    test = other.unionByName(train.limit(5))
    genomes = [lp_variant(radius=10.0), lp_variant(radius=3000.0, most_similar=3), lp_variant(k=4), lp_variant(k=12, most_similar=1)]
    got = evolution.Fitness(train, test, batch=None)(genomes)
    assert got == pytest.approx([predictor_mape(g, train, test) for g in genomes])


# ------------------------------------------------------------------ look-ups, editing, seeds
def placed_rows(spark, rows):
    return spark.createDataFrame(rows, "id string, x double, y double, sqm double")


def test_seed_genome_from_json(tmp_path):
    path = tmp_path / "seed.json"
    path.write_text('{"exponent": 99, "reach": {"right": 12.4}, "most_similar": null, "weights": [%s]}' % ", ".join(["0.25"] * 22))
    found = evolution.seeded(evolution.lp_genome(), str(path))
    assert found["exponent"].value == 5.0 and not found["reach"].is_left and found["reach"].right.value == 12
    assert found["most_similar"].value is None and {w.value for w in found["weights"]} == {0.25}
    path.write_text("{}")
    assert evolution.seeded(evolution.lp_genome(), str(path)) == evolution.lp_genome()


def test_known_prices_and_the_omniscient_dissimilarity(spark):
    rows = placed_rows(spark, [("a", 0.0, 0.0, 10.0), ("b", 1.0, 0.0, 13.0), ("c", 5.0, 0.0, None)])
    known = spatial.join_known_prices(rows.drop("sqm"), rows.where("sqm is not null"))
    assert {(r["id"], r["known_price"], r["in_prices"]) for r in known.collect()} == {("a", 10.0, True), ("b", 13.0, True), ("c", None, False)}
    pairs = spatial.radius_join(known, known, 100.0, "a_", "b_").withColumn("d", D.omniscient()("a_", "b_"))
    assert {(r["a_id"], r["b_id"]): r["d"] for r in pairs.collect()}["a", "b"] == 3.0
    out = features.with_prediction(rows, spark.createDataFrame([("a", 7.0)], "id string, pred_sqm double"))
    out = features.guessed_or_actual(out, "sqm", "cbr_price", "best")
    assert {(r["id"], r["cbr_price"], r["best"]) for r in out.collect()} == {("a", 7.0, 10.0), ("b", None, 13.0), ("c", None, None)}


def test_editing_a_clustering_and_what_it_costs(spark):
    rows = placed_rows(spark, [("a", 0.0, 0.0, 1.0), ("b", 0.0, 0.0, 2.0), ("c", 0.0, 0.0, 4.0), ("d", 0.0, 0.0, 8.0)]).selectExpr("*", "0.0D AS u")
    blocks = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, block string")
    assert sorted(map(tuple, clustering.added(blocks, spark.createDataFrame([("d", "r"), ("b", "q")], "id string, block string")).collect())) == [("a", "p"), ("b", "q"), ("c", "q"), ("d", "r")]
    cost = lambda a, b: D.sqm_price_difference()(a, b)
    total = lambda x: sum(r["cost"] for r in clustering.total_cost(x, rows, cost).collect())
    moves = spark.createDataFrame([("b", "q"), ("a", "new"), ("c", "q")], "id string, block string")
    got = {r["id"]: r["change"] for r in clustering.moving_cost(blocks, rows, moves, cost).collect()}
    for one, to in (("b", "q"), ("a", "new"), ("c", "q")):
        after = clustering.moved(blocks, spark.createDataFrame([(one, to)], "id string, block string"))
        assert got[one] == total(after) - total(blocks)
    assert clustering.merging_cost(blocks, rows, "p", "q", cost).first()["change"] == total(clustering.merged(blocks, "p", "q")) - total(blocks) == 2 * (9 + 4)


def test_nearest_where_some_have_half_a_place(spark):
    rows = [("a", 0.0, 0.0, 1.0), ("b", 3.0, 0.0, 1.0), ("c", 1.0, None, 1.0), ("d", None, 1.0, 1.0)]
    found = spatial.knn_join(placed_rows(spark, rows).where("id = 'a'"), placed_rows(spark, rows), 3)
    assert sorted((r["n_id"], r["knn_rank"]) for r in found.collect()) == [("a", 1), ("b", 2)]
    cut = spatial.knn_join(placed_rows(spark, rows).where("id = 'a'"), placed_rows(spark, [*rows, ("z", 1e9, 0.0, 1.0)]), 3, radius=5.0, rounds=2)
    assert sorted(r["n_id"] for r in cut.collect()) == ["a", "b"]


def test_difference_of_measures(spark):
    rows = [spark.createDataFrame([tuple(float(i + k) for i, _ in enumerate(aggregates.MEASURES))], ", ".join(f"{m} double" for m in aggregates.MEASURES)) for k in (5, 2)]
    assert set(aggregates.differences(*rows).first()) == {3.0}


# ------------------------------------------------------------------ names, vectors, folds, updates
def test_towns_and_a_file_of_rewrites(spark, tmp_path):
    path = tmp_path / "rewrites.json"
    path.write_text('[["A", "B"], ["B", "C"], ["Berlin, Stadt", "Berlin"]]')
    df = spark.createDataFrame([("Berlin", ""), ("Berlin", None), ("Köln", "Berlin"), ("x", "A"), ("Würzburg", "Würzburg Land")], "ort string, kreis string")
    out = cleaning.county_names(df, cleaning.load_rewrites(str(path)))
    assert [r["kreis"] for r in out.collect()] == ["Berlin", "Berlin", "Berlin", "C", "Würzburg Stadt"]
    assert [r["kreis"] for r in cleaning.county_names(df, []).collect()][:2] == ["Berlin, Stadt"] * 2


def test_attributes_of_stored_documents(spark):
    df = spark.sql("SELECT 'i' AS _id, named_struct('ALL', 3) AS scores, named_struct('ea-split201703-cleanv3', 5.0D) AS predictions, 7 AS other")
    assert features.with_attributes(df, ["id", "scores_all", "ea_japan", "other"]).first().asDict() == {"id": "i", "scores_all": 3, "ea_japan": 5.0, "other": 7}
    assert len(features.ATTRIBUTES) == 61


def test_vector_of_the_comparison(spark):
    whole = {"id": "a", "baujahr": 1990, "x": 1.0, "y": 2.0, "wohnflaeche": 50.0, "wertermittlungsstichtag": date(2015, 1, 11), "balcony_area": 3.0, "walking_distance": 4.0, "urbanity_score": 1, "floor_no": 5.0, "distance_elem_school": 6.0, "distance_jun_highschool": 7.0, "cbr_prediction": 100.0}
    got = features.comparison_vector(rows(spark, whole)).first()["vector"]
    assert got == [1990, 0, 1, 2, 50, 10, 2015, 1, 11, 3, 4, 1, 5, 6, 7, 2]
    with pytest.raises(Exception, match="unknown"):
        features.comparison_vector(rows(spark, whole).withColumn("baujahr", F.lit(None).cast("int"))).collect()


def test_a_model_is_fitted_for_each_fold(spark):
    df = spark.range(200).select(F.format_string("%03d", "id").alias("id"), F.col("id").cast("double").alias("v"), (F.col("id") * 3.0 + 10).alias("sqm"))
    out = features.cross_validated(df, ["v"])
    assert {r[0] for r in out.select("fold").distinct().collect()} == set(range(5)) and out.count() == 200
    assert aggregates.fold_mean(out).first()["mape"] < 1e-4
    # A fold that the others say nothing of shows that its own rows were not learnt from.
    odd = df.join(splits.by_fold(df).select("id", "fold"), "id").withColumn("sqm", F.when(F.col("fold") == 2, 5000.0).otherwise(100.0)).drop("fold")
    assert features.cross_validated(odd, ["v"]).where("fold = 2").agg(F.max("pred_sqm")).first()[0] < 1000


def test_deviations_that_cannot_be_had(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (4.0, None)], "sqm double, pred_sqm double")
    assert aggregates.deviation(df.limit(1), True, 1, strict=True).first()["mean"] == 0.5
    for relative, n in ((True, 2), (False, 1)):
        with pytest.raises(ValueError, match=f"{n} pairs"):
            aggregates.deviation(df, relative, 1, strict=True)


def test_updates_overwrite(spark):
    df = spark.createDataFrame([("a", 1.0, "k"), ("b", 2.0, "l")], "id string, u double, kreis string")
    new = spark.createDataFrame([("a", 9.0, 1), ("z", 5.0, 2)], "id string, u double, n int")
    assert {tuple(r) for r in sinks.updated(df, new).collect()} == {("a", 9.0, "k", 1), ("b", 2.0, "l", None)}
