"""Group quantiles over many tasks, and a search that stops and goes on."""

import random

import pytest
from pyspark.sql import functions as F

from compval.durable import Journal
from compval.functions import dissimilarity as D
from compval.operators import aggregates, evolution
from compval.schema import completed


def reached(rows, goal):
    """By group the smallest value where the weight so far satisfies goal."""
    out = {}
    for g in {r[0] for r in rows}:
        mine = sorted((v, w) for h, v, w in rows if h == g)
        total, cum = sum(w for _, w in mine), 0.0
        for v, w in mine:
            cum += w
            if goal(cum, total):
                out[g] = v
                break
    return out


def test_one_group_of_nearly_all_rows(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 50 else rnd.choice(["a", "b", None]), float(rnd.randrange(700)), float(rnd.randrange(1, 9))) for i in range(6000)] + [("one", 3.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    want = reached(rows, lambda cum, total: cum >= total / 2)
    assert dict(aggregates.weighted_median(df, ["g"], "v", "w", "m").collect()) == want
    spread = df.groupBy("g", "v").agg(F.sum("w")).repartitionByRange("g", "v").select("g", F.spark_partition_id().alias("p")).where("g = 'hot'").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert spread.count() > 1
        assert dict(aggregates.weighted_median(df, ["g"], "v", "w", "m").collect()) == want  # over several ranges
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_quantiles_of_odd_input(spark):
    schema = "g int, v double, w double"
    made = lambda rows: dict(aggregates.weighted_median(spark.createDataFrame(rows, schema), ["g"], "v", "w", "m").collect())
    assert made([]) == {}
    assert made([(1, 5.0, 1.0)] * 7 + [(1, 6.0, 1.0)]) == {1: 5.0}
    assert made([(1, 5.0, None)]) == {}
    assert made([(1, None, 1.0), (1, 2.0, 3.0)]) == {1: 2.0}


START = evolution.Genome((("a", evolution.Bounded(1.0, 0.0, 9.0)), ("b", evolution.Either(evolution.Bounded(2.0, 0.0, 5.0), evolution.Bounded(3, 1, 7, True))), ("c", (evolution.Optional(evolution.Bounded(4.0, 0.0, 8.0)), evolution.Optional(evolution.Bounded(1.0, 0.0, 2.0), False)))))


def off(genomes):
    return [abs(g["a"].value - 7) + abs(g["b"].left.value - 1) + sum(abs((w.value or 0.0) - 2) for w in g["c"]) for g in genomes]


class Dies:
    def __init__(self, after):
        self.after, self.drawn = after, 0

    def __call__(self, genomes):
        self.drawn += 1
        if self.drawn == self.after:
            raise RuntimeError("lost")
        return [e + self.drawn * 1e-3 for e in off(genomes)]  # each batch measures differently


@pytest.mark.parametrize("after", [2, 9, 17])
def test_a_search_goes_on_where_it_stopped(spark, tmp_path, after):
    config = evolution.Config(population=6, generations=18, multistart_threshold=4, mutation=evolution.Mutation(rate=0.6))
    whole = evolution.evolve(Dies(None), START, config)
    path = str(tmp_path / "journal")
    with pytest.raises(RuntimeError):
        evolution.evolve(Dies(after), START, config, Journal(spark, path))
    assert evolution.evolve(Dies(None), START, config, Journal(spark, path)) == whole
    again = evolution.evolve(Dies(1), START, config, Journal(spark, path))  # nothing is left to measure
    assert again == whole and len(list((tmp_path / "journal").glob("*.json"))) == 2


def test_survivors_are_measured_with_their_children():
    seen = []
    evolution.evolve(lambda gs: seen.append(len(gs)) or off(gs), START, evolution.Config(population=10, generations=2, replace_ratio=0.7, multistart_threshold=None))
    assert seen == [10, 13, 13]


def test_weights_that_are_off():
    rng, cfg = random.Random(1), evolution.Mutation(rate=1.0, switch=0.0)
    on, no = evolution.Optional(evolution.Bounded(4.0, 0.0, 8.0)), evolution.Optional(evolution.Bounded(1.0, 0.0, 8.0), False)
    assert on.crossover(no, rng) == on and no.crossover(on, rng) == no
    assert no.mutate(rng, cfg) == no and on.mutate(rng, cfg) != on
    switched = no.mutate(rng, evolution.Mutation(rate=0.0, switch=1.0))
    assert switched.on and switched.inner.value != 1.0
    assert replace_fixed(on).mutate(rng, evolution.Mutation(rate=0.0, switch=1.0)).on


def replace_fixed(weight):
    return evolution.Optional(weight.inner, True, True)


def test_the_first_population_may_be_the_seed_alone():
    seen, told = [], []
    config = evolution.Config(population=5, generations=1, all_seed=True)
    evolution.evolve(lambda gs: seen.append(gs) or off(gs), START, config, watch=lambda *x: told.append(x[0]))
    assert seen[0] == [START] * 5 and told == [1]


def test_fitness_keeps_no_pairs_and_is_the_predictors_error(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(f"{i:03}", rnd.choice([10.0, 400.0]) * i % 9000, 7.0 * i, rnd.uniform(30, 300), rnd.uniform(1e5, 9e5), rnd.choice([None, 1950, 1990, 2001]), rnd.choice([None, 1, 4]), rnd.choice(["Eigentumswohnung", "Reihenhaus", "Mehrfamilienhaus", None])) for i in range(160)]
    df = aggregates.with_sqm(completed(spark.createDataFrame(rows, "id string, x double, y double, wohnflaeche double, marktwert double, baujahr int, regiotyp int, objektunterart string")))
    train, test = df.where("CAST(id AS INT) % 4 > 0"), df.where("CAST(id AS INT) % 4 = 0 OR id = '001'")
    fitness = evolution.Fitness(train, test, batch=None, guards=None)
    chosen = random.Random(2)
    genomes = [evolution.lp_genome(), *(evolution.lp_genome().regenerate(chosen) for _ in range(3))]
    scale = D.min_max_scale(completed(train))
    found = [evolution.lp_predictor(g, scale).train(train).predict(test).selectExpr("coalesce(abs((sqm - pred_sqm) / sqm), 1.0D) AS e").collect() for g in genomes]
    monkeypatch.setattr(evolution, "radius_join", lambda *_, **__: pytest.fail("pairs were joined"))
    assert fitness(genomes) == pytest.approx([sum(r["e"] for r in f) / len(f) for f in found], rel=1e-9)
