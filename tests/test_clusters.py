"""Clustering in rounds, intervals and ranges, against brute force."""

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compval.functions import costs as C
from compval.operators import clustering, rounds, spatial

REACH = 30.0
SCHEMA = "id string, x double, y double, sqm double, u double"


def some_listings(seed, n=26):
    rnd = random.Random(seed)
    return [(f"{i:03}", rnd.uniform(0, 90), rnd.uniform(0, 60), rnd.choice([100.0, 105.0, 110.0, 180.0, 190.0]), 0.0) for i in range(n)]


def near(rows):
    return {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= REACH**2}


def squares(a, b):
    """Finite everywhere: some pairs gain, others lose."""
    return (F.col(a + "sqm") - F.col(b + "sqm")) * (F.col(a + "sqm") - F.col(b + "sqm")) / 50 - 1


def priced_squares(p, q):
    return (p - q) ** 2 / 50 - 1


def capped(p, q):
    return float("inf") if 1 - min(p, q) / max(p, q) > 0.3 else -1.0


KINDS = [(C.capped(C.negative_discrete(), 0.3), capped), (squares, priced_squares)]


def checked(rows, found, price, stable):
    """Total cost, after the invariants: blocks hang together, no two in reach gain by merging, no move gains."""
    sqm, reach = {r[0]: r[3] for r in rows}, near(rows)
    cost = lambda i, j: 2 * price(sqm[i], sqm[j])
    members = defaultdict(set)
    for i, b in found.items():
        members[b].add(i)
    links = defaultdict(set)
    for a, b in reach:
        links[a].add(b)
        links[b].add(a)
    assert set(found) == set(sqm) and all(b == min(m) for b, m in members.items())
    for m in members.values():
        seen, todo = set(), [min(m)]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += links[i] & m
        assert seen == m
    if not stable:
        for a, b in {tuple(sorted((found[i], found[j]))) for i, j in reach if found[i] != found[j]}:
            assert sum(cost(i, j) for i in members[a] for j in members[b]) >= -1e-9
    else:
        for i, b in found.items():
            if i in clustering.cut_vertices(members[b], links):
                continue
            here = sum(cost(i, j) for j in members[b] if j != i)
            assert -here >= -1e-4 - 1e-9
            for other in {found[j] for j in links[i]} - {b}:
                assert sum(cost(i, j) for j in members[other]) - here >= -1e-4 - 1e-9
    return sum(cost(i, j) for m in members.values() for i, j in itertools.combinations(sorted(m), 2))


@pytest.mark.parametrize("kind", [0, 1])
def test_rounds_end_where_nothing_gains(spark, kind):
    rows = some_listings(kind + 1)
    column, price = KINDS[kind]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sqm = {r[0]: r[3] for r in rows}
    serial = clustering.contract(list(sqm), near(rows), lambda i, j: price(sqm[i], sqm[j]))
    assert dict(map(tuple, clustering.cluster(df, REACH, column).collect())) == serial
    stable = kind == 1
    got = dict(map(tuple, clustering.cluster(df, REACH, column, stable, large=1).collect()))
    # Not the sequence's blocks, but about as cheap.
    assert checked(rows, got, price, stable) <= 0.8 * checked(rows, serial, price, False)


def test_components_of_a_long_path(spark):
    n = 300
    ids = spark.range(n).select(F.format_string("n%04d", "id").alias("id"))
    step = spark.range(n - 1).where("id % 100 <> 99").select(F.format_string("n%04d", "id").alias("a_id"), F.format_string("n%04d", F.col("id") + 1).alias("b_id"))
    found = {r["id"]: r["component"] for r in clustering.components(ids, step.unionByName(step)).collect()}
    assert found == {f"n{i:04}": f"n{i // 100 * 100:04}" for i in range(n)}


def test_wide_and_strange_intervals(spark):
    rnd = random.Random(2)
    ivs = [(i, lo, lo + w) for i, (lo, w) in enumerate((rnd.uniform(-1e6, 1e6), 2.0 ** rnd.randint(-4, 45)) for _ in range(80))]
    ivs += [(100, 5.0, 5.0), (101, 7.0, 3.0), (102, None, 4.0), (103, float("-inf"), float("inf")), (104, -1e300, 1e300), (105, 0.0, 0.5), (106, -0.5, 0.0), (107, -1e12, 1e12)]
    pts = [(i, p) for i, p in enumerate([rnd.uniform(-2e6, 2e6) for _ in range(150)] + [0.0, -0.5, 0.49, 1e18, -1e18, 1e200, None, float("nan"), *[v[1] for v in ivs[:5]], *[v[2] for v in ivs[:5]]])]
    points, intervals = spark.createDataFrame(pts, "p int, at double"), spark.createDataFrame(ivs, "i int, lo double, hi double")
    want = sorted((p, i) for p, at in pts for i, lo, hi in ivs if None not in (at, lo) and lo <= at < hi)
    for unit in (1.0, 1000.0):
        got = spatial.interval_join(points, intervals, "at", "lo", "hi", unit).select("p", "i").collect()
        assert sorted(map(tuple, got)) == want
    assert spatial.interval_join(points, intervals.limit(0), "at", "lo", "hi").count() == 0


def test_index_adds_and_deletes(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, lo double, hi double")
    index = spatial.IntervalIndex(make([("a", 0.0, 10.0), ("b", 5.0, 6.0)]), "k", "lo", "hi")
    at = spark.createDataFrame([(5.0,), (9.0,)], "x double")
    held = lambda ix: sorted((r["x"], r["k"]) for r in ix.stab(at, "x").collect())
    assert held(index) == [(5.0, "a"), (5.0, "b"), (9.0, "a")]
    assert held(index.delete(make([("a", None, None)]))) == [(5.0, "b")]
    assert held(index.delete(make([("a", None, None)])).add(make([("a", 8.0, 1e15)]))) == [(5.0, "b"), (9.0, "a")]
    with pytest.raises(ValueError, match="1 keys are in the index"):
        index.add(make([("a", 1.0, 2.0), ("c", 1.0, 2.0)]))
    with pytest.raises(ValueError, match="1 keys are not in"):
        index.delete(make([("a", 0.0, 0.0), ("z", 0.0, 0.0)]))
    with pytest.raises(ValueError, match="not unique"):
        index.add(make([("d", 1.0, 2.0), ("d", 1.0, 3.0)]))


def test_ranges_of_any_size(spark):
    rnd = random.Random(4)
    span = lambda: (lambda lo, w: (lo, lo + w))(rnd.uniform(-500, 500), 2.0 ** rnd.randint(-3, 12))
    rects = [(i, *span(), *span()) for i in range(60)] + [(90, 0.0, 0.0, 0.0, 9.0), (91, None, 1.0, 0.0, 1.0), (92, -1e15, 1e15, -1.0, 1.0)]
    pts = [(i, rnd.uniform(-600, 600), rnd.uniform(-600, 600)) for i in range(120)] + [(200, None, 1.0), (201, 0.0, 0.0)]
    a, b = spark.createDataFrame(rects, "r int, xl double, xh double, yl double, yh double"), spark.createDataFrame(pts, "p int, x double, y double")
    got = spatial.range_join(a, b, ("xl", "xh"), ("yl", "yh")).select("r", "p").collect()
    assert sorted(map(tuple, got)) == sorted((r, p) for r, xl, xh, yl, yh in rects for p, x, y in pts if None not in (xl, x) and xl <= x < xh and yl <= y < yh)
    assert spatial.range_join(a.limit(0), b, ("xl", "xh"), ("yl", "yh")).count() == 0


def test_one_of_each_pair_of_ends(spark):
    edges = spark.createDataFrame([(1, 2, -3.0), (2, 3, -5.0), (3, 4, -4.0), (5, 6, -1.0), (7, 8, 1.0), (9, 10, float("inf"))], "a long, b long, w double")
    assert sorted(map(tuple, rounds.best_pairs(edges).collect())) == [(2, 3), (5, 6)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_added_entries_extend_components(spark, seed):
    rnd = random.Random(seed)
    rows = [(f"{i:03}", rnd.uniform(0, 400), rnd.uniform(0, 300)) for i in range(60)] + [("z1", None, 1.0)]
    rnd.shuffle(rows)
    old, new = (spark.createDataFrame(r, "id string, x double, y double") for r in (rows[:40], rows[40:]))
    every = old.unionByName(new)
    want = dict(clustering.components(every, spatial.epsilon_edges(every, REACH)).select("id", "component").collect())
    found = clustering.components(old, spatial.epsilon_edges(old, REACH))
    assert dict(clustering.components_extended(found, new, clustering.edges_added(old, new, REACH)).collect()) == want
    nothing = new.limit(0)
    assert dict(clustering.components_extended(found, nothing, clustering.edges_added(old, nothing, REACH)).collect()) == dict(found.select("id", "component").collect())


def nearest(targets, others, k):
    return {t[0]: [o[0] for o in sorted(others, key=lambda o: ((t[1] - o[1]) ** 2 + (t[2] - o[2]) ** 2, o[0]))[:k]] for t in targets}


@pytest.mark.parametrize("k", [1, 4, 500])
def test_nearest_where_most_lie_in_one_place(spark, k):
    rnd = random.Random(k)
    dense = [(i, float(rnd.randrange(40)), float(rnd.randrange(40))) for i in range(300)]
    sparse = [(300 + i, float(rnd.randrange(100_000)), float(rnd.randrange(100_000))) for i in range(20)]
    targets = [(1, 20.0, 20.0), (2, 50_000.0, 50_000.0), (3, 99_999.0, 3.0), (4, -1e9, 1e12), (5, 41.0, 41.0), *((10 + i, *r[1:]) for i, r in enumerate(sparse))]
    schema = "id long, x double, y double"
    made = lambda rows, also=(): spark.createDataFrame([*rows, *also], schema)
    got = spatial.knn_join(made(targets, [(9, None, 1.0)]), made(dense + sparse, [(999, None, None)]), k).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["knn_rank"]):
        by[r["t_id"]].append(r["n_id"])
    assert by == nearest(targets, dense + sparse, k)


def test_large_blocks_of_one_cost_are_priced_by_their_extremes(spark, monkeypatch):
    monkeypatch.setattr(rounds, "priced", lambda *_: pytest.fail("pairs of listings were priced"))
    for seed in (1, 5):
        rows = some_listings(seed, 40) + [("z", 30.0, 30.0, None, 0.0)][: seed - 1]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = dict(map(tuple, clustering.cluster(df, REACH, KINDS[0][0], large=1).collect()))
        assert set(got) == {r[0] for r in rows}
        if seed == 1:
            checked(rows, got, capped, False)
        one = dict(map(tuple, clustering.cluster(df, REACH, C.negative_discrete(), large=1).collect()))
        assert len(set(one.values())) == clustering.components(df, spatial.epsilon_edges(df, REACH)).select("component").distinct().count()


def test_each_edge_is_met_once_and_from_half_of_the_cells(spark):
    rnd = random.Random(6)
    rows = [(f"{i:02}", float(rnd.randint(-90, 90)), float(rnd.randint(-90, 90)), i) for i in range(70)] + [("z", None, 0.0, 1), ("00", 3.0, 3.0, 5), ("y", 0.0, 0.0, 7), ("x", 30.0, 0.0, 8)]
    df = spark.createDataFrame(rows, "id string, x double, y double, v int")
    found = spatial.epsilon_edges(df, 30.0)
    assert found.columns == [f"{p}_{c}" for p in "ab" for c in df.columns]
    want = [(*a, *b) for a, b in itertools.permutations(rows, 2) if a[0] < b[0] and None not in (a[1], b[1]) and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 900]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(cx") == 5
