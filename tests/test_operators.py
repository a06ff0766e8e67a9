import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.functions import formula
from covista.operators import aggregates, filters, graphs, joins, kernels, sequences

NAN, INF = float("nan"), float("inf")


def test_bounds_and_order(spark):
    df = spark.createDataFrame([(1, 2.0), (2, NAN), (3, None), (4, INF), (5, 2.0), (6, -1.0)], "k long, v double")
    ids = lambda d: [r["k"] for r in d.collect()]
    assert sorted(ids(filters.within(df, {"v": (None, None)}))) == [1, 2, 3, 4, 5, 6]
    assert sorted(ids(filters.within(df, {"v": (2.0, None)}))) == [1, 4, 5]
    assert sorted(ids(filters.within(df, {"v": (None, 2.0)}))) == [1, 5, 6]
    assert ids(df.orderBy(*filters.value_order("v", "k")))[:4] == [6, 1, 5, 4]
    assert ids(df.orderBy(*filters.value_order("v", "k", True))) == [4, 1, 5, 6, 2, 3]
    assert ids(filters.page(df, "v", "k", offset=1, limit=2)) == [1, 5]
    with pytest.raises(ValueError):
        filters.within(df, {"w": (0, 1)})
    with pytest.raises(ValueError):
        filters.within(df, {"v": (2, 1)})


def test_ranges_and_globs(spark):
    names = spark.createDataFrame([("a_001.jpg",), ("b(12).png",), ("none",), ("x7",)], "n string")
    assert [r[0] for r in names.select(filters.number_in_name("n")).collect()] == [1, 12, None, 7]
    assert [r["n"] for r in filters.include_range(names, "n", "1-5,12").collect()] == ["a_001.jpg", "b(12).png"]
    assert [r["n"] for r in filters.exclude_range(names, "n", "1-5,12").collect()] == ["none", "x7"]
    assert [r["n"] for r in filters.matching(names, "n", "*.[jp]*g").collect()] == ["a_001.jpg", "b(12).png"]
    for bad in ("", "5-1", "a", "1-5:0"):
        with pytest.raises(ValueError):
            filters.ranges(bad)


def test_renumbering_is_dense_across_blocks(spark):
    keys = random.Random(1).sample(range(10**6), 300)
    got = filters.renumbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", block=1000).collect()
    assert {r["k"]: r["new_index"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}


def test_reach_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(3), r.uniform(-50, 50), r.uniform(-50, 50), r.choice([0.0, 5.0, 20.0, NAN, math.inf])) for i in range(120)] + [(500, 0, NAN, 0.0, 5.0), (501, 0, None, 0.0, 5.0)]
    got = joins.within_reach(spark.createDataFrame(rows, "row long, g int, x double, y double, reach double"), "row", "g", "x", "y", "reach")
    want = {(a[0], b[0]) for a in rows[:120] for b in rows[:120] if a[1] == b[1] and a[0] != b[0] and math.hypot(a[2] - b[2], a[3] - b[3]) <= a[4]}
    assert {(x["row"], x["other"]) for x in got.collect()} == want


def test_components_against_union_find(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 3)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = graphs.connected_groups(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {x["id"]: x["root"] for x in got} == {x: find(x) for x in list(parent)}


def test_formula_and_its_errors(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "r double, g double")
    v = {"R": F.col("r"), "G": F.col("g")}
    value = lambda text: df.select(formula.parse(text, v)).first()[0]
    assert value("R + G * 2") == 8 and value("(R + G) * 2") == 10 and value("R ** 3 ** 0.0") == 2 and value("2 * R ** 2") == 8
    for bad in ("", "R +", "R B", "(R", "R $ G", "B"):
        with pytest.raises(formula.FormulaError):
            formula.parse(bad, v)
    assert [df.select(formula.quantised(F.lit(x), 1)).first()[0] for x in (-1.0, 0.4, 0.5, 9.0)] == [0, 0, 1, 1]


def test_triangulation_finds_planted_points(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(20, 3))
    rays = []
    for i, p in enumerate(points):
        for _ in range(4):
            c = rng.normal(size=3) * 5
            rays.append((i, *map(float, c), *map(float, p - c)))
    rays += [(99, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rays, "k long, cx double, cy double, cz double, dx double, dy double, dz double")
    got = {r["k"]: r for r in kernels.triangulated(df, "k", ("cx", "cy", "cz"), ("dx", "dy", "dz")).collect()}
    for i, p in enumerate(points):
        assert np.allclose([got[i]["x"], got[i]["y"], got[i]["z"]], p, atol=1e-6)
    assert got[99]["x"] is None


def test_windows_cover_each_frame(spark):
    df = spark.createDataFrame([(s, k) for s, n in ((1, 11), (2, 3), (3, 6)) for k in range(n)], "s int, k int")
    got = sequences.overlapping_windows(df, "s", "k", 6, 2).collect()
    of = lambda s: sorted((r["window"], r["k"]) for r in got if r["s"] == s)
    assert of(2) == [(0, 0), (0, 1), (0, 2)] and of(3) == [(0, k) for k in range(6)]
    assert of(1) == [(0, k) for k in range(6)] + [(1, k) for k in range(4, 10)] + [(2, k) for k in range(8, 11)]


@pytest.mark.parametrize("few", [5, 50_000])
def test_quantiles_are_exact(spark, few, monkeypatch):
    monkeypatch.setattr(aggregates, "FEW", few)
    r = np.random.default_rng(6)
    for x in (r.normal(size=400), np.repeat([1.0, 2.0, 3.0], 90), np.concatenate([r.normal(size=50), [1e12, -1e12]]), [7.0], [1.0, 1.0 + 2**-52] * 20, [-1.5e308, 1.0, 1.5e308] * 9):
        rows = [(float(v),) for v in x] + [(None,), (NAN,)]
        df = spark.createDataFrame(rows, "v double")
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert aggregates.quantile(df, "v", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12, abs=1e-12)
    assert aggregates.quantile(spark.createDataFrame([(INF,)] * 9 + [(-INF,)] * 9 + [(float(k),) for k in range(9)], "v double"), "v") == 4.0
    assert aggregates.quantile(spark.createDataFrame([(None,)], "v double"), "v") is None


def test_of_equal_line_numbers_the_first_row_counts(spark, tmp_path):
    """Rows with one line number are taken in the order of the table, whatever order a shuffle brings them in."""
    from covista.plans import track_queries

    rows = [(o, s, 1, q, 0.0) for o in range(40) for s, qs in ((1, (9.0, 1.0)), (2, (0.0, 5.0))) for q in qs]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    many = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        df = track_queries.displacement_partners(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", many)
    assert got == [(1, 2, 9.0, 1), (2, 1, 9.0, 1)]
    assert "row_index" in df._jdf.queryExecution().optimizedPlan().toString()


def test_points_of_one_place_are_met_once(spark):
    """3,000 points on 30 places: the nearest are the least keys of the own place, then of the next, and no pair of all points is made."""
    from covista.operators import neighbors

    p = spark.range(3000).select("id", (F.col("id") % 30 * 7).cast("double").alias("x"), F.lit(0.0).alias("y")).withColumnRenamed("id", "key")
    got = {r["query"]: [] for r in p.select(F.col("key").alias("query")).collect()}
    near = neighbors.nearest_within_radius(p, p, "key", ["x", "y"], 2, 25.0)
    for r in near.collect():
        got[r["query"]].append((r["rank"], r["key"], r["distance"]))
    for q, found in got.items():
        own = [k for k in range(q % 30, 3000, 30) if k != q][:2]
        assert sorted(found) == [(1, own[0], 0.0), (2, own[1], 0.0)]
    assert {r["distance"] for r in neighbors.nearest_distances(p, "key", ["x", "y"], 100).collect()} == {7.0}  # 99 others are on the own place
    places = neighbors._places(p, "key", ["x", "y"], [])
    assert places.count() == 30
    assert neighbors.within_radius(p, p, "key", ["x", "y"], 6.0).count() == 30 * 100 * 99


def test_knn_exact_asks_for_every_row(spark):
    from covista.plans import queries

    got = queries.knn_exact(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("embedding is not null").count()
    assert got.select("query").distinct().count() == n and got.count() == 3 * n


@pytest.mark.parametrize("size", [(1024, 1 << 15), (40, 1 << 15), (1, 50)])
def test_blocks_lose_no_neighbour(spark, size, monkeypatch):
    from covista.operators import neighbors

    monkeypatch.setattr(neighbors, "FEW_ROWS", size[0])
    monkeypatch.setattr(neighbors, "BLOCK", size[1])
    x = np.random.default_rng(8).integers(0, 4, (300, 5)).astype(float)  # many ties and equal rows
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = sorted((r["query"], r["rank"], r["key"], r["distance"]) for r in neighbors.self_nearest(df, "k", "v", 5).collect())
    want = [(q, n + 1, int(k), float(d[q, k])) for q in range(300) for n, k in enumerate(np.lexsort((np.arange(300), d[q]))[:5])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
