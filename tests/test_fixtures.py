"""Small planted cases of the track, neighbour and motion operators, each with its expected rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.functions import geometry as g
from covista.functions import text
from covista.operators import aggregates, joins, kernels, motion, neighbors, tracks

NAN, INF = float("nan"), float("inf")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reach(spark):
    data = [(0, 1, 0.0, 0.0, 5.0), (1, 1, 3.0, 4.0, 1.0), (2, 1, 0.0, 0.0, NAN), (3, 2, 0.0, 0.0, INF), (4, 2, 9e5, 0.0, 0.0), (5, 1, NAN, 0.0, 9.0), (6, 2, 9e5, 0.0, 1e-9)]
    df = spark.createDataFrame(data, "row int, g int, x double, y double, reach double")
    got = {(a, b): d for a, b, d in rows(joins.within_reach(df, "row", "g", "x", "y", "reach"))}
    assert got == {(0, 1): 5, (0, 2): 0, (3, 4): 9e5, (3, 6): 9e5, (4, 6): 0, (6, 4): 0}
    with pytest.raises(Exception, match="negative"):
        joins.within_reach(spark.createDataFrame([(0, 1, 0.0, 0.0, -1.0)], df.schema), "row", "g", "x", "y", "reach").collect()


def test_covered_by_finer_with_protected_rows(spark):
    data = [(0, 1, 10, 0.0, 0.0, 5.0, 8.0, False), (1, 1, 20, 1.0, 0.0, 5.0, 2.0, False), (2, 1, 10, 50.0, 0.0, 5.0, 8.0, False), (3, 1, 20, 51.0, 0.0, 5.0, 2.0, False), (4, 1, 30, 0.5, 0.0, 5.0, 8.0, True), (5, 1, 30, 90.0, 0.0, 5.0, NAN, False)]
    df = spark.createDataFrame(data, "row int, image int, owner int, x double, y double, reach double, radius double, safe boolean")
    left, owners = tracks.prune_covered(df, "row", "image", "owner", "x", "y", "reach", "radius", "safe")
    assert [r[0] for r in rows(left)] == [1, 3, 4, 5] and rows(owners) == [(20, 0), (30, 1)]


def edges(spark, observations, radii, positions, images=2, **options):
    o = spark.createDataFrame([(p, i, k, float(x), float(y)) for k, (p, i, x, y) in enumerate(observations)], "point int, image int, ordinal int, x double, y double")
    p = spark.createDataFrame([(k, float(r), *map(float, v), False) for k, (r, v) in enumerate(zip(radii, positions, strict=True))], "point int, radius double, px double, py double, pz double, at_infinity boolean")
    i = spark.createDataFrame([(k, 0.0, 0.0, 0.0) for k in range(images)], "image int, cx double, cy double, cz double")
    return rows(tracks.adjacency(o, p, i, **options).select("p", "q", "separation_med", "shared_images", "annulus_hits"))


def test_adjacency(spark):
    seen = [(0, 0, 0, 0), (1, 0, 5, 0), (0, 1, 10, 0), (1, 1, 13, 0)]
    near = [(0, 0, 4), (0, 0, 4.1)]
    assert edges(spark, seen, [1, 1], near) == [(0, 1, 4, 2, 2), (1, 0, 4, 2, 2)]
    assert edges(spark, seen, [1, 1], [(0, 0, 4), (0, 0, 8)]) == []  # unlike ranges
    assert edges(spark, seen[:2], [1, 1], near) == []  # one shared image
    assert edges(spark, seen, [0.4, 3], near, majority=0.6) == []  # one hit of two
    assert edges(spark, [*seen, (0, 0, 99, 0)], [1, 1], near) == [(0, 1, 4, 2, 2), (1, 0, 4, 2, 2)]  # the first observation counts
    r = random.Random(5)
    many = [(p, i, r.uniform(0, 60), r.uniform(0, 60)) for p in range(12) for i in range(3) if r.random() < 0.8]
    radii, places = [r.choice([0.3, 1, 7]) for _ in range(12)], [(0, 0, r.choice([5, 5.1])) for _ in range(12)]
    at = {(p, i): (x, y) for p, i, x, y in many}
    want = []
    for p, q in itertools.permutations(range(12), 2):
        both, radius = [i for i in range(3) if (p, i) in at and (q, i) in at], min(radii[p], radii[q])
        ratios = [math.dist(at[p, i], at[q, i]) / radius for i in both]
        hits = [x for x in ratios if 1 <= x <= 10]
        if len(both) >= 2 and hits and len(hits) >= 0.5 * len(both) and abs(places[p][2] - places[q][2]) / 5.05 <= 0.05:
            want.append((p, q, float(np.median(hits)), len(both), len(hits)))
    got = edges(spark, many, radii, places, 3)
    assert [(a[:2], a[3:]) for a in got] == [(a[:2], a[3:]) for a in want] and np.allclose([a[2] for a in got], [a[2] for a in want])


def side(spark, data):
    return spark.createDataFrame([(i, k, float(x), float(y), p) for k, (i, x, y, p) in enumerate(data)], "image int, ordinal int, x double, y double, point int")


def test_coordinate_correspondence(spark):
    source = side(spark, [(0, 10, 10, 10), (0, 50, 50, 11), (1, 20, 20, 10), (1, NAN, 5, 11)])
    target = side(spark, [(5, 10.5, 10, 20), (5, 51, 50, 21), (6, 20, 21, 20), (6, 80, 80, 21)])
    shared = spark.createDataFrame([(0, 5), (1, 6)], "source_image int, target_image int")
    assert rows(tracks.correspondence_by_coordinate(source, target, shared)) == [(10, 20, 2)]
    assert rows(tracks.correspondence_by_coordinate(source, target, shared, least=1)) == [(10, 20, 2), (11, 21, 1)]
    tied = side(spark, [(5, 12, 10, 20), (5, 8, 10, 22)])
    assert [r[:2] for r in rows(tracks.correspondence_by_coordinate(source, tied, shared, least=1))] == [(10, 20)]


def test_images_pair_by_digest_then_name(spark):
    left = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "b", "z"), (3, None, "w"), (4, "d", "v")], "k int, d string, n string")
    right = spark.createDataFrame([(0, "a", "q"), (1, "b", "z"), (2, "e", "y"), (3, "f", "w"), (4, "d", "v"), (5, "d", "v")], "k int, d string, n string")
    assert rows(tracks.paired_images(left, right, "k", "d", "n")) == [(0, 0, 1), (1, 2, 3), (2, 1, 2), (3, 3, 3), (4, 4, 2)]


def test_pairs_are_cut_by_distance_before_score(spark):
    pairs = spark.createDataFrame([(0, 1, 0.0), (0, 9, 9.0), (0, 6, 1.0), (0, 7, 2.0), (0, 8, 3.0)], "i int, j int, score double")
    assert rows(tracks.pruned_pairs(pairs, 4, most_distant=1)) == [(0, 1, 0.0), (0, 8, 3.0)]


def test_merge_keeps_infinity_and_unites_shared_observations(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 2.0, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 0.0, 0.0), (3, 9.0, 9.0, 9.0, 1.0), (4, 0.0, 3.0, 0.0, 0.0), (5, 0.0, 1.0, 0.0, 0.0)], "node int, x double, y double, z double, w double").withColumns({"r": F.lit(1), "g": F.lit(2), "b": F.lit(3), "error": F.lit(0.5)})
    seen = spark.createDataFrame([(0, 0, 0), (1, 1, 1), (2, 0, 0), (3, 2, 2), (4, 3, 3), (5, 4, 4)], "node int, image int, feature int")
    groups = spark.createDataFrame([(0, 0), (1, 0), (4, 4), (5, 4)], "node int, root int")
    got, observations = tracks.merge_points_and_tracks(points, seen, groups)
    assert rows(got.select("point", "x", "y", "z", "w", "members")) == [(0, 1, 0, 0, 1, 2), (1, 9, 9, 9, 1, 1), (2, 0, 1, 0, 0, 2)]
    assert rows(observations) == [(0, 0, 0), (0, 1, 1), (1, 2, 2), (2, 3, 3), (2, 4, 4)]


def test_clusters_are_claimed_as_one_after_the_other(spark):
    r = np.random.default_rng(42)
    base = r.integers(0, 255, (5, 16))
    data = [(i * 35 + k, i, (base[k] + r.integers(-2, 3, 16) if k < 5 else r.integers(0, 255, 16)).astype(float).tolist()) for i in range(4) for k in range(35)]
    df = spark.createDataFrame(data, "row int, image int, v array<double>")
    got = neighbors.background_floor_clusters(df, "row", "image", "v", d=10, alpha=0.8).collect()
    x, image = np.array([v for *_, v in data]), np.array([i for _, i, _ in data])
    d = np.linalg.norm(x[:, None] - x, axis=2)
    np.fill_diagonal(d, INF)
    near = np.argsort(d, axis=1, kind="stable")[:, :10]
    candidates = {s: [j for j in near[s] if image[j] != image[s] and d[s, j] <= 0.8 * d[s, near[s, 9]]] for s in range(140)}
    used, want = set(), set()
    for s in sorted(candidates, key=lambda s: (-len(candidates[s]), s)):
        if s in used:
            continue
        best = {image[s]: s}
        for j in sorted((j for j in candidates[s] if j not in used), key=lambda j: (d[s, j], j)):
            best.setdefault(image[j], j)
        used.add(s)
        if len(best) >= 2:
            used |= set(best.values())
            want |= {(s, int(i), int(j)) for i, j in best.items()}
    assert {tuple(t) for t in got} == want
    assert {frozenset(j % 35 for c, _, j in want if c == k) for k in {c for c, *_ in want}} >= {frozenset({k}) for k in range(5)}


def test_radius_joins(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, 0.0, 0.0), (3, NAN, 0.0), (4, 100.0, 0.0)], "key int, x double, y double")
    assert rows(neighbors.within_radius(p, p, "key", ["x", "y"], 5.0)) == [(0, 1, 5), (0, 2, 0), (1, 0, 5), (1, 2, 5), (2, 0, 0), (2, 1, 5)]
    assert rows(neighbors.within_radius(p, p, "key", ["x", "y"], 0.0)) == [(0, 2, 0), (2, 0, 0)]
    got = {k: d for k, d in (tuple(r) for r in neighbors.nearest_distances(p, "key", ["x", "y"]).collect())}
    assert got[0] == 0 and got[1] == 5 and got[3] is None and abs(got[4] - math.hypot(97, 4)) < 1e-9
    assert [r["key"] for r in neighbors.isolated_filter(p, "key", ["x", "y"], 2.0).orderBy("key").collect()] == [0, 1, 2, 3]


def test_approximate_search_has_its_recall(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)) * 4
    df = spark.createDataFrame([(i, (centres[i % 40] + r.normal(size=8) * 0.2).tolist()) for i in range(400)], "k int, v array<double>")
    q = df.where("k % 10 = 0")
    exact, some = neighbors.nearest(q, df, "k", "v", 3), neighbors.approximate(q, df, "k", "v", 3, 64, size=8)
    assert neighbors.recall(some.select("query", "key"), exact.select("query", "key")) >= 0.9
    assert neighbors.calibrated_budget(q, df, "k", "v", 0.9, size=8) <= 64
    ordered = neighbors.approximate(q, df, "k", "v", 3, 64, size=8, ordered=True)
    assert rows(ordered) == rows(some)
    assert sorted(x["key"] for x in neighbors.locality_order(df, "k", "v", size=8).collect()) == list(range(400))


def test_best_of_takes_finite_values(spark):
    df = spark.createDataFrame([(1, 0, NAN), (1, 1, INF), (2, 0, 3.0), (2, 1, 1.0), (2, 2, 1.0), (3, 0, None), (3, 1, 5.0)], "k int, o int, v double")
    assert [(r["k"], r["o"]) for r in aggregates.best_of(df, ["k"], "v", ["o"]).orderBy("k").collect()] == [(1, 0), (2, 1), (3, 1)]


def test_a_ray_without_length_is_left_out(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (1, 2.0, 0.0, 0.0, -1.0, 1.0, 1.0), (1, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "k int, cx double, cy double, cz double, dx double, dy double, dz double")
    got = {r["k"]: r for r in kernels.triangulated(df, "k", ("cx", "cy", "cz"), ("dx", "dy", "dz")).collect()}
    assert got[1]["n"] == 2 and np.allclose([got[1][c] for c in "xyz"], 1) and got[2]["x"] is None


def loop(n, turn=2.0):
    out = []
    for k in range(n):
        a = math.radians(turn * k)
        out.append(("s", k, math.cos(a), math.sin(a), 0.0, math.cos(a / 2), 0.0, 0.0, math.sin(a / 2)))
    return out


def test_a_planted_break_is_found(spark):
    frames = loop(40)
    broken = [f if f[1] <= 10 else (*f[:2], f[2] + 3, f[3], f[4], *(math.cos(math.radians(f[1] + 30)), 0.0, 0.0, math.sin(math.radians(f[1] + 30)))) for f in frames]
    ddl = "s string, k int, cx double, cy double, cz double, qw double, qx double, qy double, qz double"
    seen = [(k, p) for k in range(40) for p in range(k * 5, k * 5 + 40) if k <= 10 or p >= 60]
    cut = [(k, p + (10_000 if k > 10 else 0)) for k, p in seen]
    for data, observations, want in ((frames, seen, []), (broken, cut, [10])):
        x, e = motion.analysed(spark.createDataFrame(data, ddl), spark.createDataFrame(observations, "k int, p int"), "s", "k", "k", "p", ("cx", "cy", "cz"), ("qw", "qx", "qy", "qz"))
        assert [r["edge"] for r in e.where("is_break").collect()] == want
        assert x.count() == 40 and e.count() == 39
        if want:
            assert 10 in [r["edge"] for r in e.where("is_core").collect()]


def test_quaternions_and_similarities(spark):
    r = np.random.default_rng(1)
    s, t = (g.Similarity(tuple((v / np.linalg.norm(v)).tolist()), tuple(r.normal(size=3).tolist()), k) for v, k in ((r.normal(size=4), 2.0), (r.normal(size=4), 0.5)))
    p = tuple(r.normal(size=3).tolist())
    assert np.allclose(s.after(t).point(p), s.point(t.point(p))) and np.allclose(s.inverse().point(s.point(p)), p)
    df = spark.createDataFrame([(*p, *s.rotation, 0.5)], "x double, y double, z double, a double, b double, c double, d double, t double")
    v, q = g.columns("x", "y", "z"), g.columns("a", "b", "c", "d")
    one = [F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]
    got = df.select(F.array(*s.apply(v)), F.array(*g.q_rotate(q, v)), F.array(*g.q_product(q, g.q_inverse(q))), g.q_angle(one, g.q_slerp(one, q, F.col("t"))), g.q_angle(one, q), F.array(*s.apply(v, F.lit(0.0)))).first()
    assert np.allclose(got[0], s.point(p)) and np.allclose(got[1], g.Similarity(s.rotation).point(p)) and np.allclose(got[2], [1, 0, 0, 0]) and abs(got[3] * 2 - got[4]) < 1e-6
    assert np.allclose(got[5], got[1])
    turned, moved = s.apply_pose(q, v)
    x = df.select(F.array(*g.camera_centre(turned, moved)), F.array(*s.apply(g.camera_centre(q, v)))).first()
    assert np.allclose(x[0], x[1])


@pytest.mark.parametrize("model", sorted(g.MODELS))
def test_pixels_come_back(spark, model):
    values = {"f": 900.0, "fx": 900.0, "fy": 910.0, "cx": 640.0, "cy": 360.0, "k1": 0.05, "k2": -0.01, "k3": 0.001, "k4": 0.0, "p1": 0.001, "p2": -0.002}
    params = F.create_map(*[F.lit(x) for k in g.MODELS[model] for x in (k, values[k])])
    df = spark.createDataFrame([(0.3, -0.2, 2.0), (0.0, 0.0, 1.0), (1.0, 1.0, -1.0)], "x double, y double, z double")
    u, v = g.projected(model, params, g.columns("x", "y", "z"))
    ray = df.select("*", u.alias("u"), v.alias("v")).select("x", "y", "z", "u", F.array(*g.unprojected(model, params, F.col("u"), F.col("v"))).alias("r")).collect()
    for row in ray[:2]:
        want = np.array(row[:3]) / np.linalg.norm(row[:3])
        assert np.allclose(row["r"], want, atol=1e-6)
    assert ray[2]["u"] is None


def test_splitmix(spark):
    mask, state, want = (1 << 64) - 1, 42, []
    for _ in range(5):
        z = state = (state + 0x9E3779B97F4A7C15) & mask
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        z ^= z >> 31
        want.append(z - (1 << 64) if z >> 63 else z)
    states = [((42 + k * 0x9E3779B97F4A7C15 + (1 << 63)) & mask) - (1 << 63) for k in range(5)]
    got = spark.createDataFrame([(s,) for s in states], "s long").select(g.splitmix64(F.col("s"))).collect()
    assert [r[0] for r in got] == want


def test_text_formats(spark):
    assert abs(text.angle("90deg") - math.pi / 2) < 1e-12 and text.angle("1.5rad") == 1.5
    assert text.length("12in", "m") == pytest.approx(0.3048) and text.length(5, "mm") == 5
    assert text.options("a=1, b=on,", {"a": int, "b": text.truth}) == {"a": 1, "b": True}
    assert text.parsed_point_id("pt3d_0a1b2c3d_17") == ("0a1b2c3d", 17) and text.indexes("0+2+5") == [0, 2, 5]
    assert text.workspace_path("a\\b/../c.jpg") == "a/c.jpg"
    for f, bad in ((text.angle, "90"), (lambda x: text.length(x, "m"), "-1m"), (lambda x: text.length(x, "m"), "3parsec"), (text.truth, "maybe"), (lambda x: text.options(x, {"a": int}), "b=1"), (lambda x: text.options(x, {"a": int}), "a=x"), (text.workspace_path, "../x"), (text.workspace_path, "/x"), (text.parsed_point_id, "pt3d_1_2"), (text.name_and_slice, "a[1]"), (text.name_and_slice, "a[::0]"), (text.name_and_slice, "a b")):
        with pytest.raises(ValueError):
            f(bad)
    assert text.pattern_glob("a/%04d_%%.jpg") == "a/*_%.jpg"
    df = spark.createDataFrame([("c_0007.jpg",), ("c_12345.jpg",), ("c_007.jpg",), ("c_00007.jpg",)], "p string")
    assert [r[0] for r in df.select(text.pattern_frame(F.col("p"), "c_%04d.jpg")).collect()] == [7, 12345, None, None]
    assert [r[0] for r in df.select(text.pattern_matches(F.col("p"), "C_*.JPG", True)).collect()] == [True] * 4
    assert text.name_and_slice("walk1[:30]") == ("walk1", text.Slice(None, 30)) and text.name_and_slice("w")[1] is None
    numbers = spark.range(10)
    for cut in ((2, 8, 3), (None, None, -2), (-3, None, None), (8, 2, -1), (5, 2, 1)):
        got = [r["id"] for r in text.sliced(numbers, "id", text.Slice(*cut)).orderBy("nth").collect()]
        assert got == list(range(10))[slice(*cut)]
    assert text.selection(["1-10", "20"]).ranges == ((1, 10, 1), (20, 20, 1)) and text.selection([], "walk[2:]").named == "walk"
    names = spark.createDataFrame([("a/img_012.jpg",), ("x (3)",), ("none.jpg",)], "n string")
    assert [tuple(r) for r in names.select(*text.sequence_of_name(F.col("n"))).collect()] == [("a/img_", 12), ("x ", 3), (None, None)]
    paths = spark.createDataFrame([("a\\b/../c.jpg",), ("../x",), ("/x",), ("./a//b",)], "p string")
    assert [r[0] for r in paths.select(text.path_column(F.col("p"))).collect()] == ["a/c.jpg", None, None, "a/b"]


def test_selected_clusters(spark):
    data = [(0, 0, 1, "ok", True), (0, 1, 2, "ok", True), (1, 0, 1, "ok", True), (1, 1, 1, "ok", True), (2, 0, 1, "ok", False), (2, 1, 2, "ok", False), (3, 0, 1, "bad", True), (3, 1, 2, "ok", True), (4, 0, 2, "ok", True), (4, 1, 3, "ok", True), (5, 0, 1, "ok", True), (5, 1, 2, "ok", True)]
    m = spark.createDataFrame(data, "cluster int, ordinal int, image int, status string, refinable boolean")
    asked = spark.createDataFrame([(1,), (2,), (2,), (9,)], "image int")
    got, images = tracks.selected_clusters(m, asked, statuses=["ok"])
    assert rows(got.select("cluster", "source_cluster").distinct()) == [(0, 0), (1, 5)] and rows(images) == [(1, 2), (2, 2), (9, 0)]


def test_sweeps(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(30, 4))
    left = spark.createDataFrame([(i, float(i), v[i].tolist()) for i in range(30)], "k int, y double, v array<double>")
    right = spark.createDataFrame([(100 + i, i + 0.2, (v[i] + 0.01).tolist()) for i in range(30)], "k int, y double, v array<double>")
    got = rows(neighbors.sweep_mutual(left, right, "k", F.col("y"), "v", 6))
    assert [(a, b) for a, b, _ in got] == [(i, 100 + i) for i in range(30)]
    a = np.linspace(-np.pi, np.pi, 30, endpoint=False)
    ring = lambda off, base: spark.createDataFrame([(base + i, float(np.cos(t + off)), float(np.sin(t + off)), v[i].tolist()) for i, t in enumerate(a)], "k int, x double, y double, v array<double>")
    got = rows(neighbors.polar_mutual(ring(0.0, 0), ring(-0.05, 100), "k", "x", "y", ((0.0, 0.0), (0.0, 0.0)), "v", 6))
    assert [(p, q) for p, q, _ in got] == [(i, 100 + i) for i in range(30)]
