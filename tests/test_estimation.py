"""Planted geometry is found again, with outliers in it, and transforms keep what they must."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.functions import geometry as g
from covista.operators import estimation as e
from covista.operators import transforms as t

R = np.random.default_rng(7)


def turn(axis, angle):
    a = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -a[2], a[1]], [a[2], 0, -a[0]], [-a[1], a[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def scene(n=80):
    x = R.uniform(-2, 2, (n, 3)) + [0, 0, 8]
    r, s = turn([0.1, 1, 0.2], 0.2), np.array([1.0, 0.1, 0.2])
    return x, r, s, x @ r.T + s


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_two_views():
    x, r, s, y = scene()
    a, b = 800 * x[:, :2] / x[:, 2:], 800 * y[:, :2] / y[:, 2:]
    b[:15] += R.uniform(30, 90, (15, 2))
    m, ok = e.fundamental(a, b, 1.0)
    assert ok[15:].all() and ok[:15].sum() <= 3
    u, v = unit(x), unit(y)
    v[:15] = unit(R.normal(size=(15, 3)))
    m, ok = e.essential(u, v, 1e-3)
    rot, way = e.decomposed(m, u[ok], v[ok])
    assert ok[15:].all() and np.allclose(rot, r, atol=1e-3) and np.allclose(way, s / np.linalg.norm(s), atol=1e-3)
    h = np.array([[1.1, 0.02, 5], [0.01, 0.9, -3], [1e-5, 2e-5, 1]])
    z = np.c_[a, np.ones(len(a))] @ h.T
    z = z[:, :2] / z[:, 2:]
    z[:20] += 50
    m, ok = e.homography(a, z, 1.0)
    assert ok[20:].all() and not ok[:20].any() and np.allclose(m / m[2, 2], h, atol=1e-4)


def test_poses_alignments_and_fragments():
    x, r, s, y = scene()
    rays = unit(y)
    rays[:20] = unit(R.normal(size=(20, 3)))
    (rot, way), ok = e.absolute_pose(rays, x, 1e-3)
    assert ok[20:].all() and np.allclose(rot, r, atol=1e-4) and np.allclose(way, s, atol=1e-3)
    target = 2.5 * x @ r.T + s
    target[:30] = 0.5 * x[:30] + 9
    (k, rot, way), ok = e.robust_alignment(x, target, 1e-3)
    assert abs(k - 2.5) < 1e-9 and np.allclose(rot, r) and ok[30:].all()
    assert (e.fragments(x, target, 1e-3) == np.r_[np.ones(30), np.zeros(50)]).all()


def test_groups_in_spark(spark):
    rows = []
    for j in (1, 2):
        x, r, s, y = scene(40)
        a, b = 800 * x[:, :2] / x[:, 2:], 800 * y[:, :2] / y[:, 2:]
        u, v = unit(x), unit(y)
        rows += [(0, j, k, k, *a[k].tolist(), *b[k].tolist(), *u[k].tolist(), *v[k].tolist()) for k in range(40)]
    rows += [(5, 6, k, k, *[float(k)] * 10) for k in range(3)]
    df = spark.createDataFrame(rows, "image_i long, image_j long, feature_i long, feature_j long, xi double, yi double, xj double, yj double, ai double, bi double, ci double, aj double, bj double, cj double")
    for f in (e.fundamentals, e.essentials):
        got = f(df).orderBy("image_j").collect()
        assert [(x["image_j"], x["inliers"]) for x in got] == [(1, 40), (2, 40)]
    assert e.homographies(df).count() == 2
    p = spark.createDataFrame([(1, k, *unit(y[k : k + 1])[0].tolist(), *x[k].tolist()) for k in range(40)], "image long, point long, rx double, ry double, rz double, x double, y double, z double")
    got = e.resections(p).first()
    assert got["inliers"] == 40 and np.allclose(got["translation"], s, atol=1e-6)
    q = spark.createDataFrame([(1, k, *x[k].tolist(), *y[k].tolist()) for k in range(40)], "g long, k long, x double, y double, z double, u double, v double, w double")
    assert abs(e.alignments(q, "g", "k", 1e-6).first()["scale"] - 1) < 1e-9
    back = (unit(y) @ r).tolist()
    rays = spark.createDataFrame([(0, 1, k, *unit(x)[k].tolist(), *back[k]) for k in range(40)], "image_i long, image_j long, feature long, ai double, bi double, ci double, aj double, bj double, cj double")
    want = -r.T @ s
    assert np.allclose(e.baselines(rays).first()["direction"], want / np.linalg.norm(want), atol=1e-6)


def test_groups_by_modularity():
    w = np.kron(np.eye(2), np.ones((4, 4))) + 0.01
    assert e.modularity_groups(w).tolist() == [0] * 4 + [1] * 4


def test_depths_and_normals(spark):
    rays, points = [], []
    for p, z in enumerate((5.0, 500.0)):
        for c in (-0.5, 0.5):
            d = unit(np.array([[0.0 - c, 0.0, z]]))[0]
            rays.append((p, c, 0.0, 0.0, *d.tolist(), 1e-3))
        points.append((p, 0.0, 0.0, z))
    r = spark.createDataFrame(rays, "k long, cx double, cy double, cz double, dx double, dy double, dz double, s double")
    q = spark.createDataFrame(points, "k long, x double, y double, z double")
    got = {x["k"]: x for x in e.depth_uncertainties(r, q, "k", "s").collect()}
    assert abs(got[0]["depth"] - 5) < 1e-9 and got[0]["z"] > 50 > 5 > got[1]["z"]
    grid = [(i * 5 + j, float(i), float(j), 0.0) for i in range(5) for j in range(5)]
    pts = spark.createDataFrame(grid, "point long, x double, y double, z double")
    links = spark.createDataFrame([(12, k) for k in (7, 11, 13, 17)], "p long, q long")
    views = spark.createDataFrame([(12, 0.0, 0.0, -1.0)], "p long, vx double, vy double, vz double")
    n = e.surfel_normals(links, pts, views).first()
    assert np.allclose([n["nx"], n["ny"], n["nz"]], [0, 0, 1])


@pytest.fixture(scope="module")
def demo(spark):
    rows = []
    for k in range(6):
        a = k * np.pi / 3
        rows.append((k, f"a_{k:03d}.jpg" if k < 4 else f"b_{k:03d}.jpg", 0, float(np.cos(a / 2)), 0.0, float(np.sin(a / 2)), 0.0, 0.1 * k, 0.0, 5.0))
    images = spark.createDataFrame(rows, "image long, name string, camera long, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    points = spark.createDataFrame([(k, float(np.cos(k)), float(np.sin(k)), 0.1 * k, 0.0 if k == 7 else 1.0, 0.5 + 0.05 * k) for k in range(10)], "point long, x double, y double, z double, w double, error double").withColumn("thumbnail", F.lit(1))
    seen = spark.createDataFrame([(p, (p + d) % 6, p) for p in range(10) for d in range(2 + p % 2)], "point long, image long, feature long")
    cameras = spark.createDataFrame([(0, "PINHOLE", {"fx": 1000.0, "fy": 1000.0, "cx": 960.0, "cy": 540.0})], "camera long, model string, params map<string,double>")
    return {"images": images, "points": points, "observations": seen, "cameras": cameras}


def projected(tables):
    o = tables["observations"].join(tables["points"], "point").join(tables["images"], "image")
    x = g.q_rotate(g.columns("qw", "qx", "qy", "qz"), g.columns("x", "y", "z"))
    x = [a + F.when(F.col("w") == 0, 0.0).otherwise(F.col(b)) for a, b in zip(x, ("tx", "ty", "tz"), strict=True)]
    return np.array([r[2:] for r in sorted(tuple(r) for r in o.select("point", "image", x[0] / x[2], x[1] / x[2]).collect())])


def test_moves_leave_images_as_they_are(spark, demo):
    before = projected(demo)
    steps = [t.rotate((0, 1, 1), 0.7), t.translate((1, 2, 3)), t.scale(2.5), t.OPTIONS["rotate"]("1,0,0,30deg")]
    moved = t.apply_all(demo, steps)
    assert np.allclose(projected(moved), before, atol=1e-9)
    pose = t.compared_poses(moved, demo).agg(F.max("distance")).first()[0]
    assert pose > 1
    back = t.apply_all(moved, [t.align_to(demo)])
    assert t.compared_poses(back, demo).agg(F.max("distance")).first()[0] < 1e-6
    assert np.allclose(projected(t.apply_all(demo, [t.scale(3.0), t.AlignToInput()])), before, atol=1e-9)
    pairs = demo["points"].select(F.col("point").alias("source"), F.col("point").alias("target"))
    same = t.compared_points(back, demo, pairs, 1.0).first()
    assert same["n"] == 9 and same["within_01"] == 1


def test_filters_of_the_chain(spark, demo):
    out = t.apply_all(demo, [t.remove_short_tracks(2), t.filter_by_error(0.9), t.drop_thumbnails()])
    assert sorted(x[0] for x in out["points"].select("point").collect()) == [0, 1, 2, 3] and "thumbnail" not in out["points"].columns
    assert out["observations"].groupBy("point").count().where("count <> 3").isEmpty()
    left = t.apply_all(demo, [t.include_glob("a_*"), t.exclude_range("2")])
    assert sorted(x[0] for x in left["images"].select("name").collect()) == ["a_000.jpg", "a_001.jpg", "a_003.jpg"]
    assert left["observations"].agg(F.max("image")).first()[0] <= 2
    assert t.apply_all(demo, [t.select_by_distribution(3)])["images"].count() == 3
    far = t.apply_all(demo, [t.materialize_infinity(100.0)])["points"]
    assert far.where("w = 0").isEmpty() and far.where("x * x + y * y + z * z > 2500").count() == 1
    new = t.apply_all(demo, [t.switch_camera_model("SIMPLE_RADIAL")])["cameras"].first()
    assert new["model"] == "SIMPLE_RADIAL" and new["params"] == {"f": 1000.0, "cx": 960.0, "cy": 540.0, "k1": 0.0}
    with pytest.raises(ValueError):
        t.apply_all(demo, [t.remove_large_features(3.0, demo["observations"])], "embedded_patches")
    wide = t.apply_all(demo, [t.remove_narrow_tracks(0.01)])["points"].count()
    assert 1 <= wide <= 10


def test_reports(spark, demo):
    x, y = g.projected("PINHOLE", F.col("params"), [a + F.when(F.col("w") == 0, 0.0).otherwise(F.col(b)) for a, b in zip(g.q_rotate(g.columns("qw", "qx", "qy", "qz"), g.columns("x", "y", "z")), ("tx", "ty", "tz"), strict=True)])
    seen = demo["observations"].join(demo["points"].drop("error", "thumbnail"), "point").join(demo["images"], "image").join(demo["cameras"].select("camera", "params"), "camera")
    tables = demo | {"observations": seen.select("point", "image", "feature", (x + 3.0).alias("x2"), (y - 4.0).alias("y2"))}
    errors = t.residuals(tables).where("error is not null")
    assert np.allclose([r["error"] for r in errors.collect()], 5)
    assert t.inlier_share(errors, 5.1).first()["share"] == 1 and t.inlier_share(errors, 4.9).first()["share"] == 0
    assert np.allclose([r["error"] for r in t.point_errors(tables).where("error is not null").collect()], 5)
    assert t.depth_statistics(demo).count() == 6 and t.scene_bounds(demo["points"]).first()["radius"] > 0
    assert t.scene_bounds(demo["points"].where("point = 1")).first()["radius"] == 1 and t.camera_spacing(demo["images"]).first()["scale"] > 0
    assert {r["measure"]: r["n"] for r in t.summary(demo).collect()} == {"track_length": 10, "error": 10, "observations": 6}
    assert t.image_metrics(demo).count() == 6
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "i long, j long")
    assert sorted(tuple(r) for r in t.image_hops(pairs, demo["images"].select("image"), F.col("image") == 0).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, None), (5, None)]


def test_a_refit_to_many_rows_takes_memory_in_proportion():
    import tracemalloc

    r = np.random.default_rng(4)
    x = r.uniform(0, 50, (1500, 2))
    tracemalloc.start()
    m, ok = e.homography(x, 2 * x + [1, -3], 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ok.all() and np.allclose(m / m[2, 2], [[2, 0, 1], [0, 2, -3], [0, 0, 1]], atol=1e-9) and peak < 10 << 20
