"""Point or bearing, and points at infinity: planted near and far tracks, a scalar version, and brute force over all pairs."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from covista.operators import bearings, infinity


def planted(n=60, sigma=1e-3, seed=0):
    """Rays of near points (even tracks) and of directions (odd tracks), seen by cameras on an arc."""
    r = np.random.default_rng(seed)
    rows, truth = [], {}
    for t in range(n):
        views = 3 + t % 5
        c = np.c_[np.linspace(-1, 1, views), 0.1 * r.normal(size=views), np.zeros(views)]
        if t % 2 == 0:
            p = np.array([r.normal(), r.normal(), 4 + 4 * r.random()])
            d = p - c
        else:
            p = r.normal(size=3) * 0.3 + [0, 0, 1]
            p /= np.linalg.norm(p)
            d = np.tile(p, (views, 1))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        d += r.normal(size=d.shape) * sigma
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        truth[t] = p
        rows += [(t, *map(float, c[k]), *map(float, d[k]), sigma) for k in range(views)]
    return rows, truth


RAYS = "track long, cx double, cy double, cz double, dx double, dy double, dz double, sigma double"


def scalar_cost(x, rows):
    """Of a bearing (w = 0) or a point, ray by ray."""
    total = 0.0
    for *_, cx, cy, cz, dx, dy, dz, s in rows:
        v = np.array(x[:3]) - (np.array([cx, cy, cz]) if x[3] else 0)
        v = v / np.linalg.norm(v)
        d = np.array([dx, dy, dz])
        total += ((v - d * (d @ v)) ** 2).sum() / s**2
    return total


def test_near_and_far_tracks_are_told_apart(spark):
    rows, truth = planted()
    extra = [(100, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1e-3), (101, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1e-3), (101, 1.0, 0.0, 0.0, float("nan"), 0.0, 1.0, 1e-3), (101, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows + extra, RAYS)
    got = {x["track"]: x for x in bearings.fits(df, "track").join(bearings.scores(df, "track").select("track", "finite"), "track").collect()}
    assert sorted(got) == sorted(truth)
    for t, x in got.items():
        own = [r for r in rows if r[0] == t]
        assert x["finite"] == (t % 2 == 0) and x["views"] == len(own) and x["in_front"]
        b = (x["bx"], x["by"], x["bz"], 0.0)
        assert scalar_cost(b, own) == pytest.approx(x["bearing_cost"], rel=1e-6, abs=1e-9)
        m = sum(((np.eye(3) - np.outer(r[4:7], r[4:7])) / r[7] ** 2 for r in own), np.zeros((3, 3)))
        assert x["bearing_cost"] == pytest.approx(np.linalg.eigvalsh(m)[0], rel=1e-3, abs=1e-4)
        assert 0 <= x["midpoint_bound"] <= x["ratio"] * (1 + 1e-9) + 1e-9 and x["ratio"] <= x["bearing_cost"] + 1e-9
        if t % 2 == 0:
            p = np.array([x["px"], x["py"], x["pz"], 1.0])
            assert scalar_cost(p, own) == pytest.approx(x["point_cost"], rel=1e-6, abs=1e-9) and np.linalg.norm(p[:3] - truth[t]) < 0.15
            base = scalar_cost(p, own)
            assert all(scalar_cost(p + 1e-4 * np.array([*step, 0]), own) >= base - 1e-6 for step in itertools.product((-1, 0, 1), repeat=3))
        else:
            assert np.arccos(min(1.0, float(np.dot(b[:3], truth[t])))) < 3e-3 and x["ratio"] < 25


def test_the_score_follows_its_law(spark):
    """For true bearings the ratio is above t with half the chance of a chi-square of one degree."""
    rows, _ = planted(1200, seed=4)
    far = [r for r in rows if r[0] % 2]
    got = bearings.fits(spark.createDataFrame(far, RAYS), "track").select("ratio", "depth_score").collect()
    share = np.mean([x["ratio"] > 1.0 for x in got])
    assert abs(share - 0.5 * 0.3173) < 0.05 and np.mean([abs(x["ratio"] - x["depth_score"]) < 0.05 + 0.05 * x["ratio"] for x in got]) > 0.95


def test_a_soft_loss_bears_one_wrong_ray(spark):
    rows, truth = planted(2, seed=8)
    rows = [r for r in rows if r[0] == 0] * 1 + [(0, 0.5, 0.5, 0.0, 0.6, 0.0, 0.8, 1e-3)]
    rows += [(0, 0.1 * k, 0.2, 0.0, *map(float, (truth[0] - [0.1 * k, 0.2, 0.0]) / np.linalg.norm(truth[0] - [0.1 * k, 0.2, 0.0])), 1e-3) for k in range(9)]
    df = spark.createDataFrame(rows, RAYS)
    plain, soft = (bearings.fits(df, "track", soft=s, steps=60).first() for s in (None, 3.0))
    off = lambda x: np.linalg.norm(np.array([x["px"], x["py"], x["pz"]]) - truth[0])
    assert off(soft) < 0.05 < off(plain)


def test_points_are_classified(spark):
    rows, truth = planted(40, seed=3)
    stored = [(t, *map(float, p), float(t % 2 == 0)) for t, p in truth.items()]
    stored[0] = (0, *map(float, truth[0] / np.linalg.norm(truth[0])), 0.0)  # a near point stored as a direction
    stored[1] = (1, *map(float, truth[1] * 900), 1.0)  # a direction stored as a far point
    stored[2] = (2, 0.0, 0.0, -5.0, 1.0)  # behind the cameras
    stored += [(77, 1.0, 2.0, 3.0, 1.0)]
    points = spark.createDataFrame(stored, "point long, x double, y double, z double, w double")
    got = {x["point"]: x for x in bearings.classified(points, spark.createDataFrame(rows, RAYS).withColumnRenamed("track", "point"), 0.05).collect()}
    assert {t: got[t]["verdict"] for t in (0, 1, 2, 77)} == {0: "promoted", 1: "demoted", 2: "refitted", 77: "unscored"}
    assert all(got[t]["verdict"] == "kept" and (got[t]["x"], got[t]["w"]) == (stored[t][1], stored[t][4]) for t in range(3, 40))
    for t in (0, 2):
        assert got[t]["w"] == 1 and np.linalg.norm([got[t]["x"] - truth[t][0], got[t]["y"] - truth[t][1], got[t]["z"] - truth[t][2]]) < 0.2
    assert got[1]["w"] == 0 and np.linalg.norm([got[1]["x"], got[1]["y"], got[1]["z"]]) == pytest.approx(1)


def features(seed=1, n=400):
    r = np.random.default_rng(seed)
    sky = r.normal(size=(30, 3))
    sky[0], sky[1] = [0, 0, 1], [0, 0, -1]  # the poles
    sky /= np.linalg.norm(sky, axis=1, keepdims=True)
    base = r.integers(0, 255, size=(30, 32))
    rows = []
    for k in range(n):
        image = k // 30 % 8 if k % 17 else k % 8
        if k < 240:
            s = k % 30
            d, v = sky[s] + r.normal(size=3) * 0.002, np.clip(base[s] + r.integers(-2, 3, 32), 0, 255)
        else:
            d, v = r.normal(size=3), r.integers(0, 255, 32)
        d = d / np.linalg.norm(d)
        rows.append((k, image, *map(float, d), [int(x) for x in v]))
    return rows


def brute_matches(rows, degrees, farthest, ratio):
    r = infinity.chord(degrees)
    out = set()
    for a in rows:
        by = {}
        for b in rows:
            if b[1] != a[1] and sum((x - y) ** 2 for x, y in zip(a[2:5], b[2:5], strict=True)) <= r * r:
                by.setdefault(b[1], []).append((sum((x - y) ** 2 for x, y in zip(a[5], b[5], strict=True)), b[0]))
        for found in by.values():
            found.sort()
            if found[0][0] < farthest**2 and (len(found) == 1 or found[0][0] < ratio**2 * found[1][0]):
                out.add((a[0], found[0][1], found[0][0]))
    return out


@pytest.mark.parametrize(("degrees", "block"), [(0.5, 1024), (1.0, 7), (20.0, 16)])
def test_matches_against_all_pairs(spark, degrees, block):
    rows = features()
    df = spark.createDataFrame(rows, "feature_id long, image long, dx double, dy double, dz double, descriptor array<int>")
    got = infinity.directed_matches(df, degrees, 250.0, 0.8, block)
    assert {(x["a"], x["b"], round(x["distance"])) for x in got.collect()} == brute_matches(rows, degrees, 250.0, 0.8)


def test_tracks_and_points(spark):
    rows = features()
    df = spark.createDataFrame(rows, "feature_id long, image long, dx double, dy double, dz double, descriptor array<int>")
    one = brute_matches(rows, 1.0, 250.0, 0.8)
    pairs = {(a, b): d for a, b, d in one if (b, a, d) in one}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {}
    for k in root:
        want.setdefault(find(k), {}).setdefault(rows[k][1], []).append((sum(d for (a, _), d in pairs.items() if a == k), k))
    want = {(t, image, min(m)[1]) for t, images in want.items() if len(images) >= 3 for image, m in images.items()}
    got = infinity.candidate_tracks(df, 1.0, 250.0, 0.8, 3)
    assert {tuple(x) for x in got.select("track", "image", "feature_id").collect()} == want and len(want) > 60
    # cameras side by side see the sky without parallax; a near point is none
    rays = df.select("feature_id", *[F.when(F.col("feature_id") % 30 == 7, F.col("image") * 1.0).otherwise(0.0).alias("cx")], F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"), "dx", "dy", "dz", F.lit(0.003).alias("sigma"))
    points, seen = infinity.found_points(df, rays, views=3, used=spark.createDataFrame([(3,)], "feature_id long"))
    p = {x["track"]: x for x in points.collect()}
    assert p and all(x["w"] == 0 and abs(x["x"] ** 2 + x["y"] ** 2 + x["z"] ** 2 - 1) < 1e-9 and x["error"] < 0.01 for x in p.values())
    assert seen.where("feature_id = 3").count() == 0 and {x["track"] for x in seen.collect()} == set(p)


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], RAYS)
    assert bearings.scores(none, "track").collect() == [] and bearings.fits(none, "track").collect() == []
    df = spark.createDataFrame([(1, 0, float("nan"), 0.0, 0.0, [1]), (2, None, 1.0, 0.0, 0.0, [1])], "feature_id long, image long, dx double, dy double, dz double, descriptor array<int>")
    assert infinity.candidate_tracks(df, 1.0, 250.0, 0.8, 2).collect() == []


def test_a_fit_does_not_depend_on_other_tracks():
    """A settled track takes no part in later steps, so what a track gets is the same whichever tracks its task holds."""
    r = np.random.default_rng(3)
    track = np.repeat(np.arange(200), 4)
    c = r.normal(size=(800, 3)) * 0.5
    p = np.c_[r.uniform(-1, 1, (200, 2)), r.uniform(4, 8, 200)]
    d = p[track] - c + r.normal(size=(800, 3)) * 1e-3
    t = bearings.Tracks(track, np.c_[c, d, np.full(800, 1e-3)])
    whole = bearings.fitted(t)
    half = bearings.fitted(t.only(np.arange(200) % 2 == 0))
    assert all(np.array_equal(whole[k][::2], half[k], equal_nan=True) for k in whole)
