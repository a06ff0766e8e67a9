"""Greedy selections against the sequential rules, and solves of planted scenes."""

import itertools

import numpy as np
import pytest

from covista.operators import selection, solves


def graph(spark, n=24, seed=0, most=20):
    r = np.random.default_rng(seed)
    w = np.zeros((n, n), int)
    for i in range(n):
        for j in range(i + 1, n):
            if r.random() < 0.5:
                w[i, j] = w[j, i] = r.integers(1, most) // (1 + abs(i - j) // 4)
    pairs = spark.createDataFrame([(i, j, int(w[i, j])) for i in range(n) for j in range(i + 1, n) if w[i, j]], "i long, j long, shared long")
    return w, pairs


@pytest.mark.parametrize(("size", "least", "seed"), [(4, 3, 0), (3, 1, 1), (8, 5, 2)])
def test_seed_groups(spark, size, least, seed):
    w, pairs = graph(spark, seed=seed)
    n, out, want = len(w), set(), []
    while True:
        left = [(-w[i, j], i, j) for i in range(n) for j in range(i + 1, n) if i not in out and j not in out and w[i, j] >= least]
        if not left:
            break
        _, i, j = min(left)
        group = [i, j]
        while len(group) < size:
            best = min(((-min(w[k, g] for g in group), k) for k in range(n) if k not in out and k not in group), default=(0, 0))
            if -best[0] < least:
                break
            group.append(best[1])
        out |= set(group)
        want.append((sorted(group), w[i, j], (i, j)))
    assert list(selection.seed_groups(pairs, size, least)) == want and len(want) > 1
    rows = selection.seed_image_groups(pairs, size, least, most=1).collect()
    assert [r["image"] for r in rows] == want[0][0] and {r["image"] for r in rows if r["founder"]} == set(want[0][2])


def sweep(w, tau, order):
    kept = []
    for i in order:
        best = max((w[i, k] for k in kept), default=None)
        if best is None or tau / 8 <= best < tau:
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize("tau", [2.0, 5.0, 9.0, 40.0])
def test_thinning(spark, tau):
    w, pairs = graph(spark, seed=3)
    images = spark.range(len(w)).withColumnRenamed("id", "image")
    assert sorted(r[0] for r in selection.thinned(pairs, images, tau).collect()) == sweep(w, tau, range(len(w)))
    r = np.random.default_rng(5)
    isolation = [float("nan") if k % 7 == 0 else float(v) for k, v in enumerate(r.integers(0, 5, len(w)))]
    own = spark.createDataFrame(list(enumerate(isolation)), "image long, isolation double")
    order = sorted(range(len(w)), key=lambda k: (-np.inf if np.isnan(isolation[k]) else -isolation[k], k))
    assert sorted(r[0] for r in selection.thinned(pairs, own, tau).collect()) == sweep(w, tau, order)


def test_thinning_to_a_number(spark):
    w, pairs = graph(spark, 12, seed=4)
    images = spark.range(len(w)).withColumnRenamed("id", "image")
    low, high, best = 1.0, float(np.median(w.max(axis=1))), None
    for _ in range(25):
        kept = sweep(w, (low + high) / 2, range(len(w)))
        if best is None or abs(len(kept) - 5) < abs(len(best) - 5):
            best = kept
        low, high = ((low + high) / 2, high) if len(kept) < 5 else (low, (low + high) / 2)
    assert sorted(r[0] for r in selection.thinned_to(pairs, images, 5).collect()) == best


def test_affine_factors(spark):
    r = np.random.default_rng(1)
    cams, x = r.normal(size=(8, 2, 4)), r.normal(size=(60, 3))
    rows = [(i, c, *map(float, cams[i][:, :3] @ x[c] + cams[i][:, 3])) for i in range(8) for c in range(60) if r.random() < 0.8]
    rows += [(99, 0, 1.0, 1.0)]
    f = solves.factorized(spark.createDataFrame(rows, "image long, cluster long, u double, v double"), rounds=20, settled=1e-3)
    assert f.rms < 1e-3 and f.cameras.where("image = 99").isEmpty() and f.points.count() == 60
    got = {p["cluster"]: [p["x0"], p["x1"], p["x2"], 1.0] for p in f.points.collect()}
    h = np.array([got[k] for k in range(60)])
    fit = np.linalg.lstsq(h, x, rcond=None)[0]
    assert np.abs(h @ fit - x).max() < 0.01  # the planted points, up to an affine frame


def test_wrong_observations_are_trimmed(spark):
    r = np.random.default_rng(3)
    cams, x = r.normal(size=(16, 2, 4)), r.normal(size=(40, 3))
    wrong = {(k * 5 % 16, k * 7 % 40) for k in range(14)}
    rows = [(i, c, *map(float, cams[i][:, :3] @ x[c] + cams[i][:, 3] + 6 * ((i, c) in wrong))) for i in range(16) for c in range(40)]
    df = spark.createDataFrame(rows, "image long, cluster long, u double, v double")
    plain, trimmed = solves.factorized(df, rounds=8, settled=1e-3), solves.factorized(df, rounds=20, trim=0.03, settled=1e-3)
    assert trimmed.rms < 0.05 * plain.rms and not wrong & {(k["image"], k["cluster"]) for k in trimmed.kept.collect()}


@pytest.mark.parametrize("dense", [400, 0])
def test_centres_from_directions(spark, dense):
    r = np.random.default_rng(2)
    n = 14 if dense else 5
    c = r.normal(size=(n, 3)) * 3
    rows = []
    for i, j in itertools.combinations(range(n), 2):
        d = (c[j] - c[i]) / np.linalg.norm(c[j] - c[i])
        if dense and (i * j) % 19 == 7:
            d = r.normal(size=3)  # a wrong edge
        rows.append((10 * i, 10 * j, *map(float, d * (1 + i))))
    rows += [(0, 0, 1.0, 0.0, 0.0), (0, 10, 0.0, 0.0, 0.0)]
    got = {x["image"]: np.array([x["x"], x["y"], x["z"]]) for x in solves.averaged_translations(spark.createDataFrame(rows, "i long, j long, dx double, dy double, dz double"), rounds=5 if dense else 1, dense=dense).collect()}
    g = np.array([got[10 * k] for k in range(n)])
    t = c - c.mean(axis=0)
    scale = (g * t).sum() / (g * g).sum()
    assert np.abs(scale * g - t).max() < 0.05 and scale > 0
    assert solves.averaged_translations(spark.createDataFrame([], "i long, j long, dx double, dy double, dz double")).collect() == []


def test_groups_apart_are_settled_together(spark, monkeypatch):
    """F8: as many rounds as pairs wait for each other, not as many as there are groups."""
    made, cut = [], selection.cut
    monkeypatch.setattr(selection, "cut", lambda df: made.append(1) or cut(df))
    pairs = spark.createDataFrame([(10 * k + a, 10 * k + b, 5 + k % 3) for k in range(30) for a, b in ((0, 1), (0, 2), (1, 2))], "i long, j long, shared long")
    rows = selection.seed_image_groups(pairs, 4, 5).collect()
    order = sorted(range(30), key=lambda k: (-(k % 3), k))
    assert [(r["group"], r["image"], r["founder"]) for r in rows] == [(n, 10 * k + a, a < 2) for n, k in enumerate(order) for a in range(3)]
    assert len(made) < 20  # one table for each group, and more, before


def test_centres_of_parts_that_no_edges_join(spark):
    """parts have no place or scale in common, so each has its own, in the same few passes over the edges."""
    r = np.random.default_rng(4)
    c, rows = [r.normal(size=(7, 3)) * s for s in (1, 5)], []
    for k in range(2):
        rows += [(10 * k + i, 10 * k + j, *map(float, c[k][j] - c[k][i])) for i, j in itertools.combinations(range(7), 2)]
    got = {x["image"]: np.array([x["x"], x["y"], x["z"]]) for x in solves.averaged_translations(spark.createDataFrame(rows, "i long, j long, dx double, dy double, dz double"), rounds=2, dense=0).collect()}
    for k in range(2):
        t = c[k] - c[k].mean(axis=0)
        t = t / np.mean([np.linalg.norm(t[j] - t[i]) for i, j in itertools.combinations(range(7), 2)])
        assert np.abs(np.array([got[10 * k + i] for i in range(7)]) - t).max() < 1e-4


def test_rounds_of_factors_write_no_tables(spark, monkeypatch):
    """a round is one pass over rows of clusters; observations are shuffled once, not twice a round."""
    made, cut = [], solves.cut
    monkeypatch.setattr(solves, "cut", lambda df: made.append(1) or cut(df))
    r = np.random.default_rng(1)
    cams, x = r.normal(size=(6, 2, 4)), r.normal(size=(30, 3))
    rows = [(i, c, *map(float, cams[i][:, :3] @ x[c] + cams[i][:, 3])) for i in range(6) for c in range(30)]
    f = solves.factorized(spark.createDataFrame(rows, "image long, cluster long, u double, v double"), rounds=8, settled=1e-9)
    assert f.rounds >= 4 and f.rms < 0.05 and f.kept.count() == 180 and len(made) < 4
