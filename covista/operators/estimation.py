"""Robust estimation for each group of rows: two-view geometry, poses, alignment, and solves over small graphs.

Each group (an image pair, an image, an edge) is one call in numpy; a group is bounded by the features of an image. Samples are
drawn from a seed and the group's key order, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covista.functions import geometry as g

#: Tries of a robust fit, and the chance of an outlier-free try at which it may end sooner.
TRIES, CONFIDENCE = 1000, 0.9999


def robust(n: int, size: int, fit: Callable[[np.ndarray], list], errors: Callable, most: float, seed: int, tries: int = TRIES):
    """(model, inliers) with the most rows within `most`, of models fitted to random samples, then refitted to its inliers; (None, none) where no sample gives one."""
    rng, best, inliers, k, need = np.random.default_rng(seed), None, np.zeros(n, bool), 0, tries
    if n < size:
        return None, inliers
    while k < need:
        k += 1
        for model in fit(rng.choice(n, size, replace=False)):
            ok = errors(model) <= most
            if ok.sum() > inliers.sum():
                best, inliers = model, ok
                share = min(max(ok.mean() ** size, 1e-12), 1 - 1e-12)
                need = min(tries, int(np.ceil(np.log(1 - CONFIDENCE) / np.log(1 - share))))
    for _ in range(3):  # local refinement as long as it gains
        if best is None or inliers.sum() < size:
            break
        again = [(m, errors(m) <= most) for m in fit(np.flatnonzero(inliers))]
        again = max(again, key=lambda x: x[1].sum(), default=None)
        if again is None or again[1].sum() < inliers.sum():
            break
        best, inliers = again
    return best, inliers


def _normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((x - mean) ** 2).sum(1)).mean(), 1e-12)
    t = np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])
    return np.c_[x, np.ones(len(x))] @ t.T, t


def _null(a: np.ndarray) -> np.ndarray:
    # of many rows the left factor would be a square of them
    return np.linalg.svd(a, full_matrices=len(a) < a.shape[1])[2][-1]


def fundamental(x: np.ndarray, y: np.ndarray, most: float, seed: int = 0):
    """(F, inliers): y' F x = 0 by eight points, errors by Sampson's distance."""

    def fit(i):
        (a, s), (b, t) = _normalised(x[i]), _normalised(y[i])
        f = _null((b[:, :, None] * a[:, None, :]).reshape(len(i), 9)).reshape(3, 3)
        u, d, v = np.linalg.svd(f)
        f = t.T @ (u @ np.diag([d[0], d[1], 0]) @ v) @ s
        return [f / np.linalg.norm(f)]

    p, q = np.c_[x, np.ones(len(x))], np.c_[y, np.ones(len(y))]

    def errors(f):
        a, b = p @ f.T, q @ f
        return np.abs((q * a).sum(1)) / np.sqrt(np.maximum((a[:, :2] ** 2).sum(1) + (b[:, :2] ** 2).sum(1), 1e-30))

    return robust(len(x), 8, fit, errors, most, seed)


def homography(x: np.ndarray, y: np.ndarray, most: float, seed: int = 0):
    """(H, inliers): y ~ H x by four points, errors where x comes to lie."""

    def fit(i):
        (a, s), (b, t) = _normalised(x[i]), _normalised(y[i])
        zero = np.zeros_like(a)
        rows = np.concatenate([np.c_[zero, -a, b[:, 1:2] * a], np.c_[a, zero, -b[:, :1] * a]])
        h = np.linalg.inv(t) @ _null(rows).reshape(3, 3) @ s
        return [h / np.linalg.norm(h)] if abs(np.linalg.det(h)) > 1e-15 else []

    p = np.c_[x, np.ones(len(x))]

    def errors(h):
        z = p @ h.T
        w = np.where(np.abs(z[:, 2]) > 1e-12, z[:, 2], np.nan)
        return np.nan_to_num(np.sqrt(((z[:, :2] / w[:, None] - y) ** 2).sum(1)), nan=np.inf)

    return robust(len(x), 4, fit, errors, most, seed)


def essential(a: np.ndarray, b: np.ndarray, most: float, seed: int = 0):
    """(E, inliers): b' E a = 0 for unit rays by eight of them; errors are angles to the epipolar plane."""

    def fit(i):
        e = _null((b[i][:, :, None] * a[i][:, None, :]).reshape(len(i), 9)).reshape(3, 3)
        u, _, v = np.linalg.svd(e)
        return [u @ np.diag([1, 1, 0]) @ v]

    def errors(e):
        n = a @ e.T
        return np.arcsin(np.clip(np.abs((b * n).sum(1)) / np.maximum(np.linalg.norm(n, axis=1), 1e-30), 0, 1))

    return robust(len(a), 8, fit, errors, most, seed)


def decomposed(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, t), of the four that E stands for, with the most rays that meet in front of both cameras; t is a unit vector."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])

    def ahead(r, t):
        d = a @ r.T
        ab = (d * b).sum(1)
        dt, bt = d @ t, b @ t
        den = np.maximum(1 - ab * ab, 1e-12)
        return int((((ab * bt - dt) / den > 0) & ((bt - ab * dt) / den > 0)).sum())

    return max(((r, t) for r in (u @ w @ v, u @ w.T @ v) for t in (u[:, 2], -u[:, 2])), key=lambda m: ahead(*m))


def absolute_pose(rays: np.ndarray, points: np.ndarray, most: float, seed: int = 0):
    """((R, t), inliers): rays are along R X + t, by six points; errors are angles, and points behind count as far."""

    def fit(i):
        d, x = rays[i], points[i]
        mean, s = x.mean(0), max(np.linalg.norm(x - x.mean(0), axis=1).mean(), 1e-12)
        h = np.c_[(x - mean) / s, np.ones(len(i))]
        zero = np.zeros_like(h)
        rows = np.concatenate([np.c_[zero, -d[:, 2:] * h, d[:, 1:2] * h], np.c_[d[:, 2:] * h, zero, -d[:, :1] * h], np.c_[-d[:, 1:2] * h, d[:, :1] * h, zero]])
        m = _null(rows).reshape(3, 4)
        out = []
        for sign in (1, -1):
            u, k, v = np.linalg.svd(sign * m[:, :3])
            if np.linalg.det(u @ v) > 0 and k.mean() > 1e-12:
                r = u @ v
                out.append((r, sign * m[:, 3] / k.mean() * s - r @ mean))
        return out

    def errors(m):
        z = points @ m[0].T + m[1]
        return np.arccos(np.clip((z * rays).sum(1) / np.maximum(np.linalg.norm(z, axis=1), 1e-30), -1, 1))

    return robust(len(rays), 6, fit, errors, most, seed)


def similarity_of(source: np.ndarray, target: np.ndarray):
    """(scale, R, t) that moves source onto target best by least squares; None where the points don't fix it."""
    s, t = source.mean(0), target.mean(0)
    a, b = source - s, target - t
    u, d, v = np.linalg.svd(b.T @ a)
    if d[1] < 1e-12 * max(d[0], 1e-300):
        return None
    flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    r = u @ flip @ v
    k = (d * np.diag(flip)).sum() / max((a * a).sum(), 1e-300)
    return (k, r, t - k * r @ s) if k > 0 else None


def robust_alignment(source: np.ndarray, target: np.ndarray, most: float, seed: int = 0, size: int = 3):
    """((scale, R, t), inliers) between corresponding points."""

    def fit(i):
        m = similarity_of(source[i], target[i])
        return [m] if m is not None else []

    return robust(len(source), size, fit, lambda m: np.linalg.norm(m[0] * source @ m[1].T + m[2] - target, axis=1), most, seed)


def fragments(source: np.ndarray, target: np.ndarray, most: float, least: int = 5, seed: int = 0) -> np.ndarray:
    """The number of the rigid fragment of each row, the largest first; -1 where none of `least` rows is left."""
    out, k = np.full(len(source), -1), 0
    while True:
        left = np.flatnonzero(out < 0)
        model, ok = robust_alignment(source[left], target[left], most, seed + k)
        if model is None or ok.sum() < least:
            return out
        out[left[ok]] = k
        k += 1


# Spark's side: one call a group.


def _by_group(df: DataFrame, keys: list[str], order: list[str], schema: str, run: Callable[[pd.DataFrame], dict | None]) -> DataFrame:
    types = dict(df.dtypes)

    def one(pdf):
        pdf = pdf.sort_values(order, kind="stable")
        found = run(pdf)
        row = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([row | found]) if found else pd.DataFrame(columns=[*keys, *(c.split()[0] for c in schema.split(", "))])

    return df.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema]))


def _two_view(estimate, axes, matches, most, seed):
    def run(p):
        m, ok = estimate(p[list(axes[0])].to_numpy(float), p[list(axes[1])].to_numpy(float), most, seed)
        return None if m is None else {"n": len(p), "inliers": int(ok.sum()), "model": m.ravel().tolist()}

    return _by_group(matches, ["image_i", "image_j"], ["feature_i", "feature_j"], "n long, inliers long, model array<double>", run)


def fundamentals(matches: DataFrame, most: float = 2.0, seed: int = 0) -> DataFrame:
    """(image_i, image_j, n, inliers, model) of matches (image_i, image_j, feature_i, feature_j, xi, yi, xj, yj); pairs without a model are left out."""
    return _two_view(fundamental, (("xi", "yi"), ("xj", "yj")), matches, most, seed)


def homographies(matches: DataFrame, most: float = 2.0, seed: int = 0) -> DataFrame:
    return _two_view(homography, (("xi", "yi"), ("xj", "yj")), matches, most, seed)


def essentials(matches: DataFrame, most: float = 2e-3, seed: int = 0) -> DataFrame:
    """As fundamentals(), of unit rays (ai, bi, ci) and (aj, bj, cj); most is an angle in radians."""
    return _two_view(essential, (("ai", "bi", "ci"), ("aj", "bj", "cj")), matches, most, seed)


def resections(observations: DataFrame, most: float = 5e-3, seed: int = 0) -> DataFrame:
    """(image, n, inliers, rotation, translation) of observations (image, point, rx, ry, rz, x, y, z): the pose of each image from its rays and their points."""

    def run(p):
        m, ok = absolute_pose(p[["rx", "ry", "rz"]].to_numpy(float), p[["x", "y", "z"]].to_numpy(float), most, seed)
        return None if m is None else {"n": len(p), "inliers": int(ok.sum()), "rotation": m[0].ravel().tolist(), "translation": m[1].tolist()}

    return _by_group(observations, ["image"], ["point"], "n long, inliers long, rotation array<double>, translation array<double>", run)


def alignments(pairs: DataFrame, group: str, order: str, most: float, seed: int = 0) -> DataFrame:
    """(group, n, inliers, scale, rotation, translation) of corresponding points (x, y, z) and (u, v, w)."""

    def run(p):
        m, ok = robust_alignment(p[["x", "y", "z"]].to_numpy(float), p[["u", "v", "w"]].to_numpy(float), most, seed)
        return None if m is None else {"n": len(p), "inliers": int(ok.sum()), "scale": float(m[0]), "rotation": m[1].ravel().tolist(), "translation": m[2].tolist()}

    return _by_group(pairs, [group], [order], "n long, inliers long, scale double, rotation array<double>, translation array<double>", run)


def baselines(rays: DataFrame, trim: float = 0.2) -> DataFrame:
    """(image_i, image_j, n, direction) of rays (image_i, image_j, feature, ai, bi, ci, aj, bj, cj) in world directions: the unit vector that all planes of two rays hold.

    The direction is the least eigenvector of the planes' normals; the share `trim` of worst rows is left out and the rest
    solved again. Its sign is that for which the rays meet ahead.
    """

    def run(p):
        a, b = p[["ai", "bi", "ci"]].to_numpy(float), p[["aj", "bj", "cj"]].to_numpy(float)
        n = np.cross(a, b)
        size = np.linalg.norm(n, axis=1)
        n = n[size > 1e-12] / size[size > 1e-12, None]
        if len(n) < 2:
            return None
        d = np.linalg.eigh(n.T @ n)[1][:, 0]
        keep = np.argsort(np.abs(n @ d), kind="stable")[: max(2, int(np.ceil(len(n) * (1 - trim))))]
        d = np.linalg.eigh(n[keep].T @ n[keep])[1][:, 0]
        if ((a - b) @ d).sum() < 0:
            d = -d
        return {"n": len(p), "direction": d.tolist()}

    return _by_group(rays, ["image_i", "image_j"], ["feature"], "n long, direction array<double>", run)


def depth_uncertainties(rays: DataFrame, points: DataFrame, key: str, sigma: str) -> DataFrame:
    """(key, depth, sigma, z): depth along the mean ray from the mean centre, its standard deviation, and how many of these the depth is away from infinity in inverse depth.

    rays has (key, cx, cy, cz, dx, dy, dz, sigma: radians), directions of length 1; points (key, x, y, z). The information of
    all rays is a sum of 3 x 3 matrices, so tracks are combined before the shuffle; only the inverse is taken in numpy.
    """
    d, c, p = g.columns("dx", "dy", "dz"), g.columns("cx", "cy", "cz"), g.columns("x", "y", "z")
    r = rays.join(points.select(key, "x", "y", "z"), key)
    far = g.norm(g.minus(p, c)) * F.col(sigma)
    w = F.when(far > 0, 1 / (F.when(far > 0, far) * F.when(far > 0, far))).otherwise(0.0)
    names = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [F.sum(w * (float(i == j) - d[i] * d[j])).alias(f"m{i}{j}") for i, j in names]
    grouped = r.groupBy(key, "x", "y", "z").agg(*sums, *[F.sum(x).alias(f"d{k}") for k, x in enumerate(d)], *[F.avg(x).alias(f"c{k}") for k, x in enumerate(c)])

    def run(frames):
        for f in frames:
            m = np.zeros((len(f), 3, 3))
            for i, j in names:
                m[:, i, j] = m[:, j, i] = f[f"m{i}{j}"]
            mean = f[["d0", "d1", "d2"]].to_numpy(float)
            mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-30)
            depth = ((f[["x", "y", "z"]].to_numpy(float) - f[["c0", "c1", "c2"]].to_numpy(float)) * mean).sum(1)
            ok = np.linalg.eigvalsh(m)[:, 0] > 0 if len(f) else np.zeros(0, bool)
            s = np.full(len(f), np.inf)
            if ok.any():
                s[ok] = np.sqrt(np.maximum(np.einsum("ni,nij,nj->n", mean[ok], np.linalg.inv(m[ok]), mean[ok]), 0))
            with np.errstate(invalid="ignore", divide="ignore"):
                yield pd.DataFrame({key: f[key], "depth": depth, "sigma": s, "z": np.where(s > 0, depth / s, np.inf)})

    return grouped.mapInPandas(run, f"`{key}` {dict(points.dtypes)[key]}, depth double, sigma double, z double")


def surfel_normals(edges: DataFrame, points: DataFrame, views: DataFrame, least: int = 3) -> DataFrame:
    """(p, nx, ny, nz, n): the normal of the plane through a point and its neighbours (p, q), facing its mean viewing direction (p, vx, vy, vz).

    The covariance of the neighbours is a sum, so nothing is held; the least eigenvector is taken in numpy. Points with
    fewer than `least` neighbours get none.
    """
    at = points.select(F.col("point").alias("q"), "x", "y", "z")
    own = points.select(F.col("point").alias("p"), *[F.col(a).alias(f"o{a}") for a in "xyz"])
    e = edges.select("p", "q").join(at, "q").join(own, "p").join(views, "p")
    o = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    s = e.groupBy("p", "vx", "vy", "vz").agg(F.count("*").alias("n"), *[F.sum(o[i] * o[j]).alias(f"s{i}{j}") for i, j in pairs]).where(F.col("n") >= least)

    def run(frames):
        for f in frames:
            m = np.zeros((len(f), 3, 3))
            for i, j in pairs:
                m[:, i, j] = m[:, j, i] = f[f"s{i}{j}"]
            v = np.linalg.eigh(m)[1][:, :, 0]
            v = np.where((v * f[["vx", "vy", "vz"]].to_numpy(float)).sum(1, keepdims=True) > 0, -v, v)
            yield pd.DataFrame({"p": f["p"], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "n": f["n"]})

    return s.mapInPandas(run, f"p {dict(edges.dtypes)['p']}, nx double, ny double, nz double, n long")


def modularity_groups(weights: np.ndarray) -> np.ndarray:
    """The group of each of n nodes by greedy modularity: the pair whose union gains most is joined, the last of equal ones, until none gains.

    A dense matrix of image groups, on the driver.
    """
    w = np.asarray(weights, float)
    w = (w + w.T) / 2
    np.fill_diagonal(w, 0)
    total = w.sum()
    group = np.arange(len(w))
    if total <= 0:
        return group
    alive, e, a = list(range(len(w))), w / total, w.sum(1) / total
    while len(alive) > 1:
        gain, pick = 0.0, None
        for x, i in enumerate(alive):
            for j in alive[x + 1 :]:
                d = 2 * (e[i, j] - a[i] * a[j])
                if d > 0 and d >= gain:
                    gain, pick = d, (i, j)
        if pick is None:
            break
        i, j = pick
        e[i] += e[j]
        e[:, i] += e[:, j]
        a[i] += a[j]
        alive.remove(j)
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]
