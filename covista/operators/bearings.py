"""Point or bearing: two nested models of a track's rays, their costs in units of the noise, and the ratio that tells them apart.

A ray has a centre c, a unit direction d and a standard deviation sigma, in radians. What a direction v misses of it is
(I - d d') v / (|v| sigma). The bearing model is one direction for all rays; the point model adds an inverse depth rho at
an anchor a: v = u + rho (a - c). The bearing model is the point model at rho = 0, so the reduction in cost, the ratio, is
never negative, and for a true bearing follows half a chi-square law of one degree.

Spark brings the rays of a track together (one for an image at most, which bounds it), in the order of tracks; a task
works on many tracks at once, ray by ray in arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import whole_groups

#: The ratio above which a track is a finite point: a chance of 1 in 3.5 million for a true bearing. Fixed value.
THRESHOLD = 25.0
#: The least depth of a point that is stored, as a part of the scene's median depth. Fixed value.
LEAST_DEPTH = 0.01
#: Steps of a fit; its end: no step lowers the cost by more than this part of it.
STEPS, SETTLED = 20, 1e-12
RAY = ("cx", "cy", "cz", "dx", "dy", "dz", "sigma")


class Tracks:
    """The usable rays of many tracks: start[t] is where those of track t begin; sums over a track are by reduceat."""

    def __init__(self, track: np.ndarray, rays: np.ndarray):
        """track: the number (0, 1, ...) of each ray's track, in order; rays: rows of RAY."""
        c, d, s = rays[:, :3], rays[:, 3:6], rays[:, 6]
        size = np.linalg.norm(d, axis=1)
        ok = np.isfinite(rays).all(axis=1) & (size > 0) & (s > 0)
        self.total = int(track[-1]) + 1 if len(track) else 0
        self.of, self.c, self.s = track[ok], c[ok], s[ok]
        self.d = d[ok] / size[ok][:, None]
        self.views = np.bincount(self.of, minlength=self.total)
        self.anchor = self.sum(self.c) / np.maximum(self.views, 1)[:, None]
        self.off = self.anchor[self.of] - self.c

    def only(self, which: np.ndarray) -> Tracks:
        """The tracks that which (a boolean for each) picks, numbered anew."""
        if which.all():
            return self
        t, kept = object.__new__(Tracks), which[self.of]
        t.total, t.of = int(which.sum()), (np.cumsum(which) - 1)[self.of[kept]]
        t.c, t.s, t.d = self.c[kept], self.s[kept], self.d[kept]
        t.views, t.anchor, t.off = self.views[which], self.anchor[which], self.off[kept]
        return t

    def sum(self, x: np.ndarray) -> np.ndarray:
        """x, a row for each ray, summed by track."""
        out = np.zeros((self.total, *x.shape[1:]))
        if len(x):
            first = np.flatnonzero(np.concatenate(([True], self.of[1:] != self.of[:-1])))
            out[self.of[first]] = np.add.reduceat(x, first, axis=0)
        return out

    def every(self, x: np.ndarray) -> np.ndarray:
        """Whether x holds for all rays of each track."""
        return self.sum((~x).astype(float)) == 0

    def misses(self, v: np.ndarray) -> np.ndarray:
        """What each ray misses of the direction v from its centre, in units of its noise."""
        with np.errstate(invalid="ignore", divide="ignore"):
            w = v / np.linalg.norm(v, axis=1, keepdims=True)
        return np.nan_to_num((w - self.d * (self.d * w).sum(1, keepdims=True)) / self.s[:, None], nan=1e150)

    def along(self, u: np.ndarray, rho: np.ndarray) -> np.ndarray:
        """The direction from each ray's centre of the point (u, rho) of its track."""
        return u[self.of] + rho[self.of, None] * self.off

    def cost(self, u: np.ndarray, rho: np.ndarray, soft: float | None = None) -> np.ndarray:
        r2 = (self.misses(self.along(u, rho)) ** 2).sum(1)
        return self.sum(r2 if soft is None else 2 * soft * soft * (np.sqrt(1 + r2 / (soft * soft)) - 1))

    def in_front(self, u: np.ndarray, rho: np.ndarray) -> np.ndarray:
        return self.every((self.d * self.along(u, rho)).sum(1) > 0)

    def bearing(self) -> tuple[np.ndarray, np.ndarray]:
        """The best bearing of each track, along its mean ray, and its cost."""
        w = 1 / self.s**2
        m = self.sum(w[:, None, None] * (np.eye(3) - self.d[:, :, None] * self.d[:, None, :]))
        u = np.linalg.eigh(m)[1][:, :, 0] if self.total else np.zeros((0, 3))
        u = np.where((u * self.sum(w[:, None] * self.d)).sum(1, keepdims=True) < 0, -u, u)
        return u, self.cost(u, np.zeros(self.total))

    def normal_equations(self, u: np.ndarray, rho: np.ndarray, soft: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(g, h, t): gradient and Gauss-Newton matrix of the point model in two turns of u (the columns of t) and rho."""
        t = tangents(u)
        v = self.along(u, rho)
        size = np.linalg.norm(v, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            w = v / size[:, None]
            x = np.concatenate([t[self.of], self.off[:, :, None]], axis=2)
            for a in (w, self.d):  # what is along w, then along d, is taken out of the columns
                x = x - a[:, :, None] * np.einsum("ni,nij->nj", a, x)[:, None, :]
            j = np.nan_to_num(x / (size * self.s)[:, None, None])
        r = self.misses(v)
        weight = np.ones(len(r)) if soft is None else 1 / np.sqrt(1 + (r * r).sum(1) / (soft * soft))
        return self.sum(weight[:, None] * np.einsum("nij,ni->nj", j, r)), self.sum(weight[:, None, None] * np.einsum("nij,nik->njk", j, j)), t

    def depth_score(self, u: np.ndarray) -> np.ndarray:
        """g' H^-1 g at rho = 0: what the first step towards a point promises; 0 where it leads behind, or the centres say nothing."""
        g, h, _ = self.normal_equations(u, np.zeros(self.total))
        step = -np.einsum("nij,nj->ni", _pinv(h), g)
        return np.where(step[:, 2] > 0, np.maximum(-(step * g).sum(1), 0), 0.0)

    def midpoint(self) -> tuple[np.ndarray, np.ndarray]:
        """The point that is nearest to a track's rays by their weights, and whether it is in front of all cameras."""
        m = (np.eye(3) - self.d[:, :, None] * self.d[:, None, :]) / (self.s**2)[:, None, None]
        p = self.anchor + np.einsum("nij,nj->ni", _pinv(self.sum(m)), self.sum(np.einsum("nij,nj->ni", m, self.c - self.anchor[self.of])))
        apart = np.sqrt(self.sum(((self.c - self.anchor[self.of]) ** 2).sum(1))) > 1e-12 * (1 + np.abs(self.anchor).max(1, initial=0))
        return p, apart & self.every((self.d * (p[self.of] - self.c)).sum(1) > 0)

    def inverse_depth(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, rho, there): points as directions and inverse depths from their anchors; the anchor itself has none."""
        off = p - self.anchor
        far = np.linalg.norm(off, axis=1)
        ok = np.isfinite(far) & (far > 0)
        safe = np.where(ok, far, 1)
        return np.where(ok[:, None], off / safe[:, None], [0.0, 0.0, 1.0]), np.where(ok, 1 / safe, 0.0), ok

    def refined(self, u: np.ndarray, rho: np.ndarray, soft: float | None = None, steps: int = STEPS, bearing_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, rho, cost) after damped Gauss-Newton steps of all tracks; a step is kept if it lowers the cost, and doesn't leave the front of the cameras once there."""
        u, rho, cost = u.copy(), rho.copy(), self.cost(u, rho, soft)
        damp, front = np.full(self.total, 1e-4), self.in_front(u, rho)
        live = np.ones(self.total, bool)  # a track that has settled takes no part in later steps
        for _ in range(steps):
            k = np.flatnonzero(live)
            if not len(k):
                break
            tracks = self.only(live)
            g, h, t = tracks.normal_equations(u[k], rho[k], soft)
            if bearing_only:
                g[:, 2], h[:, 2, :], h[:, :, 2] = 0, 0, 0
            settled, open_ = np.ones(len(k), bool), np.ones(len(k), bool)
            for _ in range(8):
                i = np.flatnonzero(open_)
                part, at = tracks.only(open_), k[i]
                a = h[i] + damp[at, None, None] * np.eye(3) * np.maximum(np.einsum("nii->ni", h[i]), 1e-12)[:, None, :]
                step = -np.einsum("nij,nj->ni", _pinv(a), g[i])
                v = u[at] + np.einsum("nij,nj->ni", t[i], step[:, :2])
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                far = np.maximum(rho[at] + step[:, 2], 0)
                now, ahead = part.cost(v, far, soft), part.in_front(v, far)
                better = (now < cost[at]) & (~front[at] | ahead)
                settled[i] = ~(better & (cost[at] - now > SETTLED * cost[at] + SETTLED))
                won = at[better]
                u[won], rho[won], cost[won] = v[better], far[better], now[better]
                damp[at] = np.where(better, np.maximum(damp[at] / 10, 1e-12), damp[at] * 10)
                front[won] |= ahead[better]
                open_[i] = ~better & (damp[at] <= 1e12)
                if not open_.any():
                    break
            live[k[settled]] = False
        return u, rho, cost


def tangents(u: np.ndarray) -> np.ndarray:
    """Two unit vectors across each u, as columns."""
    axis = np.eye(3)[np.abs(u).argmin(axis=1)] if len(u) else np.zeros((0, 3))
    a = np.cross(u, axis)
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
    return np.stack([a, np.cross(u, a)], axis=2)


def _pinv(a: np.ndarray) -> np.ndarray:
    """Inverses of symmetric matrices; directions that say nothing are left out."""
    if not len(a):
        return a
    values, v = np.linalg.eigh(np.nan_to_num(a, nan=0.0, posinf=1e150, neginf=-1e150))
    good = values > 1e-13 * np.maximum(values[:, -1:], 1e-300)
    return np.einsum("nij,nj,nkj->nik", v, np.where(good, 1 / np.where(good, values, 1), 0.0), v)


def scored(t: Tracks) -> dict[str, np.ndarray]:
    """bearing (bx, by, bz), bearing_cost, depth_score, midpoint_bound, in_front and views of each track."""
    u, cost = t.bearing()
    p, ok = t.midpoint()
    at, rho, there = t.inverse_depth(p)
    # the midpoint's cost is taken from the point itself, as its anchor may be far
    direct = t.sum((t.misses(p[t.of] - t.c) ** 2).sum(1))
    bound = np.where(ok & there, np.maximum(cost - direct, 0), 0.0)
    return {"bx": u[:, 0], "by": u[:, 1], "bz": u[:, 2], "bearing_cost": cost, "depth_score": t.depth_score(u), "midpoint_bound": bound, "in_front": t.in_front(u, np.zeros(t.total)), "views": t.views}


def is_finite(s: dict[str, np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """The decision: the bearing costs the threshold or more, and the score or the bound promises as much."""
    return (s["bearing_cost"] >= threshold) & ((s["depth_score"] >= threshold) | (s["midpoint_bound"] >= threshold))


def fitted(t: Tracks, start: np.ndarray | None = None, soft: float | None = None, steps: int = STEPS) -> dict[str, np.ndarray]:
    """The best point of each track: ux, uy, uz, rho, point_cost, ratio, point_in_front, and px, py, pz (none where rho is 0).

    Fits begin at the bearing, at the midpoint where it is in front, and at start where given and finite. Of those that
    cost no more than the bearing, the cheapest in front of all cameras is taken, else the cheapest.
    """
    zero = np.zeros(t.total)
    u, plain = t.bearing()
    bearing = (u, zero, plain) if soft is None else t.refined(u, zero, soft, steps, bearing_only=True)
    runs = [bearing, t.refined(bearing[0], zero, soft, steps)]
    p, ok = t.midpoint()
    for at, good in [(p, ok)] + ([(start, np.isfinite(start).all(axis=1))] if start is not None else []):
        v, rho, there = t.inverse_depth(np.where(good[:, None], at, t.anchor))
        a, b, c = t.refined(v, rho, soft, steps)
        runs.append((a, b, np.where(good & there, c, np.inf)))
    front = np.stack([t.in_front(v, rho) for v, rho, _ in runs])
    costs = np.stack([c for *_, c in runs])
    allowed = costs <= bearing[2] * (1 + 1e-12) + 1e-12
    best = np.where(front & allowed, costs, np.where(allowed, costs + 1e200, np.inf)).argmin(axis=0)
    pick = lambda k: np.stack([r[k] for r in runs])[best, np.arange(t.total)]
    v, rho, cost = pick(0), pick(1), pick(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = np.where(rho[:, None] > 0, t.anchor + v / rho[:, None], np.nan)
    return {"ux": v[:, 0], "uy": v[:, 1], "uz": v[:, 2], "rho": rho, "point_cost": cost, "ratio": np.maximum(bearing[2] - cost, 0), "point_in_front": front[best, np.arange(t.total)], "px": at[:, 0], "py": at[:, 1], "pz": at[:, 2]}


_SCORES = "bx double, by double, bz double, bearing_cost double, depth_score double, midpoint_bound double, in_front boolean, views long"
_FIT = "ux double, uy double, uz double, rho double, point_cost double, ratio double, point_in_front boolean, px double, py double, pz double"


def _by_track(rays: DataFrame, key: str, work, columns: str, *others: str) -> DataFrame:
    """work(Tracks, frame with a row for each track) over whole tracks, many at a time; a track with fewer than two usable rays gives no row."""
    kind = dict(rays.dtypes)[key]

    def run(batches):
        for f in whole_groups(batches, key):
            new = (f[key] != f[key].shift()).to_numpy()
            t = Tracks(np.cumsum(new) - 1, f[list(RAY)].to_numpy(float))
            first = f[new].reset_index(drop=True)
            found = pd.DataFrame({key: first[key]} | work(t, first))
            yield found[(t.views >= 2) & np.isfinite(t.bearing()[1])]

    n = int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rays.where(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in RAY], *others).repartition(n, key).sortWithinPartitions(key)
    return dealt.mapInPandas(run, f"`{key}` {kind}, {columns}")


def scores(rays: DataFrame, key: str, threshold: float = THRESHOLD) -> DataFrame:
    """The score of each track's bearing: key, bx, by, bz, bearing_cost, depth_score, midpoint_bound, in_front, views, finite.

    rays has key and RAY. Rays that aren't finite, have no direction or no noise take no part; a track with fewer than two
    others has no row.
    """

    def work(t, _):
        s = scored(t)
        return s | {"finite": is_finite(s, threshold)}

    return _by_track(rays, key, work, f"{_SCORES}, finite boolean")


def fits(rays: DataFrame, key: str, starts: DataFrame | None = None, soft: float | None = None, steps: int = STEPS) -> DataFrame:
    """Both models of each track, fitted: the columns of scores() but finite, and ux, uy, uz, rho, point_cost, ratio, point_in_front, px, py, pz.

    starts (key, x, y, z) are points to begin at besides. soft is the scale of a soft-L1 loss of each ray's miss, in units
    of the noise; ratio is then smaller wherever a ray is far off, and only plain least squares has the stated law.
    """
    others = []
    if starts is not None:
        rays, others = rays.join(starts.select(key, F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz")), key, "left"), ["sx", "sy", "sz"]

    def work(t, first):
        return scored(t) | fitted(t, first[others].to_numpy(float) if others else None, soft, steps)

    return _by_track(rays, key, work, f"{_SCORES}, {_FIT}", *others)


def classified(points: DataFrame, rays: DataFrame, least_depth: float, threshold: float = THRESHOLD) -> DataFrame:
    """(point, x, y, z, w, verdict): points (point, x, y, z, w) as finite ones or as directions (w = 0), by what their rays ask for.

    A direction whose rays ask for a depth is promoted to the fitted point; a finite point whose rays don't is demoted to
    its bearing. A position is usable that is in front of all its cameras and no nearer to one than least_depth; a finite
    point whose position isn't is refitted from there, or demoted where that gives none. Where the bearing is behind a
    camera a point stays as it is. Verdicts: kept, promoted, demoted, refitted, bearing_behind_camera, no_usable_point,
    left_unusable, unscored (fewer than two usable rays).
    """
    own = points.select("point", *[F.col(c).cast("double").alias(c) for c in "xyzw"])
    joined = rays.join(own, "point")

    def work(t, first):
        held, w = first[["x", "y", "z"]].to_numpy(float), first["w"].to_numpy(float)
        s = scored(t)
        finite = is_finite(s, threshold)
        far = w == 0

        def usable(p):
            off = p[t.of] - t.c
            return np.isfinite(p).all(axis=1) & t.every(((t.d * off).sum(1) > 0) & (np.linalg.norm(off, axis=1) >= least_depth))

        good = usable(held) & ~far
        asked = finite & ~good  # of no other track is the fitted point looked at
        at, fits_ = np.full(held.shape, np.nan), np.zeros(t.total, bool)
        if asked.any():
            fit = fitted(t.only(asked), np.where(far[:, None], np.nan, held)[asked])
            at[asked] = np.stack([fit["px"], fit["py"], fit["pz"]], axis=1)
            fits_[asked] = (fit["ratio"] >= threshold) & fit["point_in_front"]
        fits_ &= usable(at)
        verdict = np.where(far, np.where(~finite, "kept", np.where(fits_, "promoted", "no_usable_point")), np.where(finite & good, "kept", np.where(finite & fits_, "refitted", np.where(s["in_front"], "demoted", np.where(finite, "left_unusable", "bearing_behind_camera")))))
        placed, turned = np.isin(verdict, ["promoted", "refitted"]), verdict == "demoted"
        bearing = np.stack([s["bx"], s["by"], s["bz"]], axis=1)
        p = np.where(placed[:, None], at, np.where(turned[:, None], bearing, held))
        return {"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "w": np.where(placed, 1.0, np.where(turned, 0.0, w)), "verdict": verdict}

    done = _by_track(joined, "point", work, "x double, y double, z double, w double, verdict string", "x", "y", "z", "w")
    rest = own.join(done.select("point"), "point", "left_anti").withColumn("verdict", F.lit("unscored"))
    return done.unionByName(rest)


def angular_noise(pixels: float | Column, focal: Column) -> Column:
    """The standard deviation of a ray, in radians, from that of its pixel."""
    return F.lit(pixels) / focal
