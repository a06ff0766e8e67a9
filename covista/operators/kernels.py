"""Numeric solves from sums: rows are reduced to small sums by Spark, and only these are solved in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triangulated(rays: DataFrame, key: str, centre: tuple[str, str, str], direction: tuple[str, str, str]) -> DataFrame:
    """(key, n, x, y, z): the point nearest to each track's rays by least squares; null where the rays don't fix one.

    The normal equations are sums over rays, so tracks are combined before the shuffle and no group is held.
    """
    d, c = [F.col(x) for x in direction], [F.col(x) for x in centre]
    norm = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    u = [x / F.when(norm > 0, norm) for x in d]  # a ray without a direction is left out of all sums
    m = [[F.lit(float(i == j)) - u[i] * u[j] for j in range(3)] for i in range(3)]
    names = [f"m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"b{i}" for i in range(3)]
    sums = [F.sum(m[i][j]) for i in range(3) for j in range(i, 3)]
    sums += [F.sum(sum((m[i][j] * c[j] for j in range(3)), F.lit(0.0))) for i in range(3)]

    def solve(frames):
        for f in frames:
            a, b = np.zeros((len(f), 3, 3)), np.stack([f[f"b{i}"] for i in range(3)], axis=1)
            for i in range(3):
                for j in range(i, 3):
                    a[:, i, j] = a[:, j, i] = f[f"m{i}{j}"]
            ok = np.linalg.eigvalsh(a)[:, 0] > 1e-9
            x = np.full((len(f), 3), np.nan)
            if ok.any():
                x[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
            yield pd.DataFrame({key: f[key], "n": f["n"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    grouped = rays.groupBy(key).agg(F.count(F.when(norm > 0, 1)).alias("n"), *[F.coalesce(s, F.lit(0.0)).alias(c) for s, c in zip(sums, names, strict=True)])
    return grouped.mapInPandas(solve, f"{key} {dict(rays.dtypes)[key]}, n long, x double, y double, z double")


def similarity(pairs: DataFrame, source: tuple[str, str, str], target: tuple[str, str, str]) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, rotation, translation) that moves source points onto target points best by least squares, from one pass of sums."""
    s, t = [F.col(x) for x in source], [F.col(x) for x in target]
    row = pairs.agg(F.count("*"), *[F.sum(x) for x in (*s, *t)], F.sum(sum((x * x for x in s), F.lit(0.0))), *[F.sum(a * b) for a in t for b in s]).first()
    n = row[0]
    if n < 3:
        raise ValueError("three pairs and more are needed")
    ms, mt = np.array(row[1:4]) / n, np.array(row[4:7]) / n
    cov = np.array(row[8:17]).reshape(3, 3) / n - np.outer(mt, ms)
    u, d, v = np.linalg.svd(cov)
    flip = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(v))])
    rotation = u @ flip @ v
    scale = float((d * np.diag(flip)).sum() / (row[7] / n - ms @ ms))
    return scale, rotation, mt - scale * rotation @ ms
