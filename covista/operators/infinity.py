"""Points at infinity: found among features whose directions and descriptors agree across images, and told from finite points.

Directions are binned in cells of space around the sphere, so poles and seams are like any other place. Features ask the
cells that their radius touches, 8 at most; a crowded cell is dealt into blocks, and two blocks say no more of a feature
than its best and second-best match in each image, however many are near.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bearings, graphs
from .tables import cut

#: Features of a block, on average.
BLOCK = 1024


def chord(degrees: float) -> float:
    """The distance of two unit vectors so many degrees apart."""
    return float(np.sqrt(2 * (1 - np.cos(np.radians(degrees)))))


def directed_matches(features: DataFrame, degrees: float, farthest: float, ratio: float, block: int = BLOCK) -> DataFrame:
    """(a, b, distance): for each feature and each other image the best match by descriptor among features no more than `degrees` away.

    features has (feature_id, image, dx, dy, dz, descriptor), directions of length 1. distance is the squared L2 distance.
    A best match counts if it is under farthest squared, and under ratio squared times the second best where there is one;
    ties go to the lesser id, and a tie of the two best is no match unless ratio is above 1.
    """
    r = chord(degrees)
    width = max(2 * r, 1e-9)
    f = features.where("image is not null").select("feature_id", "image", *[F.col(c).cast("double").alias(c) for c in ("dx", "dy", "dz")], F.transform("descriptor", lambda x: x.cast("double")).alias("v"))
    own = cut(f.where("not isnan(dx) and not isnan(dy) and not isnan(dz)").select("*", *[F.floor(F.col(c) / width).alias(f"k{c}") for c in ("dx", "dy", "dz")]))
    cell = ["kdx", "kdy", "kdz"]
    sizes = cut(own.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("long").alias("parts")))
    part = lambda n: F.pmod(F.xxhash64("feature_id"), F.col(n))
    ask = own.drop(*cell)
    for c in ("dx", "dy", "dz"):
        ask = ask.withColumn(f"k{c}", F.explode(F.sequence(F.floor((F.col(c) - r) / width), F.floor((F.col(c) + r) / width))))
    asked = ask.groupBy(*cell).agg(F.ceil(F.count("*") / block).cast("long").alias("asks"))
    both = cut(sizes.join(asked, cell))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    payload = ["feature_id", "image", "dx", "dy", "dz", "v"]
    left = ask.join(both, cell).select(*cell, part("asks").alias("qb"), every("parts").alias("rb"), *payload).toDF(*cell, "qb", "rb", *payload)
    right = own.join(both, cell).select(*cell, every("asks").alias("qb"), part("parts").alias("rb"), *payload).toDF(*cell, "qb", "rb", *payload)
    keys = [*cell, "qb", "rb"]
    schema = "a long, image_b long, best double, b long, second double"

    def compare(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "image_b": [], "best": [], "b": [], "second": []})
        y = y.sort_values(["image", "feature_id"])
        (i, p, u, v), (j, q, s, w) = ((d["feature_id"].to_numpy(), d["image"].to_numpy(), d[["dx", "dy", "dz"]].to_numpy(), np.stack(d["v"])) for d in (x, y))
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        ends = np.concatenate((first[1:], [len(q)]))
        out = []
        for at in range(0, len(i), 256):  # bounds what is held of one pair of blocks
            part = slice(at, at + 256)
            near = ((u[part, None, :] - s[None]) ** 2).sum(2) <= r * r
            near &= p[part, None] != q
            exact = np.full(near.shape, np.inf)
            for k in np.flatnonzero(near.any(axis=1)):
                exact[k, near[k]] = ((w[near[k]] - v[at + k]) ** 2).sum(1)
            for a, b in zip(first, ends, strict=True):
                e = exact[:, a:b]
                best = e.argmin(axis=1)
                least = e[np.arange(len(e)), best]
                e[np.arange(len(e)), best] = np.inf
                second = e.min(axis=1)
                ok = np.isfinite(least)
                out.append((i[part][ok], np.full(int(ok.sum()), q[a]), least[ok], j[a:b][best[ok]], second[ok]))
        return pd.DataFrame(dict(zip(("a", "image_b", "best", "b", "second"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, schema))
    # blocks and cells are put together: the second best may be another block's best
    w = Window.partitionBy("a", "image_b").orderBy("best", "b")
    x = found.withColumn("nth", F.row_number().over(w)).withColumn("other", F.min("second").over(Window.partitionBy("a", "image_b"))).withColumn("next", F.lead("best").over(w)).where("nth = 1")
    x = x.withColumn("second", F.least(F.coalesce("next", F.lit(float("inf"))), "other"))
    good = (F.col("best") < farthest * farthest) & ((F.col("second") == float("inf")) | (F.col("best") < ratio * ratio * F.col("second")))
    return x.where(good).select("a", "b", F.col("best").alias("distance"))


def candidate_tracks(features: DataFrame, degrees: float, farthest: float, ratio: float, views: int, block: int = BLOCK) -> DataFrame:
    """(track, image, feature_id): groups of features that match each other across images, one of an image; track is the group's least id.

    Matches count that are best both ways; groups are what hangs together by them. Of an image's features in a group the
    one with the least sum of distances to its matches stays (ties by id), and groups with fewer than `views` images go.
    """
    one = cut(directed_matches(features, degrees, farthest, ratio, block))
    mutual = cut(one.join(one.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]))
    roots = graphs.connected_groups(mutual, "a", "b")
    support = mutual.groupBy(F.col("a").alias("feature_id")).agg(F.sum("distance").alias("support"))
    members = support.join(roots.withColumnRenamed("id", "feature_id"), "feature_id").join(features.select("feature_id", "image"), "feature_id")
    nth = Window.partitionBy("root", "image").orderBy("support", "feature_id")
    members = cut(members.withColumn("nth", F.row_number().over(nth)).where("nth = 1"))
    wide = members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= views)
    return members.join(wide.select("root"), "root").select(F.col("root").alias("track"), "image", "feature_id")


def decided(tracks: DataFrame, rays: DataFrame, threshold: float = bearings.THRESHOLD) -> DataFrame:
    """(track, decision, bx, by, bz): bearing, finite, bearing_behind_camera or unscored, from rays (feature_id and bearings.RAY)."""
    s = bearings.scores(tracks.join(rays, "feature_id"), "track", threshold)
    decision = F.when(F.col("finite"), "finite").when(F.col("in_front"), "bearing").otherwise("bearing_behind_camera")
    s = s.select("track", decision.alias("decision"), "bx", "by", "bz")
    return tracks.select("track").distinct().join(s, "track", "left").withColumn("decision", F.coalesce("decision", F.lit("unscored")))


def found_points(features: DataFrame, rays: DataFrame, degrees: float = 1.0, farthest: float = 250.0, ratio: float = 0.8, views: int = 2, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, observations) of points at infinity: points (track, x, y, z, w = 0, error), observations (track, image, feature_id).

    Features of `used` (feature_id), which finite points have, take no part. A candidate becomes a point if its rays ask
    for no depth, and its bearing is in front of all its cameras. error is the root of the mean squared angle to its rays.
    """
    free = features if used is None else features.join(used.select("feature_id"), "feature_id", "left_anti")
    tracks = cut(candidate_tracks(free, degrees, farthest, ratio, views))
    points = cut(decided(tracks, rays).where("decision = 'bearing'"))
    seen = tracks.join(points.select("track", "bx", "by", "bz"), "track")
    angle = 1 - (F.col("bx") * F.col("dx") + F.col("by") * F.col("dy") + F.col("bz") * F.col("dz"))
    error = seen.join(rays, "feature_id").groupBy("track").agg(F.sqrt(F.avg(2 * F.greatest(angle, F.lit(0.0)))).alias("error"))
    out = points.join(error, "track").select("track", F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"), F.lit(0.0).alias("w"), "error")
    return out, seen.select("track", "image", "feature_id")
