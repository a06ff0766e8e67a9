"""Queries of the point-or-bearing test and of points at infinity.

Orders are tracks: those with even keys see a planted point, those with odd keys a planted direction, from the suppliers'
places. Embeddings are features: their first three components are a direction, all of them a descriptor.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from covista.operators import bearings, infinity

from .queries import table
from .registry import register

#: The planted point or direction of an order, and the supplier's place.
_PLANTED = """
r AS (SELECT l_orderkey AS track, (l_suppkey % 13) / 10.0::DOUBLE AS cx, (l_suppkey % 7) / 10.0::DOUBLE AS cy FROM lineitem),
t AS (SELECT track, track % 2 = 0 AS near, (track % 5)::DOUBLE - 2 AS x, (track % 3)::DOUBLE - 1 AS y, (CASE WHEN track % 2 = 0 THEN 4.0 + track % 4 ELSE 3.0 END)::DOUBLE AS z, count(*) AS views, count(DISTINCT (cx, cy)) > 1 AS apart FROM r GROUP BY ALL)"""


def _rays(spark, sf_dir):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    o = table(spark, sf_dir, "lineitem").select(k.alias("track"), (s % 13 / 10.0).alias("cx"), (s % 7 / 10.0).alias("cy"), F.lit(0.0).alias("cz"))
    near = F.col("track") % 2 == 0
    x, y, z = (F.col("track") % 5).cast("double") - 2, (F.col("track") % 3).cast("double") - 1, F.when(near, 4.0 + F.col("track") % 4).otherwise(3.0)
    off = lambda p, c: p - F.when(near, c).otherwise(0.0)
    return o.withColumns({"x": x, "y": y, "z": z, "dx": off(x, F.col("cx")), "dy": off(y, F.col("cy")), "dz": off(z, F.col("cz")), "sigma": F.lit(1e-3)})


@register("bearing_scores", f"WITH {_PLANTED} SELECT track, views, near AND apart AS finite, CASE WHEN NOT near THEN round(x / sqrt(x * x + y * y + z * z), 6) END AS bx, CASE WHEN NOT near THEN round(z / sqrt(x * x + y * y + z * z), 6) END AS bz FROM t WHERE views > 1")
def bearing_scores(spark, sf_dir):
    s = bearings.scores(_rays(spark, sf_dir), "track")
    far = lambda c: F.when(F.col("track") % 2 == 1, F.round(c, 6) + 0.0).alias(c)
    return s.select("track", "views", "finite", far("bx"), far("bz"))


@register("point_fits", f"WITH {_PLANTED} SELECT track, round(x, 3) AS px, round(y, 3) AS py, round(z, 3) AS pz, true AS ahead FROM t WHERE views > 1 AND near AND apart")
def point_fits(spark, sf_dir):
    f = bearings.fits(_rays(spark, sf_dir), "track").where(F.col("ratio") >= bearings.THRESHOLD)
    return f.select("track", *[(F.round(c, 3) + 0.0).alias(c) for c in ("px", "py", "pz")], F.col("point_in_front").alias("ahead"))


@register("points_classified", f"""WITH {_PLANTED}, s AS (SELECT *, (track % 3 > 0) = near AS finite FROM t)
SELECT track AS point, CASE WHEN views < 2 THEN 'unscored' WHEN near AND apart THEN CASE WHEN finite THEN 'kept' ELSE 'promoted' END WHEN finite THEN 'demoted' ELSE 'kept' END AS verdict,
       CASE WHEN views < 2 THEN finite ELSE near AND apart END AS placed FROM s""")
def points_classified(spark, sf_dir):
    """A third of the points is stored as what it isn't."""
    rays = _rays(spark, sf_dir)
    p = rays.groupBy("track").agg(*[F.first(c).alias(c) for c in "xyz"])
    near, right = F.col("track") % 2 == 0, F.col("track") % 3 > 0
    finite = F.when(right, near).otherwise(~near)
    by = F.when(finite & ~near, 500.0).otherwise(1.0)
    stored = p.select(F.col("track").alias("point"), *[(F.col(c) * by).alias(c) for c in "xyz"], finite.cast("double").alias("w"))
    out = bearings.classified(stored, rays.drop("x", "y", "z").withColumnRenamed("track", "point"), 0.05)
    return out.select("point", "verdict", (F.col("w") == 1).alias("placed"))


_DEGREES, _FARTHEST, _RATIO = 20.0, 220.0, 0.97
_FEATURES = """
e AS (SELECT vec_id AS id, label AS image, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, list_transform(embedding, lambda v: round(v::DOUBLE * 100)::INTEGER) AS v FROM embeddings),
f AS (SELECT id, image, x / sqrt(x * x + y * y + z * z) AS dx, y / sqrt(x * x + y * y + z * z) AS dy, z / sqrt(x * x + y * y + z * z) AS dz, v FROM e)"""
_MATCHES = f"""{_FEATURES},
d AS (SELECT a.id AS a, b.image AS image_b, b.id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::DOUBLE AS distance
      FROM f a JOIN f b ON a.image <> b.image AND pow(a.dx - b.dx, 2) + pow(a.dy - b.dy, 2) + pow(a.dz - b.dz, 2) <= {infinity.chord(_DEGREES) ** 2!r}),
k AS (SELECT *, row_number() OVER (PARTITION BY a, image_b ORDER BY distance, b) AS nth, lead(distance) OVER (PARTITION BY a, image_b ORDER BY distance, b) AS second FROM d),
one AS (SELECT a, b, distance FROM k WHERE nth = 1 AND distance < {_FARTHEST**2} AND (second IS NULL OR distance < {_RATIO * _RATIO!r} * second))"""


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[k].cast("double") for k in range(3)]
    size = F.sqrt(x[0] * x[0] + x[1] * x[1] + x[2] * x[2])
    return e.select(F.col("vec_id").alias("feature_id"), F.col("label").cast("long").alias("image"), *[(c / size).alias(n) for c, n in zip(x, ("dx", "dy", "dz"), strict=True)], F.transform("embedding", lambda v: F.round(v.cast("double") * 100).cast("int")).alias("descriptor"))


@register("infinity_matches", f"WITH {_MATCHES} SELECT a, b, distance FROM one")
def infinity_matches(spark, sf_dir):
    return infinity.directed_matches(_features(spark, sf_dir), _DEGREES, _FARTHEST, _RATIO)


@register("infinity_tracks", f"""WITH RECURSIVE {_MATCHES},
m AS (SELECT x.a, x.b, x.distance FROM one x JOIN one y ON x.a = y.b AND x.b = y.a),
w AS (SELECT a AS id, a AS root FROM m UNION SELECT m.b, w.root FROM w JOIN m ON m.a = w.id WHERE w.root < m.b),
g AS (SELECT id, min(root) AS track FROM (SELECT id, root FROM w UNION ALL SELECT DISTINCT a, a FROM m) GROUP BY id),
c AS (SELECT track, image, f.id, row_number() OVER (PARTITION BY track, image ORDER BY (SELECT sum(distance) FROM m WHERE m.a = f.id), f.id) AS nth FROM g JOIN f ON f.id = g.id)
SELECT track, image, id AS feature_id FROM c WHERE nth = 1 QUALIFY count(*) OVER (PARTITION BY track) >= 3""")
def infinity_tracks(spark, sf_dir):
    return infinity.candidate_tracks(_features(spark, sf_dir), _DEGREES, _FARTHEST, _RATIO, 3)
