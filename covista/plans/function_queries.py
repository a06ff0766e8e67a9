"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from covista.functions import geometry as g
from covista.functions import text

from .queries import table
from .registry import register

_H = "(l_quantity / 40)"
_TURN = f"cos({_H}) AS w, 0.6 * sin({_H}) AS x, 0.0::DOUBLE AS y, 0.8 * sin({_H}) AS z"


def _turns(spark, sf_dir):
    h = F.col("l_quantity") / 40
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.cos(h).alias("w"), (0.6 * F.sin(h)).alias("x"), F.lit(0.0).alias("y"), (0.8 * F.sin(h)).alias("z"), F.col("l_tax").alias("vx"), F.col("l_discount").alias("vy"), F.col("l_linenumber").cast("double").alias("vz"))




def _q():
    return g.columns("w", "x", "y", "z")


def _v():
    return g.columns("vx", "vy", "vz")


_ROTATED = """t AS (SELECT l_orderkey, l_linenumber, %s, l_tax AS vx, l_discount AS vy, l_linenumber::DOUBLE AS vz FROM lineitem),
 m AS (SELECT *, (1 - 2 * (y * y + z * z)) * vx + 2 * (x * y - w * z) * vy + 2 * (x * z + w * y) * vz AS rx, 2 * (x * y + w * z) * vx + (1 - 2 * (x * x + z * z)) * vy + 2 * (y * z - w * x) * vz AS ry, 2 * (x * z - w * y) * vx + 2 * (y * z + w * x) * vy + (1 - 2 * (x * x + y * y)) * vz AS rz FROM t)""" % _TURN  # noqa: UP031


@register("quaternion_rotate", f"WITH {_ROTATED} SELECT l_orderkey, l_linenumber, round(rx, 8) AS rx, round(ry, 8) AS ry, round(rz, 8) AS rz FROM m")
def quaternion_rotate(spark, sf_dir):
    r = g.q_rotate(_q(), _v())
    return _turns(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(c, 8).alias(n) for c, n in zip(r, ("rx", "ry", "rz"), strict=True)])


@register("quaternion_angle", f"WITH {_ROTATED} SELECT l_orderkey, l_linenumber, round(2 * acos(least(1, abs(w))), 5) AS angle FROM m")
def quaternion_angle(spark, sf_dir):
    one = [F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]
    return _turns(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(g.q_angle(_q(), one), 5).alias("angle"))


@register("similarity_points", f"WITH {_ROTATED} SELECT l_orderkey, l_linenumber, round(2 * (-vy) + 1, 6) AS x, round(2 * vx - 2, 6) AS y, round(2 * vz + 0.5, 6) AS z FROM m")
def similarity_points(spark, sf_dir):
    half = 0.5**0.5
    moved = g.Similarity((half, 0.0, 0.0, half), (1.0, -2.0, 0.5), 2.0).apply(_v())
    return _turns(spark, sf_dir).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(moved, "xyz", strict=True)])


@register("camera_centre", f"WITH {_ROTATED} SELECT l_orderkey, l_linenumber, round(sqrt(vx * vx + vy * vy + vz * vz), 6) AS far FROM m")
def camera_centre(spark, sf_dir):
    return _turns(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(g.norm(g.camera_centre(_q(), _v())), 6).alias("far"))


@register("polar_conversion", "SELECT l_orderkey, l_linenumber, round(atan2(l_tax - 0.04, l_discount - 0.05), 7) AS angle, round(sqrt(pow(l_tax - 0.04, 2) + pow(l_discount - 0.05, 2)), 8) AS radius FROM lineitem")
def polar_conversion(spark, sf_dir):
    a, r = g.polar(F.col("l_discount"), F.col("l_tax"), 0.05, 0.04)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(a, 7).alias("angle"), F.round(r, 8).alias("radius"))


@register("camera_projection", "WITH p AS (SELECT l_orderkey, l_linenumber, l_tax / 2 AS x, l_discount / 2 AS y FROM lineitem), d AS (SELECT *, x * x + y * y AS r2 FROM p) SELECT l_orderkey, l_linenumber, round(1000 * x * (1 + r2 * (0.1 + r2 * 0.01)) + 640, 6) AS u, round(1000 * y * (1 + r2 * (0.1 + r2 * 0.01)) + 360, 6) AS v FROM d")
def camera_projection(spark, sf_dir):
    params = F.create_map(*[F.lit(x) for k, v in {"f": 1000.0, "cx": 640.0, "cy": 360.0, "k1": 0.1, "k2": 0.01}.items() for x in (k, v)])
    u, v = g.projected("RADIAL", params, [F.col("l_tax"), F.col("l_discount"), F.lit(2.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@register("pair_ids", "SELECT l_orderkey, l_linenumber, CASE WHEN least(l_suppkey, l_partkey) > 0 THEN least(l_suppkey, l_partkey) * 2147483647 + greatest(l_suppkey, l_partkey) END AS pair FROM lineitem")
def pair_ids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.pair_id(F.col("l_suppkey"), F.col("l_partkey")).alias("pair"))


@register("units", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 0.0254 WHEN 1 THEN p_size::DOUBLE ELSE p_size / 100.0 END AS metres, round(radians(p_size), 9) AS angle FROM part")
def units(spark, sf_dir):
    written = F.concat(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, "in").when(F.col("p_partkey") % 3 == 1, "").otherwise("cm"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.length_column(written, "m"), 9).alias("metres"), F.round(text.angle_column(F.concat("p_size", F.lit("deg"))), 9).alias("angle"))


@register("frame_patterns", r"SELECT c_custkey, regexp_extract(c_name, '^Customer#([0-9]{9})$', 1)::BIGINT AS frame FROM customer")
def frame_patterns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.pattern_frame(F.col("c_name"), "Customer#%09d").alias("frame"))


@register("descriptor_distance", "SELECT l_orderkey, l_linenumber, ((l_linenumber - 3) * (l_linenumber - 3) + (l_suppkey - l_partkey) * (l_suppkey - l_partkey))::BIGINT AS d2 FROM lineitem")
def descriptor_distance(spark, sf_dir):
    a, b = F.array(F.col("l_linenumber").cast("long"), "l_suppkey"), F.array(F.lit(3).cast("long"), "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.squared_distance_of_bytes(a, b).alias("d2"))
