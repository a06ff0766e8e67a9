"""Queries over ordered frames: events are frames of a user's sequence, part and lineitem those of one long sequence."""

from __future__ import annotations

from pyspark.sql import functions as F

from covista.functions import geometry as g
from covista.operators import motion

from .queries import table
from .registry import register

_C, _Q = ("cx", "cy", "cz"), ("qw", "qx", "qy", "qz")
#: Frames with a centre and a unit quaternion about a tilted axis, from the events.
_FRAMES = "f AS (SELECT user_id, event_id, value AS cx, value * value / 100 AS cy, (event_id % 7)::DOUBLE AS cz, cos(value / 200) AS qw, 0.6 * sin(value / 200) AS qx, 0.0::DOUBLE AS qy, 0.8 * sin(value / 200) AS qz FROM events)"


def _frames(spark, sf_dir):
    v, half = F.col("value"), F.col("value") / 200
    return table(spark, sf_dir, "events").select("user_id", "event_id", v.alias("cx"), (v * v / 100).alias("cy"), (F.col("event_id") % 7).cast("double").alias("cz"), F.cos(half).alias("qw"), (0.6 * F.sin(half)).alias("qx"), F.lit(0.0).alias("qy"), (0.8 * F.sin(half)).alias("qz"))


_DOT = lambda a, b: " + ".join(f"{a}.{c} * {b}.{c}" for c in _Q)
_TURN = lambda a, b: f"degrees(2 * acos(least(1, abs({_DOT(a, b)}))))"
_FAR = lambda a, b: f"sqrt({' + '.join(f'pow({a}.{c} - {b}.{c}, 2)' for c in _C)})"
_NUMBERED = f"WITH {_FRAMES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM f)"


@register("motion_path", f"""{_NUMBERED}, s AS (SELECT c.user_id, c.event_id, {_FAR("c", "b")} AS step, {_TURN("c", "b")} AS rotation,
    sqrt({" + ".join(f"pow(c.{x} - (b.{x} + a.{x}) / 2, 2)" for x in _C)}) AS bend
    FROM n c LEFT JOIN n b ON b.user_id = c.user_id AND b.k = c.k - 1 LEFT JOIN n a ON a.user_id = c.user_id AND a.k = c.k + 1)
  SELECT user_id, event_id, round(step, 5) AS step, round(rotation, 4) AS rotation, round(bend, 5) AS bend,
    coalesce(step > avg(step) OVER p + 2.5 * stddev_pop(step) OVER p, false) OR coalesce(rotation > avg(rotation) OVER p + 2.5 * stddev_pop(rotation) OVER p, false) AS jump FROM s WINDOW p AS (PARTITION BY user_id)""")
def motion_path(spark, sf_dir):
    x = motion.motion_path(_frames(spark, sf_dir), "user_id", "event_id", _C, _Q)
    return x.select("user_id", "event_id", F.round("step", 5).alias("step"), F.round("rotation", 4).alias("rotation"), F.round("bend", 5).alias("bend"), "jump")


def _line(a, b):
    return [f"({a}.{c} + ({b}.{c} - {a}.{c}) * (c.event_id - {a}.event_id) / ({b}.event_id - {a}.event_id)::DOUBLE)" for c in _C]


def _parabola(a, b, d):
    w = lambda x, y, z: f"((c.event_id - {y}.event_id)::DOUBLE / ({x}.event_id - {y}.event_id) * (c.event_id - {z}.event_id) / ({x}.event_id - {z}.event_id))"
    return [f"({w(a, b, d)} * {a}.{c} + {w(b, a, d)} * {b}.{c} + {w(d, a, b)} * {d}.{c})" for c in _C]


_MISS = lambda p: f"sqrt({' + '.join(f'pow({x} - c.{c}, 2)' for x, c in zip(p, _C, strict=True))})"
_AT = lambda name, by: f"LEFT JOIN n {name} ON {name}.user_id = c.user_id AND {name}.k = c.k + {by}"


@register("extrapolation_errors", f"""{_NUMBERED} SELECT c.user_id, c.event_id, round(least({_MISS(_line("l2", "l1"))}, {_MISS(_parabola("l3", "l2", "l1"))}), 3) AS left_trans,
    round(least({_MISS(_line("r2", "r1"))}, {_MISS(_parabola("r1", "r2", "r3"))}), 3) AS right_trans
  FROM n c {_AT("l1", -1)} {_AT("l2", -2)} {_AT("l3", -3)} {_AT("r1", 1)} {_AT("r2", 2)} {_AT("r3", 3)}""")
def extrapolation_errors(spark, sf_dir):
    x = motion.extrapolation_errors(_frames(spark, sf_dir), "user_id", "event_id", _C, _Q)
    return x.select("user_id", "event_id", F.round("left_trans", 3).alias("left_trans"), F.round("right_trans", 3).alias("right_trans"))


_SEEN = "s AS (SELECT DISTINCT p.pos, l.l_orderkey AS item FROM lineitem l JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) p ON p.p_partkey = l.l_partkey), e AS (SELECT pos AS edge FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) WHERE pos < (SELECT count(*) FROM part) - 1)"


def _sides(window):
    return f"""WITH {_SEEN}, x AS (SELECT edge, item, bool_or(pos <= edge) AS b, bool_or(pos > edge) AS a FROM e JOIN s ON s.pos BETWEEN edge - {window - 1} AND edge + {window} GROUP BY ALL),
      c AS (SELECT edge::INTEGER AS edge, count(*) FILTER (b) AS "before", count(*) FILTER (a) AS "after", count(*) FILTER (a AND b) AS "both" FROM x GROUP BY edge)"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.lit("all").alias("seq"), F.col("p_partkey").alias("frame")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("frame"), F.col("l_orderkey").alias("item"))


@register("shared_across_edges", _sides(8) + " SELECT * FROM c")
def shared_across_edges(spark, sf_dir):
    x = motion.shared_across(*_parts(spark, sf_dir), "seq", "frame", "frame", "item", motion.BREAK_WINDOW)
    return x.where("before > 0 or after > 0").select(F.col("edge").cast("int").alias("edge"), "before", "after", "both")


@register("consecutive_shared", _sides(1) + " SELECT e.edge::INTEGER AS edge, coalesce(\"both\", 0) AS shared FROM e LEFT JOIN c ON c.edge = e.edge")
def consecutive_shared(spark, sf_dir):
    return motion.shared_by_neighbours(*_parts(spark, sf_dir), "seq", "frame", "frame", "item").select(F.col("edge").cast("int").alias("edge"), "shared")


@register("overlap_drop", _sides(16) + """, o AS (SELECT edge, "both" / least("before", "after")::DOUBLE AS overlap FROM c WHERE least("before", "after") > 0),
  w AS (SELECT a.edge, any_value(a.overlap) AS overlap, count(*) AS n, quantile_cont(b.overlap, 0.5) AS base FROM o a JOIN o b ON b.edge <> a.edge AND b.edge BETWEEN a.edge - 24 AND a.edge + 24 GROUP BY a.edge)
  SELECT edge, round(overlap, 8) AS overlap, round(CASE WHEN n < 3 THEN NULL WHEN overlap = 0 THEN 'inf'::DOUBLE WHEN base > 0 THEN base / overlap END, 6) AS drop FROM w""")
def overlap_drop(spark, sf_dir):
    x = motion.overlap_drops(*_parts(spark, sf_dir), "seq", "frame", "frame", "item")
    return x.where("overlap is not null").select(F.col("edge").cast("int").alias("edge"), F.round("overlap", 8).alias("overlap"), F.when(F.col("drop") == float("inf"), F.col("drop")).otherwise(F.round("drop", 6)).alias("drop"))


_EDGES = "e AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS k, l_quantity AS rotation, 1 + l_linenumber % 3 AS gap, l_linenumber AS shared, (l_orderkey % 5)::BIGINT AS nearby FROM lineitem)"


@register("break_verdicts", f"""WITH {_EDGES}, m AS (SELECT s, quantile_cont(rotation / gap, 0.5) AS r, quantile_cont(gap, 0.5) AS g, quantile_cont(shared, 0.5) AS c, quantile_cont(nearby, 0.5) AS b FROM e GROUP BY s)
  SELECT s, o, k, round(rotation / (r * greatest(gap, g)), 6) AS ratio, rotation / (r * greatest(gap, g)) > 4 AND shared < 0.2 * c AND nearby < 0.2 * b AS is_break FROM e JOIN m USING (s)""")
def break_verdicts(spark, sf_dir):
    n = F.col("l_linenumber")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("o"), n.alias("k"), F.col("l_quantity").alias("rotation"), (1 + n % 3).alias("gap"), n.alias("shared"), (F.col("l_orderkey") % 5).alias("nearby"))
    return motion.break_verdicts(e, "s").select("s", "o", "k", F.round("ratio", 6).alias("ratio"), "is_break")


_READINGS = ("left_trans", "left_rot", "right_trans", "right_rot", "step_ratio", "overlap_drop", "obs_z")
_VALUES = ("l_quantity", "l_quantity - 20", "l_linenumber", "50 - l_quantity", "l_discount * 20", "l_tax * 30", "l_linenumber - 6.0")
_LISTED = "list_filter([CASE WHEN left_trans > 30 THEN 'L.t' END, CASE WHEN left_rot > 15 THEN 'L.r' END, CASE WHEN right_trans > 30 THEN 'R.t' END, CASE WHEN right_rot > 15 THEN 'R.r' END, CASE WHEN step_ratio > 1.5 THEN 'Step' END, CASE WHEN overlap_drop > 1.8 THEN 'Cov' END, CASE WHEN obs_z < -2.5 THEN 'Obs' END], lambda x: x IS NOT NULL)"
_R = "r AS (SELECT l_orderkey, l_linenumber - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, " + ", ".join(f"({v})::DOUBLE AS {r}" for r, v in zip(_READINGS, _VALUES, strict=True)) + " FROM lineitem)"


def _flagged(spark, sf_dir):
    from pyspark.sql.window import Window

    x = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("pos"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"), *[F.expr(f"double({v})").alias(r) for r, v in zip(_READINGS, _VALUES, strict=True)])
    return x.select("l_orderkey", "pos", "n", motion.frame_flags(*g.columns(*_READINGS), F.lit(30.0)).alias("flags"))


@register("frame_flags", f"WITH {_R} SELECT l_orderkey, pos, array_to_string({_LISTED}, ' ') AS flags FROM r")
def frame_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("l_orderkey", "pos", F.array_join("flags", " ").alias("flags"))


@register("flagged_edges", f"""WITH {_R}, f AS (SELECT l_orderkey, pos, n, unnest({_LISTED}) AS flag FROM r), o AS (SELECT l_orderkey, pos - CASE WHEN flag LIKE 'R%' THEN 0 ELSE 1 END AS edge, pos, flag, n FROM f WHERE flag <> 'Obs'),
  k AS (SELECT * FROM o WHERE edge >= 0 AND edge < n - 1), b AS (SELECT l_orderkey, pos - 1 AS edge, pos, flag FROM f WHERE flag = 'Obs' UNION ALL SELECT l_orderkey, pos, pos, flag FROM f WHERE flag = 'Obs'),
  u AS (SELECT l_orderkey, edge, pos, flag FROM k UNION ALL SELECT * FROM b WHERE (l_orderkey, edge) IN (SELECT (l_orderkey, edge) FROM k))
  SELECT l_orderkey, edge, string_agg(pos || ':' || flag, ' ' ORDER BY pos, flag) AS evidence FROM u GROUP BY ALL""")
def flagged_edges(spark, sf_dir):
    x = motion.flagged_edges(_flagged(spark, sf_dir), "l_orderkey")
    return x.select("l_orderkey", "edge", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["pos"], e["flag"])), " ").alias("evidence"))


@register("classify_ratio", "SELECT event_id, CASE WHEN value / 50 < 0.5 THEN 'strong deceleration' WHEN value / 50 < 0.75 THEN 'deceleration' WHEN value / 50 > 2 THEN 'strong acceleration' WHEN value / 50 > 1 / 0.75 THEN 'acceleration' END AS what FROM events")
def classify_ratio(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", motion.classify_ratio(F.col("value") / 50).alias("what"))
