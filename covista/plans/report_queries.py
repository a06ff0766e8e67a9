"""Queries of reports, transforms and coverage lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from covista.operators import aggregates, coverage, estimation, joins, transforms

from .queries import table
from .registry import register

#: Orders are points, suppliers images with poses turned about the y axis, lineitem observations.
_P = "p AS (SELECT o_orderkey AS point, (o_orderkey % 101)::DOUBLE - 50 AS x, (o_orderkey % 53)::DOUBLE - 26 AS y, (o_orderkey % 89)::DOUBLE + 100 AS z, o_totalprice / 100000 AS error FROM orders), i AS (SELECT s_suppkey AS image, cos(s_suppkey / 50) AS qw, sin(s_suppkey / 50) AS qy, (s_suppkey % 7)::DOUBLE AS tx, 0.0::DOUBLE AS ty, (s_suppkey % 5)::DOUBLE AS tz FROM supplier), o AS (SELECT l_orderkey AS point, l_suppkey AS image FROM lineitem)"


def _tables(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    p = table(spark, sf_dir, "orders").select(k.alias("point"), ((k % 101).cast("double") - 50).alias("x"), ((k % 53).cast("double") - 26).alias("y"), ((k % 89).cast("double") + 100).alias("z"), F.lit(1.0).alias("w"), (F.col("o_totalprice") / 100000).alias("error"))
    i = table(spark, sf_dir, "supplier").select(s.alias("image"), F.col("s_name").alias("name"), F.lit(0).alias("camera"), F.cos(s / 50).alias("qw"), F.lit(0.0).alias("qx"), F.sin(s / 50).alias("qy"), F.lit(0.0).alias("qz"), (s % 7).cast("double").alias("tx"), F.lit(0.0).alias("ty"), (s % 5).cast("double").alias("tz"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("feature"))
    return {"points": p, "images": i, "observations": o}


@register("depth_statistics", f"WITH {_P}, d AS (SELECT image, -2 * qw * qy * x + (1 - 2 * qy * qy) * z + tz AS d FROM o JOIN p USING (point) JOIN i USING (image)), g AS (SELECT image, count(*) AS n, min(d) AS a, max(d) AS b, avg(d) AS c, quantile_cont(d, 0.5) AS m FROM d WHERE d > 0 GROUP BY image) SELECT image, coalesce(n, 0) AS n, round(a, 5) AS depth_min, round(b, 5) AS depth_max, round(c, 5) AS depth_mean, round(m, 5) AS depth_median FROM i LEFT JOIN g USING (image)")
def depth_statistics(spark, sf_dir):
    d = transforms.depth_statistics(_tables(spark, sf_dir))
    return d.select("image", "n", *[F.round(c, 5).alias(c) for c in d.columns[2:]])


@register("image_metrics", f"WITH {_P}, l AS (SELECT *, count(*) OVER (PARTITION BY point) AS len FROM o), g AS (SELECT image, count(*) AS n, avg(error) AS mean, quantile_cont(error, 0.5) AS median, max(error) AS max, avg(len) AS t FROM l JOIN p USING (point) GROUP BY image) SELECT image, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(median, 6) AS median, max, round(t, 6) AS track_length FROM i LEFT JOIN g USING (image)")
def image_metrics(spark, sf_dir):
    m = transforms.image_metrics(_tables(spark, sf_dir))
    return m.select("image", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "max", F.round("track_length", 6).alias("track_length"))


@register("reconstruction_summary", f"WITH {_P}, v AS (SELECT 'error' AS measure, error AS v FROM p UNION ALL SELECT 'track_length', count(*) FROM o GROUP BY point UNION ALL SELECT 'observations', coalesce(c, 0) FROM i LEFT JOIN (SELECT image, count(*) AS c FROM o GROUP BY image) USING (image)) SELECT measure, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median FROM v GROUP BY measure")
def reconstruction_summary(spark, sf_dir):
    return transforms.summary(_tables(spark, sf_dir)).withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


@register("scene_bounds", f"WITH {_P}, m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my, quantile_cont(z, 0.5) AS mz FROM p) SELECT round(any_value(mx), 6) AS x, round(any_value(my), 6) AS y, round(any_value(mz), 6) AS z, round(max(sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2))), 6) AS radius FROM p, m")
def scene_bounds(spark, sf_dir):
    b = transforms.scene_bounds(_tables(spark, sf_dir)["points"])
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@register("similarity_transform", f"WITH {_P} SELECT point, round(2 * -y + 1, 6) AS x, round(2 * x + 2, 6) AS y, round(2 * z + 3, 6) AS z FROM p")
def similarity_transform(spark, sf_dir):
    t = _tables(spark, sf_dir)
    steps = [transforms.rotate((0, 0, 1), 1.5707963267948966), transforms.scale(2.0), transforms.translate((1, 2, 3))]
    return transforms.apply_all(t, steps)["points"].select("point", *[F.round(c, 6).alias(c) for c in "xyz"])


@register("image_hops", "WITH RECURSIVE s AS (SELECT l_suppkey AS i, count(*) AS c FROM lineitem GROUP BY 1), e AS (SELECT a.l_suppkey AS i, b.l_suppkey AS j FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey GROUP BY ALL HAVING count(*) >= 3), r AS (SELECT 1::BIGINT AS image, 0 AS hops UNION SELECT e.j, hops + 1 FROM r JOIN e ON e.i = r.image WHERE hops < 10) SELECT s_suppkey AS image, (SELECT min(hops) FROM r WHERE r.image = s_suppkey)::INTEGER AS hops FROM supplier")
def image_hops(spark, sf_dir):
    t = _tables(spark, sf_dir)
    pairs = joins.covisibility(t["observations"], "point", "image").where("shared >= 3")
    return transforms.image_hops(pairs, t["images"], F.col("image") == 1)


_GRID = "s AS (SELECT c_nationkey AS image, c_acctbal / 10 AS x, (c_custkey % 1000)::DOUBLE AS y, c_custkey AS row FROM customer), g AS (SELECT DISTINCT image, cx::INTEGER AS cx, cy::INTEGER AS cy FROM s, range(20) a(cx), range(20) b(cy) WHERE pow((cx + 0.5) * 50 - x, 2) + pow((cy + 0.5) * 50 - y, 2) <= 3600)"


def _covered(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), (F.col("c_acctbal") / 10).alias("x"), (k % 1000).cast("double").alias("y"), k.alias("row"), F.lit(150.0).alias("radius"))
    return aggregates.coverage_grid(p, "image", "x", "y", 60.0, 50.0, 1000, 1000), p


@register("covered_fraction", f"WITH {_GRID}, d AS (SELECT s.row, s.image, cx::INTEGER AS cx, cy::INTEGER AS cy FROM s, range(20) a(cx), range(20) b(cy) WHERE pow((cx + 0.5) * 50 - x, 2) + pow((cy + 0.5) * 50 - y, 2) <= 22500), f AS (SELECT d.row, avg(CASE WHEN g.image IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS share FROM d LEFT JOIN g ON g.image = d.image AND g.cx = d.cx AND g.cy = d.cy GROUP BY d.row) SELECT s.row, round(coalesce(share, 0), 8) AS share FROM s LEFT JOIN f ON f.row = s.row")
def covered_fraction(spark, sf_dir):
    grid, p = _covered(spark, sf_dir)
    return coverage.covered_fraction(grid, p, 50.0, 1000, 1000).withColumn("share", F.round("share", 8))


@register("image_covered_fraction", f"WITH {_GRID} SELECT image, count(*) / 400.0::DOUBLE AS share FROM g GROUP BY image")
def image_covered_fraction(spark, sf_dir):
    return coverage.image_covered_fraction(_covered(spark, sf_dir)[0], 50.0, 1000, 1000)


@register("bridging_clusters", "WITH m AS (SELECT l_orderkey AS c, l_suppkey % 4 AS g, bool_and(l_quantity > 5) AS ok FROM lineitem GROUP BY ALL), p AS (SELECT a.g AS i, b.g AS j, count(*) FILTER (a.ok AND b.ok) AS satisfied, count(*) AS n FROM m a JOIN m b ON a.c = b.c AND a.g < b.g GROUP BY ALL) SELECT i, j, satisfied, n FROM p")
def bridging_clusters(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_suppkey").alias("image"), (F.col("l_quantity") > 5).alias("satisfied"))
    groups = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") % 4).alias("grp"))
    return coverage.bridging_clusters(m, groups).drop("low")


@register("homographies", None)
def homographies(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 100
    m = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("image_i"), F.col("l_suppkey").alias("image_j"), F.col("l_orderkey").alias("feature_i"), F.col("l_linenumber").alias("feature_j"), x.alias("xi"), y.alias("yi"), (2 * x + 1).alias("xj"), (2 * y - 3 + F.when(F.col("l_linenumber") == 7, 99.0).otherwise(0.0)).alias("yj"))
    return estimation.homographies(m).select("image_j", "n", "inliers")
