"""Queries of the reference's operators over the test tables, each with its statement for DuckDB.

lineitem stands for observations (order = point, supplier = image, part = feature, discount = error), orders and part for
points with stored values, supplier and customer for images, embeddings for descriptors, events for ordered frames.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from covista.functions import formula
from covista.operators import aggregates, filters, graphs, joins, kernels, neighbors, sequences, tracks
from covista.sources import bundle
from covista.streaming import windows

from .registry import register


def table(spark, sf_dir, name, *columns):
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _tracks(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_discount")
    return o.groupBy("l_orderkey").agg(F.count("*").alias("track_length"), (F.count("*") - F.countDistinct("l_suppkey")).alias("repeats"), F.max("l_discount").alias("max_error"), F.round(F.avg("l_discount"), 6).alias("mean_error"))


_TRACKS = "SELECT l_orderkey, count(*) AS track_length, count(*) - count(DISTINCT l_suppkey) AS repeats, max(l_discount) AS max_error, round(avg(l_discount), 6) AS mean_error FROM lineitem GROUP BY l_orderkey"


@register("track_table_query", f"SELECT * FROM ({_TRACKS}) WHERE track_length BETWEEN 3 AND 6 AND NOT isnan(max_error) AND max_error <= 0.09 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)")
def track_table_query(spark, sf_dir):
    found = filters.within(_tracks(spark, sf_dir), {"track_length": (3, 6), "max_error": (None, 0.09)})
    found = filters.seen_in(found, table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey"), "l_orderkey", "l_suppkey", 1)
    return found.orderBy(*filters.value_order("max_error", "l_orderkey"))


@register("track_table_page", f"SELECT * FROM ({_TRACKS}) ORDER BY max_error DESC NULLS LAST, l_orderkey LIMIT 50 OFFSET 20")
def track_table_page(spark, sf_dir):
    return filters.page(_tracks(spark, sf_dir), "max_error", "l_orderkey", descending=True, offset=20, limit=50)


@register("seen_in_context", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 2)")
def seen_in_context(spark, sf_dir):
    o = table(spark, sf_dir, "orders", F.col("o_orderkey"), "o_totalprice")
    seen = table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return filters.seen_in(o, seen, "o_orderkey", "l_suppkey", 2)


_PAIRS = "SELECT a.l_suppkey AS i, b.l_suppkey AS j, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL"


def _pairs(spark, sf_dir):
    return joins.covisibility(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


register("covisibility_pairs", _PAIRS)(_pairs)


@register("covisibility_rank", f"WITH p AS ({_PAIRS}), b AS (SELECT j AS partner, shared FROM p WHERE i = 3 UNION ALL SELECT i, shared FROM p WHERE j = 3) SELECT partner, shared, row_number() OVER (ORDER BY shared DESC, partner)::INTEGER AS rank FROM b")
def covisibility_rank(spark, sf_dir):
    return joins.ranked_partners(_pairs(spark, sf_dir), 3)


@register("covisibility_reach", f"WITH p AS ({_PAIRS}), b AS (SELECT i, j, shared FROM p UNION ALL SELECT j, i, shared FROM p), h AS (SELECT j AS c FROM b WHERE i IN (1, 2, 3) AND shared >= 5 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey IN (1, 2, 3)) SELECT (SELECT count(*) FROM h) AS reached, (SELECT count(*) FROM supplier) AS total")
def covisibility_reach(spark, sf_dir):
    return joins.reached(_pairs(spark, sf_dir), table(spark, sf_dir, "supplier", "s_suppkey"), [1, 2, 3], 5)


@register("pair_pruning", f"WITH p AS ({_PAIRS}) SELECT * FROM p WHERE j - i <= 3 UNION ALL (SELECT * FROM (SELECT * FROM p WHERE j - i > 3 ORDER BY j - i, i, j LIMIT 600) ORDER BY shared DESC, i, j LIMIT 200)")
def pair_pruning(spark, sf_dir):
    return tracks.pruned_pairs(_pairs(spark, sf_dir).withColumnRenamed("shared", "score"), 3, most_distant=200).withColumnRenamed("score", "shared")


@register("cluster_pairs", "SELECT a.l_suppkey AS i, b.l_suppkey AS j, a.l_partkey AS feature_i, b.l_partkey AS feature_j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey")
def cluster_pairs(spark, sf_dir):
    return joins.cluster_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey")


@register("remove_short_tracks", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 4)")
def remove_short_tracks(spark, sf_dir):
    return filters.longer_than(table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", 4)


@register("remove_large_features", "SELECT l_orderkey, max(coalesce(l_quantity, 0)) AS max_size FROM lineitem GROUP BY l_orderkey HAVING max(coalesce(l_quantity, 0)) <= 30")
def remove_large_features(spark, sf_dir):
    return filters.at_most(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", 30.0)


@register("filter_cascade_renumber", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_index FROM orders WHERE o_totalprice > 150000) SELECT p.new_index, l.l_linenumber, l.l_suppkey FROM lineitem l JOIN p ON p.o_orderkey = l.l_orderkey")
def filter_cascade_renumber(spark, sf_dir):
    points = filters.renumbered(table(spark, sf_dir, "orders").where("o_totalprice > 150000").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return table(spark, sf_dir, "lineitem").join(points, "l_orderkey").select("new_index", "l_linenumber", "l_suppkey")


_NUMBER = r"regexp_extract(c_name, '(\d+)$', 1)::BIGINT"


@register("file_number", f"SELECT c_custkey, {_NUMBER} AS number FROM customer")
def file_number(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", filters.number_in_name("c_name").alias("number"))


@register("range_include", f"SELECT c_custkey FROM customer WHERE {_NUMBER} BETWEEN 1 AND 10 OR ({_NUMBER} BETWEEN 20 AND 60 AND ({_NUMBER} - 20) % 5 = 0) OR {_NUMBER} = 77")
def range_include(spark, sf_dir):
    return filters.include_range(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name", "1-10,20-60:5,77").select("c_custkey")


@register("range_exclude", f"SELECT c_custkey FROM customer WHERE NOT ({_NUMBER} BETWEEN 1 AND 10 OR ({_NUMBER} BETWEEN 20 AND 60 AND ({_NUMBER} - 20) % 5 = 0) OR {_NUMBER} = 77)")
def range_exclude(spark, sf_dir):
    return filters.exclude_range(table(spark, sf_dir, "customer", "c_custkey", "c_name"), "c_name", "1-10,20-60:5,77").select("c_custkey")


@register("glob_include", "SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[AEIOU]?'")
def glob_include(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_type", "*[AEIOU]?")


@register("glob_exclude", "SELECT p_partkey, p_type FROM part WHERE NOT p_type GLOB '*[AEIOU]?'")
def glob_exclude(spark, sf_dir):
    return filters.matching(table(spark, sf_dir, "part", "p_partkey", "p_type"), "p_type", "*[AEIOU]?", keep=False)


_METRICS = "SELECT s_suppkey AS l_suppkey, coalesce(n, 0) AS n, round(mean, 6) AS mean, median, max FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, avg(l_discount) AS mean, round(quantile_cont(l_discount, 0.5), 6) AS median, max(l_discount) AS max FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey"


def _metrics(spark, sf_dir):
    got = aggregates.group_metrics(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), table(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount")
    return got.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


register("per_group_metrics", _METRICS)(_metrics)


@register("metric_flags", f"WITH m AS ({_METRICS}), a AS (SELECT quantile_cont(l_discount, 0.5) AS q FROM lineitem) SELECT m.*, CASE WHEN mean > 2 * q THEN 'alert' WHEN mean > 1.5 * q THEN 'warn' ELSE 'ok' END AS flag FROM m, a")
def metric_flags(spark, sf_dir):
    return aggregates.flags(_metrics(spark, sf_dir), table(spark, sf_dir, "lineitem"), "l_discount")


_HIST = "WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), c AS (SELECT least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::INTEGER AS bucket, count(*) AS n FROM lineitem, e GROUP BY 1), h AS (SELECT b::INTEGER AS bucket, lo + (hi - lo) / 20 * b AS low, lo + (hi - lo) / 20 * (b + 1) AS high, coalesce(n, 0) AS n FROM range(20) r(b) CROSS JOIN e LEFT JOIN c ON c.bucket = b)"


def _hist(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice", 20)


@register("equal_width_histogram", _HIST + " SELECT bucket, round(low, 4) AS low, round(high, 4) AS high, n FROM h")
def equal_width_histogram(spark, sf_dir):
    return _hist(spark, sf_dir).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


_AT = _HIST + ", r AS (SELECT *, sum(n) OVER (ORDER BY bucket) AS upto, sum(n) OVER () * 0.9 AS target FROM h), f AS (SELECT * FROM r WHERE upto >= target AND n > 0 ORDER BY bucket LIMIT 1) "


@register("histogram_percentile_interp", _AT + "SELECT round(low + (high - low) * (target - (upto - n)) / n, 4) AS value FROM f")
def histogram_percentile_interp(spark, sf_dir):
    return aggregates.histogram_percentile(_hist(spark, sf_dir), 90).select(F.round("value", 4).alias("value"))


@register("histogram_percentile_center", _AT + "SELECT round((low + high) / 2, 4) AS value FROM f")
def histogram_percentile_center(spark, sf_dir):
    return aggregates.histogram_percentile(_hist(spark, sf_dir), 90, centre=True).select(F.round("value", 4).alias("value"))


@register("repeat_observations_best", "SELECT l_orderkey, l_suppkey, l_linenumber, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_discount NULLS LAST, l_linenumber) = 1")
def repeat_observations_best(spark, sf_dir):
    return aggregates.best_of(table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_discount"), ["l_orderkey", "l_suppkey"], "l_discount", ["l_linenumber"])


@register("merge_dedup_best", "WITH u AS (SELECT l_suppkey, l_partkey, l_tax, l_orderkey FROM lineitem WHERE l_quantity < 30 UNION ALL SELECT l_suppkey, l_partkey, l_tax, l_orderkey FROM lineitem WHERE l_quantity > 20) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_tax NULLS LAST, l_orderkey) = 1")
def merge_dedup_best(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_tax", "l_orderkey", "l_quantity")
    both = m.where("l_quantity < 30").unionByName(m.where("l_quantity > 20")).drop("l_quantity")
    return aggregates.best_of(both, ["l_suppkey", "l_partkey"], "l_tax", ["l_orderkey"])


@register("first_correspondence", "SELECT a.l_orderkey AS source, arg_min(b.l_orderkey, {'s': a.l_suppkey, 'p': a.l_partkey, 't': b.l_orderkey}) AS target FROM lineitem a JOIN lineitem b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'A' AND b.l_returnflag <> 'A' GROUP BY 1")
def first_correspondence(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_returnflag")
    return joins.first_match(m.where("l_returnflag = 'A'"), m.where("l_returnflag <> 'A'"), ["l_suppkey", "l_partkey"], "l_orderkey", "l_orderkey")


_SIDES = "l AS (SELECT p_partkey AS k, p_size || ':' || floor(p_retailprice)::BIGINT AS d, p_type AS n FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS k, p_size || ':' || floor(p_retailprice)::BIGINT AS d, p_type AS n FROM part WHERE p_partkey % 2 = 1), one AS (SELECT l.k AS \"left\", r.k AS \"right\" FROM l JOIN r USING (d) WHERE d IN (SELECT d FROM l GROUP BY d HAVING count(*) = 1) AND d IN (SELECT d FROM r GROUP BY d HAVING count(*) = 1))"


@register("two_stage_pairing", f"""WITH {_SIDES}, c AS (SELECT d, (SELECT count(*) FROM l WHERE l.d = x.d) AS nl, (SELECT count(*) FROM r WHERE r.d = x.d) AS nr FROM (SELECT d FROM l INTERSECT SELECT d FROM r) x),
  two AS (SELECT a.k AS "left", b.k AS "right" FROM (SELECT d, n, min(k) AS k FROM l WHERE d IN (SELECT d FROM c WHERE nl > 1 OR nr > 1) GROUP BY ALL) a JOIN (SELECT d, n, min(k) AS k FROM r GROUP BY ALL) b USING (d, n)),
  done AS (SELECT *, 1 AS stage FROM one UNION ALL SELECT *, 2 FROM two)
  SELECT * FROM done UNION ALL SELECT a.k, b.k, 3 FROM (SELECT n, min(k) AS k FROM l WHERE k NOT IN (SELECT "left" FROM done) GROUP BY n) a JOIN (SELECT n, min(k) AS k FROM r WHERE k NOT IN (SELECT "right" FROM done) GROUP BY n) b USING (n)""")
def two_stage_pairing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(":", "p_size", F.floor("p_retailprice")).alias("digest"), "p_type")
    return tracks.paired_images(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_partkey", "digest", "p_type")


@register("set_compare", "WITH a AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'A') SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, count(*) FILTER (a.l_partkey IS NOT NULL AND b.l_partkey IS NOT NULL) AS common, count(*) FILTER (b.l_partkey IS NULL) AS left_only, count(*) FILTER (a.l_partkey IS NULL) AS right_only FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey AND a.l_partkey = b.l_partkey GROUP BY 1")
def set_compare(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    return joins.compared_sets(m.where("l_returnflag = 'A'"), m.where("l_returnflag <> 'A'"), "l_suppkey", "l_partkey")


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events", "user_id", "event_id", "value")


@register("step_ratio", "WITH s AS (SELECT user_id, event_id, abs(value - lag(value) OVER w) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), t AS (SELECT *, count(step) OVER b AS nb, count(step) OVER a AS na, quantile_cont(step, 0.5) OVER b AS mb, quantile_cont(step, 0.5) OVER a AS ma FROM s WINDOW b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)) SELECT user_id, event_id, CASE WHEN nb >= 2 AND na >= 2 AND mb > 0 AND ma > 0 THEN round(greatest(mb / ma, ma / mb), 5) END AS ratio FROM t")
def step_ratio(spark, sf_dir):
    last = F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = _frames(spark, sf_dir).select("user_id", "event_id", F.abs(F.col("value") - last).alias("step"))
    return sequences.step_ratios(steps, "user_id", "event_id", "step").select("user_id", "event_id", F.round("ratio", 5).alias("ratio"))


@register("robust_zscore", "WITH n AS (SELECT a.user_id, a.event_id, a.value, b.value AS near FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) a JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) b ON a.user_id = b.user_id AND a.k <> b.k AND b.k BETWEEN a.k - 12 AND a.k + 12), m AS (SELECT *, quantile_cont(near, 0.5) OVER (PARTITION BY user_id, event_id) AS mid FROM n), d AS (SELECT user_id, event_id, any_value(value) AS value, count(*) AS c, any_value(mid) AS mid, quantile_cont(abs(near - mid), 0.5) AS mad FROM m GROUP BY ALL) SELECT e.user_id, e.event_id, CASE WHEN c >= 5 AND mad > 0 THEN round((d.value - mid) / (1.4826 * mad), 5) END AS z FROM events e LEFT JOIN d ON d.user_id = e.user_id AND d.event_id = e.event_id")
def robust_zscore(spark, sf_dir):
    return sequences.robust_z(_frames(spark, sf_dir), "user_id", "event_id", "value").select("user_id", "event_id", F.round("z", 5).alias("z"))


@register("core_edges", "WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, (value > 50)::INTEGER + (value > 80)::INTEGER AS flags, event_id % 7 AS shared FROM events), h AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS island FROM k WHERE flags > 0) SELECT user_id, event_id, k::INTEGER AS k, flags, shared FROM h QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY flags DESC, shared, k) = 1")
def core_edges(spark, sf_dir):
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = _frames(spark, sf_dir).select("user_id", "event_id", k.alias("k"), ((F.col("value") > 50).cast("int") + (F.col("value") > 80).cast("int")).alias("flags"), (F.col("event_id") % 7).alias("shared"))
    return sequences.core_edges(e, "user_id", "k", "flags", "shared")


@register("overlapping_windows", "WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id, w::INTEGER AS \"window\" FROM k, range(100000) r(w) WHERE w <= greatest(0, ceil((n - 6) / 4.0)) AND k >= w * 4 AND k < w * 4 + 6 AND w <= n")
def overlapping_windows(spark, sf_dir):
    return sequences.overlapping_windows(_frames(spark, sf_dir).select("user_id", "event_id"), "user_id", "event_id", 6, 2)


_POINTS = "p AS (SELECT c_custkey AS row, c_nationkey AS g, c_acctbal AS x, (c_custkey % 1000)::DOUBLE AS y, (c_custkey % 5) * 100.0::DOUBLE AS reach, (c_custkey % 4 + 1)::DOUBLE AS radius, c_custkey % 50 AS owner FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("row"), F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("x"), (k % 1000).cast("double").alias("y"), ((k % 5) * 100.0).alias("reach"), (k % 4 + 1).cast("double").alias("radius"), (k % 50).alias("owner"))


@register("keypoint_reach", f"WITH {_POINTS} SELECT a.row, b.row AS other, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM p a JOIN p b ON a.g = b.g AND a.row <> b.row WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= a.reach")
def keypoint_reach(spark, sf_dir):
    return joins.within_reach(_points(spark, sf_dir), "row", "g", "x", "y", "reach", digits=6)


@register("covered_by_finer", f"WITH {_POINTS}, s AS (SELECT a.* FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.g = b.g AND a.row <> b.row AND a.owner <> b.owner AND b.radius < a.radius AND a.radius >= 2 * b.radius AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= a.reach)) SELECT row, owner, radius FROM s WHERE owner IN (SELECT owner FROM s GROUP BY owner HAVING count(*) >= 2)")
def covered_by_finer(spark, sf_dir):
    return joins.covered_by_finer(_points(spark, sf_dir), "row", "g", "owner", "x", "y", "reach", "radius")


@register("coverage_grid", "WITH p AS (SELECT c_nationkey AS image, c_acctbal / 10 AS x, (c_custkey % 1000)::DOUBLE AS y FROM customer), c AS (SELECT image, cx::INTEGER AS cx, cy::INTEGER AS cy FROM p, range(20) a(cx), range(20) b(cy) WHERE pow((cx + 0.5) * 50 - x, 2) + pow((cy + 0.5) * 50 - y, 2) <= 3600) SELECT image, cx, cy, least(255, count(*)) AS n FROM c GROUP BY ALL")
def coverage_grid(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image"), (F.col("c_acctbal") / 10).alias("x"), (F.col("c_custkey") % 1000).cast("double").alias("y"))
    return aggregates.coverage_grid(p, "image", "x", "y", 60.0, 50.0, 1000, 1000)


_L2 = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")


_KNN = lambda queries: f"WITH d AS (SELECT a.vec_id AS query, b.vec_id AS key, {_L2} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id{queries}), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key)::INTEGER AS rank FROM d) SELECT query, key, round(distance, 5) AS distance, rank FROM r WHERE "


@register("knn_exact", _KNN("") + "rank <= 3")
def knn_exact(spark, sf_dir):
    return neighbors.self_nearest(_vectors(spark, sf_dir), "vec_id", "embedding", 3).withColumn("distance", F.round("distance", 5))


@register("knn_threshold", _KNN(" WHERE a.vec_id % 20 = 0") + "rank <= 1 AND distance <= 1.3")
def knn_threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return neighbors.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 1, 1.3).withColumn("distance", F.round("distance", 5))


@register("mutual_best", f"WITH d AS (SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", {_L2} AS distance FROM embeddings a JOIN embeddings b ON a.label % 2 = 0 AND b.label % 2 = 1) SELECT \"left\", \"right\", round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY \"left\" ORDER BY distance, \"right\") = 1 AND row_number() OVER (PARTITION BY \"right\" ORDER BY distance, \"left\") = 1")
def mutual_best(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return neighbors.mutual_best(v.where("label % 2 = 0"), v.where("label % 2 = 1"), "vec_id", "embedding").withColumn("distance", F.round("distance", 5))


@register("wilson_bound", "WITH c AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS hits, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, round(greatest(0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 8) AS low FROM c")
def wilson_bound(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_returnflag") == "R").cast("double")).alias("hits"), F.count("*").cast("double").alias("n"))
    return c.select("l_suppkey", F.round(aggregates.wilson_lower(F.col("hits"), F.col("n")), 8).alias("low"))


@register("noise_gate", "WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY 1), d AS (SELECT l.l_suppkey, l_extendedprice AS v, abs(l_extendedprice - mid) AS dev FROM lineitem l JOIN m USING (l_suppkey)), g AS (SELECT l_suppkey, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1) SELECT l_suppkey, count(*) AS kept, round(sqrt(avg(v * v)), 3) AS rms FROM d JOIN g USING (l_suppkey) WHERE dev <= 1.5 * 1.4826 * mad GROUP BY 1")
def noise_gate(spark, sf_dir):
    return aggregates.gated_rms(table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice", 1.5).withColumn("rms", F.round("rms", 3))


@register("group_max_distance", "WITH m AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS a, avg(l_tax) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, n, round(max(sqrt(pow(l_quantity - a, 2) + pow(l_tax - b, 2))), 6) AS farthest FROM lineitem JOIN m USING (l_suppkey) GROUP BY ALL")
def group_max_distance(spark, sf_dir):
    return graphs.group_max_distance(table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_tax"), "l_suppkey", "l_quantity", "l_tax").withColumn("farthest", F.round("farthest", 6))


#: Least labels spread along edges and self-loops; 520 steps are more than the graph is wide, as its ids go in a ring modulo 1009.
@register("connected_groups", "WITH RECURSIVE e AS (SELECT p_partkey AS x, p_partkey * 7 % 1009 AS y FROM part), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e UNION SELECT x, x FROM e UNION SELECT y, y FROM e), r AS (SELECT DISTINCT 0 AS k, x AS id, x AS root FROM b UNION ALL SELECT min(k) + 1, b.x, min(root) FROM r JOIN b ON r.id = b.y WHERE k < 520 GROUP BY b.x) SELECT id, root FROM r WHERE k = 520")
def connected_groups(spark, sf_dir):
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("x"), (F.col("p_partkey") * 7 % 1009).alias("y"))
    return graphs.connected_groups(e, "x", "y")


@register("scalar_formula", "SELECT l_orderkey, l_linenumber, round((l_quantity::FLOAT * 0.25::FLOAT)::FLOAT + l_tax::FLOAT, 3)::DOUBLE AS value FROM lineitem")
def scalar_formula(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem")
    return m.select("l_orderkey", "l_linenumber", F.round(formula.parse("R * 0.25 + G", {"R": F.col("l_quantity"), "G": F.col("l_tax")}), 3).cast("double").alias("value"))


@register("quantize_bits", "SELECT l_orderkey, l_linenumber, round(floor(greatest(0, least(1, l_discount * 12)) * 15 + 0.5) / 15, 6) AS level FROM lineitem")
def quantize_bits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(formula.quantised(F.col("l_discount") * 12, 4), 6).alias("level"))


@register("rms_error", "SELECT l_orderkey, round(sqrt(avg(l_discount * l_discount)), 6) AS rms FROM lineitem WHERE NOT isnan(l_discount) GROUP BY 1")
def rms_error(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem", "l_orderkey", "l_discount").where("not isnan(l_discount)")
    return m.groupBy("l_orderkey").agg(F.round(F.sqrt(F.avg(F.col("l_discount") * F.col("l_discount"))), 6).alias("rms"))


@register("select_clusters", "WITH k AS (SELECT l_orderkey, l_suppkey, l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N')), c AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS cluster FROM (SELECT l_orderkey FROM k GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2)) SELECT cluster, l_suppkey, l_partkey FROM k JOIN c USING (l_orderkey)")
def select_clusters(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("ordinal"), F.col("l_suppkey").alias("image"), F.col("l_returnflag").alias("status"), F.lit(True).alias("refinable"), "l_partkey")
    return tracks.selected_clusters(m, statuses=["A", "N"])[0].select("cluster", F.col("image").alias("l_suppkey"), "l_partkey")


@register("windowed_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    return windows.windowed(table(spark, sf_dir, "events", "ts", "event_type", "value")).withColumn("total", F.round("total", 4))


@register("constraint_violations", """SELECT 'observation without point' AS rule, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 0)
UNION ALL SELECT 'observation without image', count(*) FROM lineitem WHERE l_suppkey % 4 = 3
UNION ALL SELECT 'point_index repeats', count(*) FROM orders WHERE o_orderkey % 10 > 0 AND o_orderkey % 7 = 0
UNION ALL SELECT 'image_index repeats', count(*) FROM supplier WHERE s_suppkey % 4 <> 3 AND s_suppkey % 5 = 0""")
def constraint_violations(spark, sf_dir):
    """One fault of each rule is planted: points and images that are left out, and others that are there twice."""
    points = table(spark, sf_dir, "orders").where("o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("point_index"))
    images = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 3").select(F.col("s_suppkey").alias("image_index"))
    points = points.unionByName(points.where("point_index % 7 = 0"))
    images = images.unionByName(images.where("image_index % 5 = 0"))
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_index"), F.col("l_suppkey").alias("image_index"))
    return bundle.violations({"points": points, "images": images, "observations": seen})


def _trimmed(passes: int = 8) -> str:
    """The median under ever lower limits of twice the median, pass by pass."""
    out = ["c0 AS (SELECT quantile_cont(l_extendedprice, 0.5) AS q, 2 * quantile_cont(l_extendedprice, 0.5) AS most FROM lineitem)"]
    for k in range(1, passes):
        out.append(f"c{k} AS (SELECT quantile_cont(l_extendedprice, 0.5) AS q, least(any_value(most), 2 * quantile_cont(l_extendedprice, 0.5)) AS most FROM lineitem, c{k - 1} WHERE l_extendedprice <= most)")
    return f"WITH {', '.join(out)} SELECT round(q, 4) AS value FROM c{passes - 1}"


@register("trimmed_median", _trimmed())
def trimmed_median(spark, sf_dir):
    return spark.createDataFrame([(round(graphs.trimmed_median(table(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice"), 4),)], "value double")


@register("triangulate")
def triangulate(spark, sf_dir):
    k = F.col("l_suppkey").cast("double")
    rays = table(spark, sf_dir, "lineitem").select("l_orderkey", F.cos(k).alias("cx"), F.sin(k).alias("cy"), (k / 100).alias("cz"), (F.col("l_quantity") / 10 - F.cos(k)).alias("dx"), (F.col("l_tax") - F.sin(k)).alias("dy"), (F.lit(2.0) - k / 100).alias("dz"))
    return kernels.triangulated(rays, "l_orderkey", ("cx", "cy", "cz"), ("dx", "dy", "dz"))


#: Targets are planted: turned by a quarter, twice as large, moved by (1, 2, 3).
_PLANTED = ", ".join(f"{v}::DOUBLE AS {k}" for k, v in zip(["scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"], (2, 0, 1, 0, -1, 0, 0, 0, 0, 1, 1, 2, 3), strict=True))


@register("align_similarity", f"SELECT {_PLANTED}")
def align_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(a) for c, a in (("l_quantity", "x"), ("l_discount", "y"), ("l_tax", "z"))])
    q = p.select("x", "y", "z", (2 * F.col("y") + 1).alias("u"), (-2 * F.col("x") + 2).alias("v"), (2 * F.col("z") + 3).alias("w"))
    scale, rotation, move = kernels.similarity(q, ("x", "y", "z"), ("u", "v", "w"))
    return spark.createDataFrame([tuple(round(float(x), 6) + 0.0 for x in (scale, *rotation.ravel(), *move))], ", ".join(f"{c} double" for c in ("scale", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz")))


from . import adjustment_queries, function_queries, index_queries, infinity_queries, matching_queries, motion_queries, report_queries, selection_queries, track_queries  # noqa: E402, F401  (they register their own)
