"""Queries over points, images and observations: lineitem stands for observations and members, part for points, supplier for images."""

from __future__ import annotations

from pyspark.sql import functions as F

from covista.operators import neighbors, tracks

from .queries import table
from .registry import register

#: Observations of orders (points) in suppliers (images), with a place that follows from both, and radii of points.
_OBS = "o AS (SELECT l_orderkey AS point, l_suppkey AS image, l_linenumber AS ordinal, (l_orderkey * 37 % 4001)::DOUBLE AS x, (l_orderkey * 91 % 3989)::DOUBLE + l_suppkey % 3 AS y FROM lineitem), p AS (SELECT o_orderkey AS point, (1 + o_orderkey % 9)::DOUBLE AS radius, (o_orderkey % 101)::DOUBLE AS px, (o_orderkey % 103)::DOUBLE AS py, 500.0 + o_orderkey % 7 AS pz FROM orders WHERE o_orderkey % 11 <> 0), i AS (SELECT s_suppkey AS image, (s_suppkey % 13)::DOUBLE AS cx, 0.0::DOUBLE AS cy, 0.0::DOUBLE AS cz FROM supplier)"


def _observations(spark, sf_dir):
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    o = table(spark, sf_dir, "lineitem").select(k.alias("point"), s.alias("image"), F.col("l_linenumber").alias("ordinal"), (k * 37 % 4001).cast("double").alias("x"), ((k * 91 % 3989).cast("double") + s % 3).alias("y"))
    q = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(q.alias("point"), (1 + q % 9).cast("double").alias("radius"), (q % 101).cast("double").alias("px"), (q % 103).cast("double").alias("py"), (500.0 + q % 7).alias("pz"), (q % 11 == 0).alias("at_infinity"))
    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") % 13).cast("double").alias("cx"), F.lit(0.0).alias("cy"), F.lit(0.0).alias("cz"))
    return o, p, i


@register("adjacency_edges", f"""WITH {_OBS}, f AS (SELECT o.point, o.image, arg_min(x, ordinal) AS x, arg_min(y, ordinal) AS y, any_value(radius) AS radius, any_value(sqrt(pow(px - cx, 2) + pow(py - cy, 2) + pow(pz - cz, 2))) AS far FROM o JOIN p USING (point) JOIN i USING (image) GROUP BY ALL),
  a AS (SELECT o.point, o.image, o.x, o.y, p.radius FROM o JOIN p USING (point)),
  c AS (SELECT DISTINCT a.point AS p, b.point AS q FROM a JOIN a b ON a.image = b.image AND a.point < b.point WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) BETWEEN least(a.radius, b.radius) AND 20 * least(a.radius, b.radius)),
  m AS (SELECT c.p, c.q, sqrt(pow(u.x - v.x, 2) + pow(u.y - v.y, 2)) / least(u.radius, v.radius) AS ratio, abs(u.far - v.far) / (0.5 * (u.far + v.far)) AS miss FROM c JOIN f u ON u.point = c.p JOIN f v ON v.point = c.q AND v.image = u.image),
  g AS (SELECT p, q, count(*) AS shared_images, count(*) FILTER (ratio BETWEEN 1 AND 20) AS annulus_hits, quantile_cont(ratio, 0.5) FILTER (ratio BETWEEN 1 AND 20) AS med, quantile_cont(miss, 0.5) AS miss FROM m GROUP BY ALL),
  k AS (SELECT * FROM g WHERE shared_images >= 1 AND annulus_hits >= 1 AND annulus_hits >= 0.5 * shared_images AND miss <= 0.05)
  SELECT p, q, round(med, 6) AS separation_med, shared_images, annulus_hits, round(miss, 8) AS range_mismatch FROM k UNION ALL SELECT q, p, round(med, 6), shared_images, annulus_hits, round(miss, 8) FROM k""")
def adjacency_edges(spark, sf_dir):
    x = tracks.adjacency(*_observations(spark, sf_dir), farthest=20.0, shared=1)
    return x.select("p", "q", F.round("separation_med", 6).alias("separation_med"), "shared_images", "annulus_hits", F.round("range_mismatch", 8).alias("range_mismatch"))


_PLACES = "p AS (SELECT p_partkey AS key, p_retailprice AS x, p_size * 10.0::DOUBLE AS y FROM part)"


def _places(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("x"), (F.col("p_size") * 10.0).alias("y"))


_D = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))"


@register("within_radius", f"WITH {_PLACES} SELECT a.key AS query, b.key, round({_D}, 6) AS distance FROM p a JOIN p b ON a.key <> b.key AND {_D} <= 25")
def within_radius(spark, sf_dir):
    p = _places(spark, sf_dir)
    return neighbors.within_radius(p, p, "key", ["x", "y"], 25.0, digits=6)


@register("nearest_k_within_radius", f"WITH {_PLACES}, d AS (SELECT a.key AS query, b.key, {_D} AS distance FROM p a JOIN p b ON a.key <> b.key AND {_D} <= 40), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, key)::INTEGER AS rank FROM d) SELECT query, key, round(distance, 6) AS distance, rank FROM r WHERE rank <= 2")
def nearest_k_within_radius(spark, sf_dir):
    p = _places(spark, sf_dir)
    return neighbors.nearest_within_radius(p, p, "key", ["x", "y"], 2, 40.0).withColumn("distance", F.round("distance", 6))


_NN = f"WITH {_PLACES}, n AS (SELECT a.key, min({_D}) AS distance FROM p a JOIN p b ON a.key <> b.key GROUP BY a.key)"


@register("nearest_neighbor_distances", _NN + " SELECT key, round(distance, 6) AS distance FROM n")
def nearest_neighbor_distances(spark, sf_dir):
    return neighbors.nearest_distances(_places(spark, sf_dir), "key", ["x", "y"]).withColumn("distance", F.round("distance", 6))


@register("nn_isolated_filter", _NN + " SELECT p.* FROM p JOIN n USING (key) WHERE distance <= 1.5 * (SELECT quantile_cont(distance, 0.5) FROM n)")
def nn_isolated_filter(spark, sf_dir):
    return neighbors.isolated_filter(_places(spark, sf_dir), "key", ["x", "y"], 1.5)


@register("self_nearest_k", "WITH d AS (SELECT a.vec_id AS query, b.vec_id AS key, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT query, key, round(distance, 5) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, key)::INTEGER AS rank FROM d QUALIFY rank <= 2")
def self_nearest_k(spark, sf_dir):
    return neighbors.self_nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 2).withColumn("distance", F.round("distance", 5))


@register("background_floor_clusters")
def background_floor_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("vec_id", F.lit(25)).alias("image"), "embedding")
    return neighbors.background_floor_clusters(e, "vec_id", "image", "embedding", alpha=0.95)


@register("best_candidates", "WITH c AS (SELECT l_orderkey AS l, l_partkey AS r, min(l_extendedprice) AS d FROM lineitem GROUP BY ALL), a AS (SELECT * FROM c WHERE d <= 30000 QUALIFY row_number() OVER (PARTITION BY l ORDER BY d, r) = 1) SELECT l AS \"left\", r AS \"right\", d AS distance FROM a QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, l) = 1")
def best_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("left"), F.col("l_partkey").alias("right")).agg(F.min("l_extendedprice").alias("distance"))
    return neighbors.best_candidates(c, 30000.0)


_SWEEP = """WITH l AS (SELECT vec_id AS k, embedding AS v, embedding[1]::DOUBLE AS y FROM embeddings WHERE label % 2 = 0), r AS (SELECT vec_id AS k, embedding AS v, embedding[1]::DOUBLE AS y, row_number() OVER (ORDER BY embedding[1]::DOUBLE, vec_id) - 1 AS at FROM embeddings WHERE label % 2 = 1), n AS (SELECT count(*) AS n FROM r),
  s AS (SELECT l.*, greatest(0, least((SELECT count(*) FROM r WHERE r.y < l.y) - 15, n - 30)) AS start FROM l, n),
  d AS (SELECT s.k AS a, r.k AS b, sqrt(list_sum(list_transform(list_zip(s.v, r.v), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS d FROM s JOIN r ON r.at >= s.start AND r.at < s.start + 30)"""


@register("match_one_way_sweep", _SWEEP + " SELECT a AS \"left\", b AS \"right\", round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1")
def match_one_way_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return neighbors.sweep_best(e.where("label % 2 = 0").drop("label"), e.where("label % 2 = 1").drop("label"), "vec_id", F.col("embedding")[0].cast("double"), "embedding", 30).withColumn("distance", F.round("distance", 5))


_SHAPES = "m AS (SELECT l_orderkey AS cluster, (sqrt(l_quantity * l_quantity + l_tax * l_tax) + sqrt(l_discount * l_discount + l_linenumber * l_linenumber)) / 2 AS size, l_suppkey AS image, l_partkey AS feature FROM lineitem), g AS (SELECT cluster, max(size) * 3 AS radius FROM m GROUP BY 1)"


def _shapes(spark, sf_dir):
    shape = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_suppkey").alias("image"), F.col("l_partkey").alias("feature"), shape.alias("shape"))


@register("cluster_radii", f"WITH {_SHAPES} SELECT cluster, round(radius, 6) AS radius FROM g")
def cluster_radii(spark, sf_dir):
    return tracks.cluster_radii(_shapes(spark, sf_dir), 3.0).withColumn("radius", F.round("radius", 6))


@register("coarsest_clusters", f"WITH {_SHAPES} SELECT cluster FROM g ORDER BY radius DESC, cluster LIMIT 40")
def coarsest_clusters(spark, sf_dir):
    return tracks.coarsest_clusters(_shapes(spark, sf_dir), 3.0, 40)


@register("source_cluster_bands", f"WITH {_SHAPES}, c AS (SELECT DISTINCT image, feature FROM m WHERE cluster % 4 = 0), f AS (SELECT image, feature, min(cluster) AS source FROM m GROUP BY ALL) SELECT cluster AS source, round(radius, 6) AS radius, (CASE WHEN radius / 10 >= 1 AND radius / 10 < 3 THEN 2 WHEN radius / 10 >= 3 AND radius / 10 < 5 THEN 1 WHEN radius / 10 >= 5 AND radius / 10 < 7 THEN 0 ELSE -1 END)::INTEGER AS band FROM g WHERE cluster NOT IN (SELECT source FROM c JOIN f USING (image, feature))")
def source_cluster_bands(spark, sf_dir):
    m = _shapes(spark, sf_dir)
    members = m.join(tracks.cluster_radii(m, 3.0), "cluster").select(F.col("cluster").alias("source"), "image", "feature", "radius")
    return tracks.source_clusters(m.where("cluster % 4 = 0"), members, 10.0, [7.0, 5.0, 3.0, 1.0])[1].withColumn("radius", F.round("radius", 6))


@register("worst_consistency", "SELECT l_suppkey AS cluster, max(l_discount) AS worst FROM lineitem GROUP BY 1")
def worst_consistency(spark, sf_dir):
    return tracks.worst_consistency(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "cluster"), "l_discount")


@register("displacement_partners", "WITH m AS (SELECT l_orderkey AS c, l_suppkey AS i, arg_min(l_quantity, l_linenumber) AS x, arg_min(l_extendedprice, l_linenumber) AS y FROM lineitem GROUP BY ALL), p AS (SELECT a.i, b.i AS j, count(*) AS shared, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d FROM m a JOIN m b ON a.c = b.c AND a.i <> b.i GROUP BY ALL) SELECT i AS image, j AS partner, round(d, 4) AS displacement, row_number() OVER (PARTITION BY i ORDER BY d, j)::INTEGER AS rank FROM p WHERE shared >= 2 QUALIFY rank <= 3")
def displacement_partners(spark, sf_dir):
    # a line number may be there twice: the first row of the table counts then
    first = F.struct("l_linenumber", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), first.alias("ordinal"), F.col("l_suppkey").alias("image"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return tracks.partners_by_displacement(tracks.displacements(m), 3, 2).withColumn("displacement", F.round("displacement", 4))


@register("viewing_angles", "WITH o AS (SELECT DISTINCT l_orderkey AS point, l_suppkey AS image FROM lineitem), r AS (SELECT point, image, (point % 50 - image % 10)::DOUBLE AS x, (point % 7)::DOUBLE AS y, (20 + image % 4)::DOUBLE AS z FROM o) SELECT a.point, round(max(acos(least(1, greatest(-1, (a.x * b.x + a.y * b.y + a.z * b.z) / (sqrt(a.x * a.x + a.y * a.y + a.z * a.z) * sqrt(b.x * b.x + b.y * b.y + b.z * b.z)))))), 6) AS angle FROM r a JOIN r b ON a.point = b.point AND a.image < b.image GROUP BY 1")
def viewing_angles(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), F.col("l_suppkey").alias("image"))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % 50).cast("double").alias("x"), (F.col("o_orderkey") % 7).cast("double").alias("y"), F.lit(20.0).alias("z"))
    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), (F.col("s_suppkey") % 10).cast("double").alias("cx"), F.lit(0.0).alias("cy"), (-(F.col("s_suppkey") % 4)).cast("double").alias("cz"))
    return tracks.max_viewing_angles(o, p, i).withColumn("angle", F.round("angle", 6))


@register("patch_size_filter", "SELECT p_partkey, p_size FROM part WHERE sqrt(p_size * p_retailprice) <= 1.1 * (SELECT quantile_cont(sqrt(p_size * p_retailprice), 0.5) FROM part)")
def patch_size_filter(spark, sf_dir):
    return tracks.by_patch_size(table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", 1.1).select("p_partkey", "p_size")


@register("subset_by_images", "WITH c AS (SELECT s_suppkey AS image, row_number() OVER (ORDER BY s_suppkey DESC) - 1 AS nth FROM supplier WHERE s_acctbal > 0), o AS (SELECT l_orderkey, nth, l_linenumber FROM lineitem JOIN c ON c.image = l_suppkey), p AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS point FROM (SELECT DISTINCT l_orderkey FROM o)) SELECT point, nth AS image, l_linenumber AS ordinal FROM o JOIN p USING (l_orderkey)")
def subset_by_images(spark, sf_dir):
    from pyspark.sql.window import Window

    i = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image"), "s_acctbal")
    chosen = i.where("s_acctbal > 0").select("image", (F.row_number().over(Window.orderBy(F.desc("image"))) - 1).cast("long").alias("nth"))
    o = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point"), F.col("l_suppkey").alias("image"), F.col("l_linenumber").alias("ordinal"))
    return tracks.subset_by_images(i, o, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point")), chosen)[1].select("point", "image", "ordinal")


@register("coordinate_correspondence")
def coordinate_correspondence(spark, sf_dir):
    o, _, _ = _observations(spark, sf_dir)
    o = o.withColumn("ordinal", F.col("point") * 8 + F.col("ordinal"))
    moved = o.select("image", "ordinal", (F.col("x") + 0.5).alias("x"), F.col("y"), (F.col("point") + 1_000_000).alias("point"))
    images = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_image"), F.col("s_suppkey").alias("target_image"))
    return tracks.correspondence_by_coordinate(o, moved, images, 2.0, 2)


@register("merge_points_and_tracks", "WITH n AS (SELECT o_orderkey AS node, o_orderkey - o_orderkey % 2 AS root, o_totalprice AS x FROM orders WHERE o_orderkey > 1), g AS (SELECT least(root, min(node)) AS first, avg(x) AS x, count(*) AS members FROM n GROUP BY root) SELECT row_number() OVER (ORDER BY first) - 1 AS point, round(x, 4) AS x, members FROM g")
def merge_points_and_tracks(spark, sf_dir):
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").where("o_orderkey > 1").select(k.alias("node"), F.col("o_totalprice").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("w"), *[F.lit(1).alias(c) for c in "rgb"], F.lit(0.1).alias("error"))
    odd = p.select((F.col("node") - F.col("node") % 2).alias("root"), "node").where("node % 2 = 1").join(p.select(F.col("node").alias("root")), "root")
    o = p.select("node", F.col("node").alias("image"), F.lit(1).alias("feature"))
    return tracks.merge_points_and_tracks(p, o, odd)[0].select("point", F.round("x", 4).alias("x"), "members")
