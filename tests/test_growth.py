"""What a join shuffles, how its tasks are dealt, and how many steps a fit takes, where more would be for nothing."""

import time

import numpy as np
from pyspark.sql import functions as F

from covista.operators import adjustment, joins, neighbors, tracks
from covista.plans import queries  # noqa: F401  (registers)
from covista.plans import adjustment_queries


def shuffled(spark, run):
    """Rows that the stages of run() write for shuffles, with no join by broadcast."""
    sc = spark.sparkContext
    jvm = sc._gateway.jvm

    def stages():
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before, key = stages(), "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        run()
    finally:
        spark.conf.set(key, old)
    time.sleep(1)  # the store is told of stages a little later
    return sum(n for k, n in stages().items() if k not in before)


def test_the_pairs_of_cells_are_dealt_over_tasks(spark):
    p = spark.range(40_000).select(F.col("id").alias("row"), F.lit(1).alias("g"), (F.col("id") % 200 * 10.0).alias("x"), (F.floor(F.col("id") / 200) * 10.0).alias("y"), F.lit(5.0).alias("reach"))
    near = joins.within_reach(p, "row", "g", "x", "y", "reach")
    assert near.count() == 0 and "REPARTITION_BY_NUM" in near._jdf.queryExecution().toString()


def scattered(spark, n=20_000):
    return spark.range(n).select(F.col("id").alias("point"), (F.col("id") % 20).alias("image"), F.col("id").alias("ordinal"), (F.col("id") * 37 % 4001 + 0.25).alias("x"), (F.col("id") * 91 % 3989 + 0.5).alias("y"), F.lit(3.0).alias("radius"))


def test_adjacency_asks_few_cells(spark):
    o = scattered(spark).withColumn("radius", (1 + F.col("point") % 9).cast("double"))
    n = shuffled(spark, lambda: tracks.adjacency_candidates(o, 1.0, 20.0).count())
    assert 0 < n < 8 * 20_000, n


def test_correspondence_asks_few_cells(spark):
    o = scattered(spark)
    images = spark.range(20).select(F.col("id").alias("source_image"), F.col("id").alias("target_image"))
    found = []
    n = shuffled(spark, lambda: found.append(tracks.correspondence_by_coordinate(o, o.withColumn("x", F.col("x") - 2), images, 2.0, 1).count()))
    assert 0 < n < 15 * 20_000 and found == [20_000], n


def test_a_settled_pose_takes_no_more_steps(monkeypatch):
    r, calls = np.random.default_rng(5), []
    x = np.c_[r.uniform(-4, 4, (600, 2)), r.uniform(10, 17, 600)]
    one = lambda t: adjustment.View(np.array([7]), np.array([[1.0, 0, 0, 0]]), np.array([t]), np.array([0]), np.array([0]), np.array([[900.0, 900, 480, 320, 0, 0, 0, 0]]))
    plain = adjustment.reprojected
    uv = plain(one([0.5, -0.3, 0.1]), np.zeros(600, int), x, np.ones(600), np.zeros((600, 2)), jacobians=False)[0]
    monkeypatch.setattr(adjustment, "reprojected", lambda *a, **k: calls.append(1) or plain(*a, **k))
    now, cost = adjustment._fitted_pose(one([0.52, -0.3, 0.08]), x, uv, 4.0, 20)
    assert np.allclose(now.t, [[0.5, -0.3, 0.1]], atol=1e-6) and len(calls) <= 14


def test_rays_do_not_pair_partitions(spark):
    rays = adjustment.observed_rays(adjustment_queries._scene(spark, "/root/testdata/sf0.001"))
    joined = [x for x in rays._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert "image#" in joined[0]  # the join that has the observations is one by image
    assert rays.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().count()


def pairs_of_copies(df):
    """Whether a plan rounds what two places have in common before it deals out their rows."""
    lines = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode(" in x or "round(" in x]
    at = [k for k, x in enumerate(lines) if "round(" in x]
    return len(at) == 1 and at[0] >= 2


def test_distances_are_told_once_for_two_places(spark):
    """1,200 points on 600 places of one cell: their queries are dealt over tasks, and distances are rounded before copies are."""
    p = spark.range(1200).select(F.col("id").alias("key"), (F.col("id") % 600 / 100).alias("x"), (F.col("id") % 2 / 10).alias("y"))
    near = neighbors.within_radius(p, p, "key", ["x", "y"], 10.0, digits=1)
    assert pairs_of_copies(near)
    tasks = near.groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert sum(r["count"] for r in tasks) == 1200 * 1199 and len(tasks) > 1
    assert near.where("query = 3 and key = 137").first()["distance"] == 1.3


def test_reach_deals_copies_out_last(spark):
    p = spark.range(3000).select(F.col("id").alias("row"), F.lit(1).alias("g"), (F.col("id") % 30 * 1.01).alias("x"), F.lit(0.0).alias("y"), F.lit(1.5).alias("reach"))
    near = joins.within_reach(p, "row", "g", "x", "y", "reach", digits=1)
    assert pairs_of_copies(near)
    assert near.count() == 30 * 100 * 99 + 2 * 29 * 100 * 100
    assert sorted(r[0] for r in near.select("distance").distinct().collect()) == [0.0, 1.0]


def test_frusta_need_no_observations(spark, tmp_path):
    from covista.plans import matching_queries

    s = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").limit(4)
    s.unionByName(s.withColumn("s_suppkey", F.col("s_suppkey") + 21 * 17 * 5)).write.parquet(f"{tmp_path}/supplier.parquet")
    got = matching_queries.frustum_pairs(spark, str(tmp_path))
    assert pairs_of_copies(got)
    rows = {(r["i"], r["j"]): r["volume"] for r in got.collect()}
    assert all(i < j for i, j in rows)
    ids = sorted({i for i, _ in rows})
    n = 21 * 17 * 5
    small = [i for i in ids if i < n]
    assert all((i, i + n) in rows for i in small) and all(rows[i, j] == rows[i, j + n] == rows[i + n, j + n] == rows[j, i + n] for i, j in rows if j < n)


def test_clusters_are_placed_by_columns(monkeypatch):
    """Points from sums of columns, with no scatter by row; unkept observations and images without a camera take no part."""
    import pyarrow as pa

    from covista.operators import solves

    r, sizes = np.random.default_rng(9), [5, 2, 6, 4, 3]
    ids, ends = np.array([3, 5, 8, 9, 12, 20]), np.concatenate([[0], np.cumsum(sizes)])
    image = np.concatenate([np.sort(r.choice(ids, k, replace=False)) for k in sizes])
    m, x = r.normal(size=(6, 8)), r.normal(size=(5, 3))
    of, at = np.repeat(np.arange(5), sizes), np.searchsorted(ids, image)
    u, v = (m[at, :3] * x[of]).sum(1) + m[at, 3], (m[at, 4:7] * x[of]).sum(1) + m[at, 7]
    m[0], kept = np.nan, np.ones(len(of), bool)
    kept[0], u[0], kept[ends[4] :] = False, 1e6, False
    lists = lambda c: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(c))
    b = pa.RecordBatch.from_arrays([pa.array(range(5)), *(pa.array(x[:, k]) for k in range(3)), lists(image), lists(u), lists(v), lists(kept)], ["cluster", "x0", "x1", "x2", "image", "u", "v", "kept"])
    monkeypatch.setattr(solves, "_scatter", None)
    rows = solves._Rows(b, ids)
    got = rows.placed(m)
    known = [k for k in range(4) if (kept & (image != 3) & (of == k)).sum() > 1]
    assert np.allclose(got[known], x[known], atol=1e-6) and np.isnan(got[4]).all() and len(known) >= 3
    off = rows.off(m, x)
    assert np.isnan(off[image == 3]).all() and (off[(image != 3) & (np.arange(len(of)) > 0)] < 1e-9).all()
