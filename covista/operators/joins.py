"""Covisibility, correspondences, range and nearest-neighbour joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import spread


def covisibility(observations: DataFrame, entity: str, context: str) -> DataFrame:
    """(i, j, shared), i < j: how many entities both contexts observe. Repeats within a context count once.

    Observations are shuffled once by entity, and their pairs once, into as many partitions as there are observations for,
    so that a task's tables don't grow with the input.
    """
    n = spread(observations)
    seen = observations.select(F.col(entity).alias("e"), F.col(context).alias("i")).repartition(n, "e").distinct()
    pairs = seen.join(seen.toDF("e", "j").hint("merge"), "e").where("i < j").select("i", "j")
    return pairs.repartition(n, "i", "j").groupBy("i", "j").agg(F.count("*").alias("shared"))


def ranked_partners(pairs: DataFrame, context) -> DataFrame:
    """(partner, shared, rank) of one context: most shared first, ties by partner."""
    both = pairs.select(F.col("i").alias("c"), F.col("j").alias("partner"), "shared").unionByName(pairs.select(F.col("j").alias("c"), F.col("i").alias("partner"), "shared"))
    return both.where(F.col("c") == context).select("partner", "shared", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("shared"), "partner")).alias("rank"))


def reached(pairs: DataFrame, contexts: DataFrame, chosen: list, least: int) -> DataFrame:
    """(reached, total): contexts that share least entities with a chosen one, the chosen ones included, of all contexts."""
    both = pairs.select("i", "j", "shared").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared"))
    hit = both.where(F.col("i").isin(chosen) & (F.col("shared") >= least)).select(F.col("j").alias("c"))
    hit = hit.unionByName(contexts.toDF("c").where(F.col("c").isin(chosen))).distinct()
    return hit.agg(F.count("*").alias("reached")).crossJoin(contexts.agg(F.count("*").alias("total")))


def cluster_pairs(members: DataFrame, cluster: str, context: str, feature: str) -> DataFrame:
    """(i, j, feature_i, feature_j), i < j: each two members of a cluster that are in different contexts."""
    a = members.select(F.col(cluster).alias("c"), F.col(context).alias("i"), F.col(feature).alias("feature_i"))
    return a.join(a.toDF("c", "j", "feature_j"), "c").where("i < j").select("i", "j", "feature_i", "feature_j")


def first_match(left: DataFrame, right: DataFrame, on: list[str], source: str, target: str) -> DataFrame:
    """(source, target): for each source the target of its first common key, keys in order, then targets."""
    x = left.select(*on, F.col(source).alias("source")).join(right.select(*on, F.col(target).alias("target")), on)
    return x.groupBy("source").agg(F.min(F.struct(*on, "target"))["target"].alias("target"))


def compared_sets(left: DataFrame, right: DataFrame, group: str, item: str) -> DataFrame:
    """(group, common, left_only, right_only): how the items of each group differ between two tables."""
    a = left.select(group, item).distinct().withColumn("l", F.lit(1))
    b = right.select(group, item).distinct().withColumn("r", F.lit(1))
    both = a.join(b, [group, item], "full_outer")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.groupBy(group).agg(count(l & r)("common"), count(l & ~r)("left_only"), count(~l & r)("right_only"))


def within_reach(points: DataFrame, row: str, group: str, x: str, y: str, reach: str, digits: int | None = None) -> DataFrame:
    """(row, other, distance): others of the group within each row's own reach; directed, without self pairs.

    Reaches are put into levels of powers of 2. A row asks the cells, as wide as its level, that its reach touches, four
    at most; the rows that are found stand once in each level's cells, so the join is on equal keys however unlike the
    reaches are. A reach beyond the group's extent asks its whole group. A missing reach asks nothing, and a missing
    position is not found. A negative reach is an error. Rows of one place are met as one, and are dealt out after, in
    runs; digits rounds what their distance is told as, once for two places.
    """
    p = points.select(F.col(row).alias("row"), F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(reach).cast("double").alias("reach"))
    p = p.withColumn("reach", F.when(F.col("reach") < 0, F.raise_error(F.lit("a reach mustn't be negative"))).otherwise(F.col("reach")))
    p = p.where("x is not null and y is not null and not isnan(x) and not isnan(y) and abs(x) < double('inf') and abs(y) < double('inf')")
    extent = p.groupBy("g").agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * 2 + 1).alias("most"))
    held = lambda d, c, *by: d.groupBy(*by).agg(F.sort_array(F.collect_list("row")).alias(c))
    ask = held(p.where("not isnan(reach)"), "rows", "g", "x", "y", "reach").join(extent, "g").withColumn("span", F.least("reach", "most"))
    ask = ask.withColumn("level", F.when(F.col("span") > 0, F.ceil(F.log2(F.col("span")))).otherwise(F.lit(-1074)).cast("int"))
    ask = ask.withColumn("level", F.greatest("level", F.ceil(F.log2("most")).cast("int") - 40))
    wide = F.pow(F.lit(2.0), F.col("level") + 1)
    at = lambda c: F.floor(c / wide)
    ends = lambda c: F.explode(F.sequence(at(F.col(c) - F.col("span")), at(F.col(c) + F.col("span"))))
    ask = ask.withColumn("cx", ends("x")).withColumn("cy", ends("y"))
    levels = ask.select("g", "level").distinct()
    found = held(p, "others", "g", "x", "y").withColumnsRenamed({"x": "ox", "y": "oy"}).join(levels, "g")
    found = found.withColumn("cx", at(F.col("ox"))).withColumn("cy", at(F.col("oy")))
    # the pairs of a cell are many more than its rows, by which Spark would size the tasks
    n, cell = spread(p, 1 << 12), ["g", "level", "cx", "cy"]
    near = ask.repartition(n, *cell).join(found.repartition(n, *cell), cell)
    distance = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
    told = F.col("distance") if digits is None else F.round("distance", digits).alias("distance")
    near = near.withColumn("distance", distance).where("distance <= reach").select("rows", "others", told)
    near = near.select(F.explode("rows").alias("row"), "others", "distance").select("row", F.explode("others").alias("other"), "distance")
    return near.where("row <> other")


def covered_by_finer(points: DataFrame, row: str, group: str, owner: str, x: str, y: str, reach: str, radius: str, ratio: float = 2.0, finest: float = 0.0, least: int = 2) -> DataFrame:
    """The rows that stay: a row goes if a row of another owner, finer by ratio, is within its reach; then owners with fewer than least rows go."""
    from .tracks import prune_covered

    return prune_covered(points, row, group, owner, x, y, reach, radius, None, ratio, finest, least)[0].select("row", "owner", "radius")
