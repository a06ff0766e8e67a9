"""Choosing images by covisibility: greedy groups of images that see much in common, and thinning, over an edge table.

Both rules are sequential; here they are rounds of joins over pairs (i, j, shared), i < j, with the sequential rule's ties.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut, numbered


def both_ways(pairs: DataFrame) -> DataFrame:
    """(i, j, shared) in both directions, without pairs that share nothing."""
    p = pairs.select("i", "j", "shared").where("shared > 0")
    return p.unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "shared"))


def _reach(edges: DataFrame) -> DataFrame:
    """(i, j, shared, k, w): of each pair i < j its own two images, and those joined to both, with w the lesser of their counts; edges are (i, j, shared), i < j."""
    e = edges.select("i", "j", "shared")
    wedges = e.join(e.select("i", F.col("j").alias("k"), F.col("shared").alias("ik")), "i").where("j < k")
    t = cut(wedges.join(e.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("shared").alias("jk")), ["j", "k"]))
    w = lambda i, j, shared, k, x, y: t.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(shared).alias("shared"), F.col(k).alias("k"), F.least(x, y).alias("w"))
    own = e.select("i", "j", "shared", F.explode(F.array("i", "j")).alias("k"), F.lit(None).cast(dict(e.dtypes)["shared"]).alias("w"))
    return own.unionByName(w("i", "j", "shared", "k", "ik", "jk")).unionByName(w("i", "k", "ik", "j", "shared", "jk")).unionByName(w("j", "k", "jk", "i", "shared", "ik"))


def _grown(rows: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """(i, j, shared, k): the images k of the group that each pair of rows (i, j, shared, k, w) would found among these; edges go both ways."""
    x = rows.withColumn("in", F.col("w").isNull())
    pair = Window.partitionBy("i", "j")
    for step in range(size - 2):
        best = F.max(F.when(~F.col("in"), F.struct(F.col("w"), (-F.col("k")).alias("least")))).over(pair)
        x = x.withColumn("next", -best["least"]).join(edges.select(F.col("i").alias("k"), F.col("j").alias("next"), F.col("shared").alias("own")), ["k", "next"], "left")
        x = x.withColumn("in", F.col("in") | F.coalesce(F.col("k") == F.col("next"), F.lit(False))).where(F.col("in") | F.col("own").isNotNull())
        x = x.select("i", "j", "shared", "k", F.least("w", "own").alias("w"), "in")
        x = cut(x) if step % 4 == 3 and step < size - 3 else x
    return x.where("in").select("i", "j", "shared", "k")


def _seeded(pairs: DataFrame, size: int, least: int) -> DataFrame:
    """(i, j, shared, k): the images k of the group that the pair i < j founded, of all groups.

    What a pair's group may take are its images and those joined to both. In a round the group of a pair is settled if no
    earlier pair may take one of the images that it would take now: what else goes can't change its choices. Many groups
    are settled at a time, in as many rounds as the longest chain of pairs that wait for each other.
    """
    both = cut(both_ways(pairs).where(F.col("shared") >= least))
    rows, groups = cut(_reach(both.where("i < j"))), None
    turn = F.struct((-F.col("shared")).alias("a"), F.col("i").alias("b"), F.col("j").alias("c"))
    while True:
        first = cut(rows.groupBy("k").agg(F.min(turn).alias("first")))  # of each image the earliest pair that may take it
        found = first.groupBy("first").agg(F.count(F.when((F.col("k") == F.col("first.b")) | (F.col("k") == F.col("first.c")), 1)).alias("own")).where("own = 2")
        found = cut(found.select(F.col("first.b").alias("i"), F.col("first.c").alias("j")))
        if found.isEmpty():
            return groups if groups is not None else rows.select("i", "j", "shared", "k")
        now = cut(_grown(rows.join(found, ["i", "j"]), both, size))
        late = now.join(first, "k").where(F.col("first") != turn).select("i", "j").distinct()
        done = cut(now.join(late, ["i", "j"], "left_anti"))
        groups = done if groups is None else groups.unionByName(done)
        gone = F.broadcast(done.select("k"))  # up to as many as there are images
        for c in "kij":
            rows = rows.join(gone.toDF(c), c, "left_anti")
        rows = cut(rows.select("i", "j", "shared", "k", "w"))


def seed_groups(pairs: DataFrame, size: int, least: int) -> Iterator[tuple[list[int], int, tuple[int, int]]]:
    """(images, shared, (i, j)) of one group after the other: its images, ascending, and the pair that founded it with its count.

    A group begins with the pair that shares most of those left (ties to the least i, then j), and takes the image whose
    least count with all of the group is largest (ties to the least), as long as that is `least` or more, until it has
    `size`. Its images are out of the running then; it ends when no pair shares `least`.
    """
    g = _seeded(pairs, size, least).groupBy("i", "j", "shared").agg(F.sort_array(F.collect_set("k")).alias("k"))
    for r in g.orderBy(F.desc("shared"), "i", "j").toLocalIterator():
        yield list(r["k"]), r["shared"], (r["i"], r["j"])


def seed_image_groups(pairs: DataFrame, size: int, least: int, most: int | None = None) -> DataFrame:
    """(group, image, founder): the first `most` of seed_groups(), or all, numbered from 0; founder tells the pair that each began with."""
    g = cut(_seeded(pairs, size, least))
    order = numbered(g.select((-F.col("shared")).alias("a"), "i", "j").distinct(), "a", "i", "j", out="group")
    out = g.join(order.where("true" if most is None else f"group < {int(most)}"), ["i", "j"])
    return out.select("group", F.col("k").cast("long").alias("image"), F.col("k").isin(F.col("i"), F.col("j")).alias("founder")).orderBy("group", "image")


def _order(images: DataFrame) -> DataFrame:
    """(image, turn): what the sweep goes by, the most isolated first (isolation, where there is one; none is infinite), then by number."""
    isolation = F.coalesce(F.nanvl(F.col("isolation"), F.lit(None)), F.lit(float("inf"))) if "isolation" in images.columns else F.lit(0.0)
    return images.select("image", F.struct((-isolation).alias("a"), F.col("image").alias("b")).alias("turn"))


def thinned(pairs: DataFrame, images: DataFrame, tau: float) -> DataFrame:
    """(image): those that a sweep keeps: the first, and then each whose largest count with those kept before is in [tau / 8, tau).

    images has (image) and may have isolation. In a round all images are settled that can be: one that shares tau and more
    with a kept one goes, and one is kept, or goes for sharing too little, once no earlier image that could change this is
    open. That is what one after the other gives, in as many rounds as the longest chain of such doubts.
    """
    order = _order(images)
    first = order.orderBy("turn").limit(1).select(F.col("image").alias("first"))
    edges = both_ways(pairs).join(order.toDF("i", "ti"), "i").join(order.toDF("j", "tj"), "j").where("tj < ti").select("i", "j", "shared")
    edges = cut(edges.where(F.col("shared") >= tau / 8))
    state = cut(order.select("image").join(F.broadcast(first), F.col("image") == F.col("first"), "left").select("image", F.when(F.col("first").isNotNull(), True).alias("kept")))
    while True:
        open_ = state.where("kept is null").select("image")
        if open_.isEmpty():
            return state.where("kept").select("image")
        near = edges.join(open_.withColumnRenamed("image", "i"), "i").join(state.withColumnRenamed("image", "j"), "j")
        known = near.groupBy(F.col("i").alias("image")).agg(F.max(F.when(F.col("kept"), F.col("shared"))).alias("best"), F.max(F.when(F.col("kept").isNull(), F.col("shared"))).alias("doubt"))
        x = state.join(known, "image", "left")
        settled = F.when(F.col("best") >= tau, False).when(F.coalesce("best", F.lit(0)) >= tau / 8, F.when(F.coalesce("doubt", F.lit(0)) < tau, True)).when(F.col("doubt").isNull(), False)
        state = cut(x.select("image", F.coalesce("kept", settled).alias("kept")))


def thinned_to(pairs: DataFrame, images: DataFrame, target: int, steps: int = 25) -> DataFrame:
    """thinned() to about `target` images: of the tau that bisection tries between 1 and the median of the images' largest counts, the one that comes closest, the earliest of equal ones."""
    peak = both_ways(pairs).groupBy("i").agg(F.max("shared").alias("peak"))
    peaks = images.select("image").join(peak, F.col("image") == F.col("i"), "left").select(F.coalesce("peak", F.lit(0)).alias("peak"))
    low, high = 1.0, peaks.agg(F.expr("percentile(peak, 0.5)")).first()[0] or 0.0  # counts are few, so are their distinct values
    best, off = None, None
    for _ in range(steps):
        tau = (low + high) / 2
        kept = cut(thinned(pairs, images, tau))
        n = kept.count()
        if off is None or abs(n - target) < off:
            best, off = kept, abs(n - target)
        if off == 0:
            break  # no later one comes closer
        low, high = (tau, high) if n < target else (low, tau)
    return best if best is not None else images.select("image").limit(0)
