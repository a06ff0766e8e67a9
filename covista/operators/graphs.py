"""Transitive groups, fixpoints and per-group geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregates import quantile
from .tables import cut as _cut


def connected_groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root): the least id of each id's component.

    In each round an id takes the least label of its neighbours, passes it on to the id that its own label names, and all
    labels are replaced by their label's label, so that labels cross a component in about as many rounds as its width has
    digits to base 2; it ends when no label changes. Labels grow with the ids, so no join sends them through the driver.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = _cut(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = _cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("root")))
    while True:
        seen = both.join(labels.toDF("y", "label").hint("merge"), "y").groupBy("x").agg(F.min("label").alias("label"))
        now = _cut(labels.join(seen.hint("merge"), labels["id"] == seen["x"]).select("id", "root", F.least("root", "label").alias("least")))
        passed = now.groupBy(F.col("root").alias("id")).agg(F.min("least").alias("hook"))
        now = _cut(now.join(passed.hint("merge"), "id", "left").select("id", "root", F.least("least", "hook").alias("least")))
        if now.where("root <> least").isEmpty():
            return now.select("id", "root")
        jump = now.select(F.col("id").alias("least"), F.col("least").alias("next"))
        labels = _cut(now.join(jump.hint("merge"), "least").select("id", F.col("next").alias("root")))


def group_max_distance(points: DataFrame, group: str, *axes: str) -> DataFrame:
    """(group, n, farthest): the largest distance of a group's points to their mean."""
    mean = points.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in axes])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m_{c}"), 2) for c in axes), F.lit(0.0)))
    return points.join(mean, group).groupBy(group, "n").agg(F.max(d).alias("farthest"))


def trimmed_median(rows: DataFrame, value: str, times: float = 2.0, passes: int = 8) -> float | None:
    """The median after values above times the median are dropped, again and again, until none is; passes at most."""
    rows, limit, last = rows.where(F.col(value).isNotNull()), None, None
    for _ in range(passes):
        part = rows if limit is None else rows.where(F.col(value) <= limit)
        median = quantile(part, value)
        if median is None or median == last:
            break
        last, limit = median, times * median if limit is None else min(limit, times * median)
    return last
