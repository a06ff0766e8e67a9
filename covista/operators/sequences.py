"""Rolling computations over ordered frames of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _median(values) -> F.Column:
    """The median of an array of doubles; null if it is empty."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)


def step_ratios(frames: DataFrame, sequence: str, order: str, step: str, width: int = 8) -> DataFrame:
    """frames with ratio: the median of the width - 1 steps before over that of the steps after, or the other way round, whichever is larger; two and more on each side, medians above 0."""
    w = Window.partitionBy(sequence).orderBy(order)
    lists = frames.withColumn("__b", F.collect_list(step).over(w.rowsBetween(-(width - 1), -1))).withColumn("__a", F.collect_list(step).over(w.rowsBetween(1, width - 1)))
    before, after = _median(F.col("__b")), _median(F.col("__a"))
    ok = (F.size("__b") >= 2) & (F.size("__a") >= 2) & (before > 0) & (after > 0)
    return lists.withColumn("ratio", F.when(ok, F.greatest(before / after, after / before))).drop("__a", "__b")


def robust_z(frames: DataFrame, sequence: str, order: str, value: str, side: int = 12, least: int = 5) -> DataFrame:
    """frames with z = (value - median) / (1.4826 MAD) of up to side neighbours each way, the row itself left out; null where they are few or equal."""
    w = Window.partitionBy(sequence).orderBy(order)
    both = F.concat(F.collect_list(value).over(w.rowsBetween(-side, -1)), F.collect_list(value).over(w.rowsBetween(1, side)))
    x = frames.withColumn("__near", both).withColumn("__mid", _median(F.col("__near")))
    x = x.withColumn("__mad", _median(F.transform("__near", lambda v: F.abs(v - F.col("__mid")))))
    return x.withColumn("z", F.when((F.size("__near") >= least) & (F.col("__mad") > 0), (F.col(value) - F.col("__mid")) / (1.4826 * F.col("__mad")))).drop("__near", "__mid", "__mad")


def core_edges(edges: DataFrame, sequence: str, order: str, flags: str, shared: str) -> DataFrame:
    """One edge of each run of flagged edges (flags > 0, numbered in a row by order): most flags, then least shared, then first."""
    w = Window.partitionBy(sequence).orderBy(order)
    hit = edges.where(F.col(flags) > 0).withColumn("__island", F.col(order) - F.row_number().over(w))
    nth = F.row_number().over(Window.partitionBy(sequence, "__island").orderBy(F.desc(flags), shared, order))
    return hit.withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__island")


def overlapping_windows(frames: DataFrame, sequence: str, order: str, size: int, overlap: int) -> DataFrame:
    """frames once for each window they are in: windows of size rows every size - overlap rows, up to the first that reaches the end."""
    step = size - overlap
    x = frames.withColumn("__k", F.row_number().over(Window.partitionBy(sequence).orderBy(order)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(sequence)))
    last = F.greatest(F.lit(0), F.ceil((F.col("__n") - size) / step)).cast("int")
    first = F.greatest(F.lit(0), F.floor((F.col("__k") - size) / step) + 1).cast("int")
    return x.withColumn("window", F.explode(F.sequence(first, F.greatest(first, F.least(last, F.floor(F.col("__k") / step).cast("int")))))).drop("__k", "__n")
