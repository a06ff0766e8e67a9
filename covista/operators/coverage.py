"""Lookups in a coverage grid of images: cells (image, cx, cy, n) that observations cover, as aggregates.coverage_grid() gives them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most sectors of a bit mask.
SECTORS = 32


def counts_at(grid: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """points (row, image, x, y) with n, the count of the cell that each is in; 0 where none is covered."""
    p = points.withColumn("cx", F.floor(F.col("x") / cell).cast("int")).withColumn("cy", F.floor(F.col("y") / cell).cast("int"))
    return p.join(grid, ["image", "cx", "cy"], "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))


def _disks(points: DataFrame, cell: float, width: int, height: int) -> DataFrame:
    """(row, image, cx, cy, dx, dy): the cells of the image whose centre is in the disk of each point (row, image, x, y, radius)."""
    span = lambda c, most: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col("radius")) / cell).cast("int")), F.least(F.lit(most - 1), F.floor((F.col(c) + F.col("radius")) / cell).cast("int"))))
    inside = points.where((F.col("x") + F.col("radius") >= 0) & (F.col("y") + F.col("radius") >= 0) & (F.col("x") - F.col("radius") < width) & (F.col("y") - F.col("radius") < height))
    at = inside.withColumn("cx", span("x", math.ceil(width / cell))).withColumn("cy", span("y", math.ceil(height / cell)))
    at = at.withColumns({"dx": (F.col("cx") + 0.5) * cell - F.col("x"), "dy": (F.col("cy") + 0.5) * cell - F.col("y")})
    return at.where(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") <= F.col("radius") * F.col("radius"))


def covered_fraction(grid: DataFrame, points: DataFrame, cell: float, width: int, height: int) -> DataFrame:
    """(row, share) of the cells in each point's disk that are covered; 0 where no cell's centre is in it."""
    d = _disks(points, cell, width, height).join(grid.select("image", "cx", "cy", F.lit(1.0).alias("hit")), ["image", "cx", "cy"], "left")
    share = d.groupBy("row").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))
    return points.select("row").join(share, "row", "left").select("row", F.coalesce("share", F.lit(0.0)).alias("share"))


def uncovered_sectors(grid: DataFrame, points: DataFrame, cell: float, width: int, height: int, sectors: int) -> DataFrame:
    """(row, mask): bit k is set where sector k of the point's disk, counted from the x axis by angle, holds a cell that isn't covered."""
    if not 0 < sectors <= SECTORS:
        raise ValueError(f"1 to {SECTORS} sectors")
    free = _disks(points, cell, width, height).join(grid.select("image", "cx", "cy"), ["image", "cx", "cy"], "left_anti")
    turn = F.pmod(F.atan2("dy", "dx"), F.lit(2 * math.pi)) / (2 * math.pi)
    k = F.least(F.lit(sectors - 1), F.floor(turn * sectors).cast("int"))
    masks = free.select("row", k.alias("k")).distinct().groupBy("row").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    return points.select("row").join(masks, "row", "left").select("row", F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))


def image_covered_fraction(grid: DataFrame, cell: float, width: int, height: int) -> DataFrame:
    """(image, share) of an image's cells that are covered."""
    return grid.groupBy("image").agg((F.count("*") / (math.ceil(width / cell) * math.ceil(height / cell))).alias("share"))


def bridging_clusters(members: DataFrame, groups: DataFrame, z: float = 1.96) -> DataFrame:
    """(i, j, satisfied, n, low): clusters that two groups of images share, how many of them are satisfied, and the Wilson lower bound of that share.

    members has (cluster, image, satisfied), groups (image, grp); a cluster is satisfied in a pair of groups where all its
    members in them are.
    """
    from .aggregates import wilson_lower

    m = members.join(groups, "image").groupBy("cluster", "grp").agg(F.min("satisfied").alias("ok"))
    met = m.select("cluster", F.col("grp").alias("i"), F.col("ok").alias("a")).join(m.select("cluster", F.col("grp").alias("j"), F.col("ok").alias("b")), "cluster").where("i < j")
    out = met.groupBy("i", "j").agg(F.sum((F.col("a") & F.col("b")).cast("long")).alias("satisfied"), F.count("*").alias("n"))
    return out.withColumn("low", wilson_lower(F.col("satisfied").cast("double"), F.col("n").cast("double"), z))
