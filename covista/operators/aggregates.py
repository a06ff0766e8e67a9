"""Per-group statistics, histograms, dedup keeping the best, and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import cut

#: Values that the end of quantile() brings to the driver, at most.
FEW = 50_000


def quantile(rows: DataFrame, value: str, q: float = 0.5) -> float | None:
    """The exact quantile of a column's values, interpolated between neighbours; None without any. Nulls and NaN take no part.

    Values are counted in 1,024 ranges of equal width, then in those of the range that holds the place, and so on, until
    the range has few values or one; no task holds more than counts. The driver interpolates between two of a few values.
    """
    x = cut(rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    low, high, n = x.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return None
    place = (n - 1) * q
    first, before, inside = int(place), 0, n

    def value_at(k: int) -> float:
        """The k-th value, if it is in the range that is left, else the next one above."""
        if k < before + inside:
            return float(low) if low == high else values[k - before]
        return float(x.where(F.col("v") > high).agg(F.min("v")).first()[0])

    while low != high and inside > FEW:
        width = (high - low) / 1024
        if 0 < width < float("inf"):
            at = F.least(F.lit(1023), F.floor((F.col("v") - low) / width))
        else:  # too narrow, or ends that aren't finite
            middle = max(low, -1.7e308) / 2 + min(high, 1.7e308) / 2
            at = (F.col("v") > min(max(middle, low), 1.7e308)).cast("int")
        ranges = x.where(F.col("v").between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in ranges:
            if before + r["n"] > first:
                low, high, inside = r["lo"], r["hi"], r["n"]
                break
            before += r["n"]
    values = [] if low == high else [r[0] for r in x.where(F.col("v").between(low, high)).orderBy("v").collect()]
    a = value_at(first)
    return a if place == first else a + (value_at(first + 1) - a) * (place - first)


def group_metrics(groups: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, median, max) of the values that are there; groups without rows stay, with n = 0."""
    got = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile(`{value}`, 0.5)").alias("median"), F.max(value).alias("max"))
    return groups.select(key).join(got, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def flags(metrics: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """metrics with flag: alert above twice the median of all values, warn above 1.5 times."""
    m = F.lit(quantile(rows, value))
    return metrics.withColumn("flag", F.when(F.col("mean") > 2 * m, "alert").when(F.col("mean") > 1.5 * m, "warn").otherwise("ok"))


def histogram(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """(bucket, low, high, n) of equal width between the least and largest value; one value alone goes to the middle bucket."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    ends = F.broadcast(rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    width = (F.col("hi") - F.col("lo")) / buckets
    at = F.when(F.col("hi") == F.col("lo"), F.lit(buckets // 2)).otherwise(F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("lo")) / width).cast("int")))
    counts = rows.crossJoin(ends).groupBy(at.alias("bucket"), "lo", "hi").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).crossJoin(ends)
    return every.join(counts.select("bucket", "n"), "bucket", "left").select("bucket", (F.col("lo") + width * F.col("bucket")).alias("low"), (F.col("lo") + width * (F.col("bucket") + 1)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_percentile(hist: DataFrame, percent: float, centre: bool = False) -> DataFrame:
    """(value): the percentile from a histogram, in the first bucket whose running count reaches it: interpolated, or the bucket's centre."""
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumn("upto", F.sum("n").over(run)).crossJoin(F.broadcast(hist.agg(F.sum("n").alias("total"))))
    target = F.col("total") * (percent / 100.0)
    x = x.where((F.col("upto") >= target) & (F.col("n") > 0)).orderBy("bucket").limit(1)
    inside = F.col("low") + (F.col("high") - F.col("low")) * (target - (F.col("upto") - F.col("n"))) / F.col("n")
    return x.select(((F.col("low") + F.col("high")) / 2 if centre else inside).alias("value"))


def best_of(rows: DataFrame, keys: list[str], value: str, then: list[str]) -> DataFrame:
    """One row for each key: that of the least finite value, ties by the columns `then`; without any, the first by these."""
    v = F.col(value).cast("double")
    known = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(known.asc_nulls_last(), *then))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    """The lower end of the Wilson interval of a share; 0 for no trials."""
    p, z2 = hits / n, z * z
    low = (p + z2 / (2 * n) - z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low))


def gated_rms(rows: DataFrame, key: str, value: str, spreads: float) -> DataFrame:
    """(key, kept, rms) of the values up to spreads robust standard deviations (1.4826 MAD) from the group's median."""
    mid = rows.groupBy(key).agg(F.expr(f"percentile(`{value}`, 0.5)").alias("mid"))
    x = rows.join(mid, key).withColumn("dev", F.abs(F.col(value) - F.col("mid")))
    mad = x.groupBy(key).agg(F.expr("percentile(dev, 0.5)").alias("mad"))
    return x.join(mad, key).where(F.col("dev") <= spreads * 1.4826 * F.col("mad")).groupBy(key).agg(F.count("*").alias("kept"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def coverage_grid(points: DataFrame, image: str, x: str, y: str, radius: float, cell: float, width: int, height: int) -> DataFrame:
    """(image, cx, cy, n): how many points are within radius of a cell's centre, 255 at most; cells of the image only."""
    span = lambda c, most: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - radius) / cell).cast("int")), F.least(F.lit(most - 1), F.floor((F.col(c) + radius) / cell).cast("int"))))
    inside = points.where((F.col(x) >= -radius) & (F.col(x) < width + radius) & (F.col(y) >= -radius) & (F.col(y) < height + radius))
    at = inside.select(F.col(image).alias("image"), F.col(x).alias("x"), F.col(y).alias("y")).withColumn("cx", span("x", -(-width // int(cell)))).withColumn("cy", span("y", -(-height // int(cell))))
    d2 = F.pow((F.col("cx") + 0.5) * cell - F.col("x"), 2) + F.pow((F.col("cy") + 0.5) * cell - F.col("y"), 2)
    return at.where(d2 <= radius * radius).groupBy("image", "cx", "cy").agg(F.least(F.lit(255), F.count("*")).alias("n"))
