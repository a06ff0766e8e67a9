"""A reconstruction as a folder of Parquet tables, and checks of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def digest(df: DataFrame) -> DataFrame:
    """(n, digest): a digest of the rows as a set, whatever their order and partitions."""
    names, types = sorted(df.columns), dict(df.dtypes)
    value = lambda n: F.sort_array(F.map_entries(n)) if types[n].startswith("map<") else F.col(n)
    row = F.xxhash64(*[c for n in names for c in (value(n), F.col(n).isNull())]).cast("decimal(20,0)")  # xxhash64 passes over nulls
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n) of broken constraints: keys that repeat, and observations of points or images that aren't there."""
    p, i, o = tables["points"], tables["images"], tables["observations"]
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("n"))
    out = count("point_index repeats", p.groupBy("point_index").count().where("count > 1"))
    out = out.unionByName(count("image_index repeats", i.groupBy("image_index").count().where("count > 1")))
    out = out.unionByName(count("observation without point", o.join(p, "point_index", "left_anti")))
    out = out.unionByName(count("observation without image", o.join(i, "image_index", "left_anti")))
    return out.where("n > 0")
