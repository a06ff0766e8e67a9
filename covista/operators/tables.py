"""Intermediate tables of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode a temporary one is set where none is; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='covista-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and it is computed once. The table goes when the driver's JVM ends.

    batch is how many rows go to a Python task at a time, where they are large.
    """
    spark = df.sparkSession
    if batch is not None:
        old = spark.conf.get(BATCH)
        spark.conf.set(BATCH, batch)
        try:
            return cut(df)
        finally:
            spark.conf.set(BATCH, old)
    path = f"{shared_dir(spark)}/covista-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, each: int = 1 << 19) -> int:
    """How many partitions a shuffle of rows takes for a task to have about `each` of them: the session's number at least. It counts the rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def numbered(df: DataFrame, *order: str, out: str = "number") -> DataFrame:
    """df with out, each row's number from 0 in the order of these columns (nulls first, NaN last), however many rows.

    Rows are sorted over all partitions by range; a row's number is its place in its partition and the rows of the
    partitions before, of which there are as many counts as partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", (before - F.col("__first")).alias("__shift"))
    return placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(out, F.col("__place") + F.col("__shift")).drop("__place", "__part", "__shift")


def whole_groups(batches, key: str, rows: int = 1 << 16):
    """Frames of about so many rows, or more, that hold all rows of the keys in them, from frames in the order of key.

    The rows of one key are held together, whatever their number; a key that a group's size bounds is its caller's to choose.
    """
    import pandas as pd

    held, n = [], 0
    for f in batches:
        if not len(f):
            continue
        held.append(f)
        n += len(f)
        if n >= rows:
            f = pd.concat(held, ignore_index=True)
            at = int((f[key] != f[key].iloc[-1]).to_numpy().sum())
            if at:
                yield f.iloc[:at].reset_index(drop=True)
            held, n = [f.iloc[at:].reset_index(drop=True)], len(f) - at
    if n:
        yield pd.concat(held, ignore_index=True)
