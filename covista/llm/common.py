"""Shared plumbing: scratch tables in the cluster's shared folder, connected components, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"

#: Spark removes a statement's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); in local mode a temporary one is set where none is set, else that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='covista-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_table(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage ends there, and lost executors cost no recomputation.

    The shuffle files of the write go with it, as nothing reads them again; the table goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/covista-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def bucketed_table(df: DataFrame, key: str) -> DataFrame:
    """Write df to the shared folder, dealt into spark.sql.shuffle.partitions buckets by key, and read it again.

    Joins on key then read their buckets where they lie: df is shuffled once, however often it is joined. The table's
    name is dropped at once; its files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    name, n = f"covista_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).saveAsTable(name)
    finally:
        spark.conf.set(CLEAN_UP, before) if before else spark.conf.unset(CLEAN_UP)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.table(name)
    out.count()  # its files are listed before the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


#: Rows that go to a Python worker at a time: texts and signatures are long, and Spark's own default is 10,000.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_ROWS at most, which bounds the memory of workers and of the JVM's buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries, in a session with bounded_batches()."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, null texts as empty ones; whatever else the table has is left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text) as a table in buckets by rid, a number for each row, so that rows that repeat an id, or all, are told apart."""
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return bucketed_table(rows.withColumn("rid", F.monotonically_increasing_id()), "rid")


#: Bits of a sieve for each key, and the most bits of one: 64 MB are sent to every executor at most.
SIEVE_BITS, MOST_BITS, _PAGE = 64, 1 << 29, 1 << 15


def through_sieve(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among keys, rows whose key is not), split where the rows are, without a shuffle of them.

    key is a long that is not null, and keys has one such column. The keys set bits of a bitmap, in pages of 32,768 bits;
    it has SIEVE_BITS bits a key, but no more than MOST_BITS in all, which bounds what is sent to the executors. The first
    part has all rows whose key is there, and about 1 in SIEVE_BITS of the others; whoever needs it exact joins it with
    keys. Beyond MOST_BITS / SIEVE_BITS keys that part of the others grows, to all of them at last.
    """
    column = keys.columns[0]
    n = keys.count()
    bits = min(MOST_BITS, max(_PAGE, 1 << (n * SIEVE_BITS).bit_length()))
    at = F.pmod(F.col(column), F.lit(bits))
    pages = scratch_table(keys.groupBy(F.floor(at / _PAGE).alias("_sieve_page")).agg(F.bitmap_construct_agg(F.pmod(F.col(column), F.lit(_PAGE))).alias("_sieve_bits")))
    own = [F.col(f"_sieve_row.{quoted(c)}").alias(c) for c in rows.columns]
    placed = rows.select(F.struct("*").alias("_sieve_row"), F.pmod(key, F.lit(bits)).alias("_sieve_at"))
    met = placed.join(F.broadcast(pages), F.floor(F.col("_sieve_at") / _PAGE) == F.col("_sieve_page"), "left")
    byte = F.conv(F.hex(F.expr("substring(_sieve_bits, cast(pmod(_sieve_at, 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    inside = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(_sieve_at, 8) as int))")) != 0, F.lit(False))
    return met.where(inside).select(*own), met.where(~inside).select(*own)


def quoted(name: str) -> str:
    """A column name that may hold dots and blanks, for F.col."""
    return "`" + name.replace("`", "``") + "`"


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, as a table of their own.

    Counts are combined before the shuffle, so a hot key costs one row a task. The result is written: the join that
    follows then has a plain exchange on each side, so that a hot key of its larger side can be split at run time.
    """
    return scratch_table(df.groupBy(*keys).count().where("count > 1").select(*keys))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, root) for each id that has an edge; root is the least id.

    Alternating large-star and small-star rounds, each written to the shared folder; only minima are aggregated, which
    combine before the shuffle, and joins on hot centres can be split. Stops when a round changes nothing.
    """
    edges = scratch_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch_table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch_table(large)
        least = scratch_table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = scratch_table(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    star = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("id"), "root").distinct())


def slices(batches, rows: int = 256):
    """The batches in parts of no more than so many rows, which bounds what is made of them at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_column(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)
