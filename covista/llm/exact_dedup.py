"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash of what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, quoted, repeated_keys, scratch_table, texts, through_sieve


def _normal(text):
    return F.regexp_replace(text, f"{SPACE}+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """The groups of two rows and more whose texts are equal without white space.

    Returns (doc_id, th, chars, text_sha256, keep_id, keep_chars, group_size) for each row of a group; th is a hash of
    the original text, chars its code points. keep_id is the row with the most code points, then the smallest id (a null
    id is the smallest).

    A first scan keeps each row's length and prefix hash only; rows alone in their length, then rows alone in their
    (length, prefix), leave. The full texts of the survivors are hashed where they lie: a bitmap of bounded size picks
    them (through_sieve), so no text is shuffled, and their digests are then joined exactly.
    """
    base = texts(docs, id_col, text_col)
    norm = _normal(F.col("text"))
    sizes = scratch_table(base.select("doc_id", norm.alias("norm")).select("doc_id", F.length("norm").alias("n"), F.xxhash64(F.left("norm", F.lit(prefix_chars))).alias("prefix")))
    left = sizes.join(repeated_keys(sizes, "n"), "n", "left_semi")
    left = scratch_table(left.join(repeated_keys(left, "n", "prefix"), ["n", "prefix"], "left_semi").select("doc_id", "n", "prefix").distinct())
    ids = left.select(F.col("doc_id").alias("i"), "n", F.xxhash64("doc_id", "n").alias("k"))
    long = base.select("doc_id", "text", norm.alias("norm")).withColumn("n", F.length("norm"))
    some, _ = through_sieve(long, F.xxhash64("doc_id", "n"), ids.select("k"))
    some = some.select("doc_id", "n", F.xxhash64("text").alias("th"), F.length("text").alias("chars"), F.sha2("norm", 256).alias("text_sha256"), F.xxhash64("doc_id", "n").alias("k")).alias("x")
    full = some.join(ids, (F.col("x.k") == ids["k"]) & F.col("x.doc_id").eqNullSafe(F.col("i")) & (F.col("x.n") == ids["n"]), "left_semi")
    full = scratch_table(full.select("doc_id", "th", "chars", "text_sha256"))
    best = full.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("chars")).alias("c"), "doc_id")).alias("best")).where("group_size > 1")
    best = scratch_table(best.select("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.c")).alias("keep_chars")))
    return full.join(best, "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the text without white space).

    Null texts count as empty, and empty texts are equal to each other. Exactly one row of a group is kept, also where
    rows repeat an id. Other columns are left out, so their names don't matter. An empty table gives no rows.
    """
    groups = exact_groups(docs, id_col, text_col, prefix_chars).select(F.col("doc_id").alias("i"), F.col("text_sha256").alias("h"), "keep_id", "keep_chars", "group_size").distinct()
    groups = scratch_table(groups)
    all_ = texts(docs, id_col, text_col).select("doc_id", F.length("text").alias("chars"), F.sha2(_normal(F.col("text")), 256).alias("text_sha256"))
    x = all_.join(groups, all_["doc_id"].eqNullSafe(F.col("i")) & (F.col("text_sha256") == F.col("h")), "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.desc("chars")))
    alone = F.col("group_size").isNull()
    return x.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")) & (nth == 1))).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """docs, with all its columns, without the rows that exact_dedup() doesn't keep.

    Only the rows to go, and those that repeat both the id and the text of a row that stays, are looked up: a bitmap of
    bounded size picks them where they lie, so no other text is shuffled.
    """
    groups = scratch_table(exact_groups(docs, id_col, text_col, prefix_chars))
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    gone = groups.where(~best).select("doc_id", "th", F.lit(None).cast("string").alias("twin")).distinct()
    twins = groups.where(best).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"), F.collect_set("th").alias("ths")).where("n > 1")
    twins = twins.select("doc_id", F.explode("ths").alias("th"), F.col("text_sha256").alias("twin"))
    out = scratch_table(gone.unionByName(twins).select(F.xxhash64("doc_id", "th").alias("_k"), F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("twin").alias("_twin")))
    own = F.xxhash64(F.col(quoted(id_col)), F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    maybe, kept = through_sieve(docs, own, out.select("_k"))
    names = docs.columns
    row = maybe.select(F.struct("*").alias("_row"), F.col(quoted(id_col)).alias("_own"), own.alias("_own_k"))
    row = row.join(out, (F.col("_own_k") == F.col("_k")) & F.col("_own").eqNullSafe(F.col("_id")), "left")
    back = [F.col(f"_row.{quoted(c)}").alias(c) for c in names]
    kept = kept.unionByName(row.where("_k is null").select(*back))
    again = row.where("_twin is not null").dropDuplicates(["_own", "_twin"]).select(*back)
    return kept.unionByName(again)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
