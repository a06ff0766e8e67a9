"""The registered queries of this subpackage, one for each operator over its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from . import align, bpe, exact_dedup, lang_id, merkle, mixing, near_dup, quotes, secret_scan, simhash, suffix_dedup, topk, word_repeats
from .common import read_table

RANKS, BYTE_BPE, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer() -> tuple[str, str]:
    """The path of the ranks and the pattern, from the installed package of public tokenizers."""
    public = importlib.import_module("public_tokenizers")
    return public.path(RANKS), public.PATTERN


def op1_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", lang_id.fold("doc_id") == 1)
    found = lang_id.identify(docs, lang_id.fit(docs.where("not held_out")))
    return found.select("doc_id", (lang_id.fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark, sf_dir):
    return secret_scan.digests(secret_scan.find_secrets(read_table(spark, sf_dir, "documents"), words=tokenizer()[0]))


def op3_chat_quotes(spark, sf_dir):
    found = quotes.reply_order(read_table(spark, sf_dir, "conversations"))
    return found.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("parent_turn", "source_conv", "source_turn")})


def op4_near_dedup(spark, sf_dir):
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_substring_words(spark, sf_dir):
    return word_repeats.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_exact_topk(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_byte_bpe(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), *tokenizer())


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark, sf_dir):
    public = importlib.import_module("public_tokenizers")
    return align.align(read_table(spark, sf_dir, "documents"), public.path(BYTE_BPE), public.path(PIECES))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_chat_quotes, op4_near_dedup, op5_substring_words, op6_mixing, op7_exact_topk,
        op8_byte_bpe, op9_suffix_dedup, op10_exact_dedup, op11_simhash, op12_token_alignment, op13_merkle_manifest,
    )
}
ORACLES = {"op3_chat_quotes": quotes.ORACLE, "op6_mixing": mixing.ORACLE, "op7_exact_topk": topk.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
