"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.llm import (conversations, embeddings, minhash, mixing, packing, quality, retrieval, scoring, sharding,
                           substrings, suffixes, toxicity, warc)
from sitegraph.llm.registry import ORACLES, REGISTRY, register, table
from sitegraph.llm.tokens import tokenizer_path

SHARDS = 16


@register("op1_kd_sharding")
def op1(spark, sf_dir):
    out = sharding.shard(spark, table(spark, sf_dir, "documents"), leaves=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@register("op2_one_permutation_minhash")
def op2(spark, sf_dir):
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), width=4).select(
        "doc_id", "n_shingles", "component_id", "kept")


@register("op3_kneser_ney_toxicity")
def op3(spark, sf_dir):
    held_out = toxicity.remainder(F.col("doc_id"), 3) == 1
    out = toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register("op4_indexed_warc", warc.oracle())
def op4(spark, sf_dir):
    return warc.read(warc.write(spark, table(spark, sf_dir, "pages"))).drop("url")


@register("op5_difference_cover_substrings")
def op5(spark, sf_dir):
    return substrings.digest(spark, table(spark, sf_dir, "documents"))


@register("op6_adaptive_quality", quality.oracle())
def op6(spark, sf_dir):
    return quality.assess(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op7_hash_threshold_mixing", mixing.oracle())
def op7(spark, sf_dir):
    return mixing.mix(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@register("op8_attention_scoring")
def op8(spark, sf_dir):
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % 7 == 2
    return scoring.score(spark, table(spark, sf_dir, "documents"), held_out, tokenizer_path("word_bpe_49k.json"))


@register("op9_pca_tiled_embeddings")
def op9(spark, sf_dir):
    return embeddings.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


@register("op10_cutting_stock_packing")
def op10(spark, sf_dir):
    return packing.pack(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register("op11_reversed_search", retrieval.oracle())
def op11(spark, sf_dir):
    return retrieval.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op12_suffix_merge_sort")
def op12(spark, sf_dir):
    return suffixes.digest(spark, table(spark, sf_dir, "documents"))


@register("op13_cyk_conversation_repair", conversations.oracle())
def op13(spark, sf_dir):
    return conversations.repaired(spark, table(spark, sf_dir, "conversations"))


def queries():
    return dict(REGISTRY)


def oracle_sql():
    return dict(ORACLES)
