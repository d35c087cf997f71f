"""Corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, packing.

Each stage works on all that the stage before kept and returns the columns of
``documents``; the last one returns the pieces of the packed sequences.  A stage's
output is a written table, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitegraph.llm import minhash, mixing, packing, quality, substrings
from sitegraph.llm.common import Tables
from sitegraph.llm.tokens import tokenizer_path

TOKENIZER = "word_bpe_49k.json"

#: Near-duplicates, hash-based choices and tokenizer ids have no SQL form; pytest compares
#: the whole pipeline with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.remove(spark, docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = store.write(stage(spark, docs, sf_dir), name)
    return docs
