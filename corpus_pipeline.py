"""From raw documents to packed sequences: the stages of a training corpus, in order.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm import (
    content_sort,
    ngram_join,
    packing,
    quality_rules,
    scratch,
    soft_mixing,
)
from stakelens.llm.queries import TOKENIZER

#: Similarity, classification and packing are not expressible in SQL; tests/llm compares the
#: stages with brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the repetition rule keep."""
    scratch.ship(spark)
    scratch.bound_batches(spark)
    return quality_rules.kept_rows(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return content_sort.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity, the one with the smallest id."""
    scratch.ship(spark)
    scratch.bound_batches(spark)
    return ngram_join.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that bring the domains to their target shares, none twice."""
    return soft_mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    scratch.ship(spark)
    scratch.bound_batches(spark)
    pieces = packing.packed(docs, TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing", mixing),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents under `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
