"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.llm import (
    co_training,
    content_sort,
    group_packing,
    line_dedup,
    main_text,
    merkle_pivot,
    ngram_join,
    packing,
    quality_rules,
    scratch,
    soft_mixing,
    substring_dedup,
    value_codes,
    warc,
)

TOKENIZER = os.environ.get("LLM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents"))
    too_long = F.col("longest_repeat") > quality_rules.MAX_LONGEST
    return judged.withColumn("too_long_repeat", too_long).drop("longest_repeat")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.summary(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    found = warc.resolved(warc.read(spark, path))
    broken = F.raise_error(F.concat(F.lit("an archive is broken: "), F.col("error")))
    checked = F.when(F.col("error").isNotNull(), broken.cast("string"))
    kind = F.coalesce(checked, F.col("record_type")).alias("record_type")
    return found.select("page_id", "payload_bytes", "payload_digest", kind, "refers_to")


def op4_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.decisions(_table(spark, sf_dir, "documents"))


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(_table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(_table(spark, sf_dir, "documents")).drop("td")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.cleaned(line_dedup.build(docs), docs)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_training.scored(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op11_group_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = group_packing.packed(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return placed.drop("part", "nth")


def op12_merkle_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle_pivot.manifest(docs, merkle_pivot.tampered_text())


def op13_value_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_codes.compressed(_table(spark, sf_dir, "embeddings")).drop("label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules,
            op2_substring_dedup,
            op3_warc,
            op4_content_sort,
            op5_soft_mixing,
            op6_main_text,
            op7_ngram_join,
            op8_line_dedup,
            op9_packing,
            op10_co_training,
            op11_group_packing,
            op12_merkle_pivot,
            op13_value_codes,
        )
    }
