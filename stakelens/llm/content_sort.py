"""Exact deduplication by sorting contents, with DataFrame operations only.

Rows are range-partitioned on the normalised text (its first characters, then its SHA-256,
so that splitters sampled by Spark stay short), sorted within the partitions, and equal
neighbours are merged by comparing whole texts in a sort-based aggregation. A salt from the
id is part of the order: copies of one text that would fill a partition lie in several
ranges, each leaves one row for a salt, and these few rows are merged at the end.

Defined results: a null text counts as empty. A null id is kept only if its group has no
other; `keep_id` is then null. If rows with the same id hold the same text, all but one of
them are dropped. An empty table gives no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.llm.scratch import stored

SALTS = 64
PREFIX = 32


def _unchanged(text: Column) -> Column:
    return text


def digest_of(text: Column, normalise: Callable[[Column], Column] = _unchanged) -> Column:
    return F.unhex(F.sha2(normalise(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def groups(
    df: DataFrame, largest: bool = True, normalise: Callable[[Column], Column] = _unchanged
) -> DataFrame:
    """digest, keep_id and group_size for each distinct text."""
    text = normalise(F.coalesce(F.col("text"), F.lit("")))
    keyed = df.select(
        F.substring(text, 1, PREFIX).alias("prefix"),
        digest_of(F.col("text"), normalise).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"),
        text.alias("text"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    order = ["prefix", "digest", "salt"]
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))
    # A struct in the buffer makes Spark sort the rows and compare neighbours.
    same_text = (
        keyed.repartitionByRange(*order)
        .groupBy(*order, "text")
        .agg(_pick(named, largest).alias("keep"), F.count(F.lit(1)).alias("size"))
    )
    found = same_text.groupBy("digest").agg(
        _pick(F.col("keep.doc_id"), largest).alias("keep_id"), F.sum("size").alias("group_size")
    )
    return stored(found, "groups")  # so that a join on it can split a hot digest


def _pick(column: Column, largest: bool) -> Column:
    return F.max(column) if largest else F.min(column)


def decisions(
    df: DataFrame, largest: bool = True, normalise: Callable[[Column], Column] = _unchanged
) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row, dropped ones too."""
    rows = (
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            digest_of(F.col("text"), normalise).alias("digest"),
        )
        .groupBy("doc_id", "digest")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return (
        rows.join(groups(df, largest, normalise), "digest")
        .withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("time") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def deduplicated(
    df: DataFrame, largest: bool = True, normalise: Callable[[Column], Column] = _unchanged
) -> DataFrame:
    """The rows of `df` that stay, with all their columns."""
    kept = groups(df, largest, normalise).select("digest", "keep_id")
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        digest_of(F.col("text"), normalise).alias("digest"),
    )
    found = rows.join(
        kept,
        (rows["digest"] == kept["digest"]) & rows["id"].eqNullSafe(kept["keep_id"]),
        "left_semi",
    )
    return found.dropDuplicates(["id", "digest"]).select("row.*")
