"""How rows are dealt to tasks: in parts that stay small, also when some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts that the rows of every key are dealt to.
PARTS = 8


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by the columns to all tasks of a shuffle.

    A sort or a hash table of a task takes many times the bytes that its rows have in a
    shuffle, where they are compressed. Adaptive execution merges partitions by these bytes,
    up to millions of rows in a task; it leaves partitions alone whose number is given. Rows
    that hardly repeat are dealt before they are grouped: grouped first, they would fill a
    hash table at the scan as well and merge nothing.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *columns)


def join_split(
    large: DataFrame, unique: DataFrame, key: str, spread_by: list[str], parts: int = PARTS
) -> DataFrame:
    """Inner join that deals the rows of each key to several parts, whatever its size.

    Rows of ``large`` go to a part of their key by a hash of ``spread_by``; the row of the
    key in ``unique`` is copied to every part. A key with a third of all rows so has at most
    a third of a part's worth in one task, and no count of the keys is needed first. Should a
    part still be too large, adaptive execution splits it: both sides are shuffled for this
    join alone.
    """
    part = F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")
    copies = unique.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return large.withColumn("part", part).join(copies, [key, "part"]).drop("part")
