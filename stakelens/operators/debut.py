"""First appearances, and how many have appeared by a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_seen(
    df: DataFrame, entity: Column | str, name: str, debut: str = "debut"
) -> DataFrame:
    """Earliest block_timestamp per entity, combined before the shuffle."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    return df.groupBy(entity.alias(name)).agg(F.min("block_timestamp").alias(debut))


def appeared_before(df: DataFrame, entity: str) -> DataFrame:
    """For each calendar day, how many entities appeared on an earlier day.

    Days before anyone has appeared are absent. A NULL entity makes its later days
    present but is not counted; rows without a timestamp appear on no day.
    Replaces the inequality join of every event with every entity: at most one row
    per calendar day leaves this function.

    Output: date, entities.
    """
    return spans_before(
        df.groupBy(entity).agg(
            F.min("block_timestamp").alias("debut"), F.max("block_timestamp").alias("last_seen")
        ),
        entity,
    )


def spans_before(seen: DataFrame, entity: str) -> DataFrame:
    """The same from the first and last time, ``debut`` and ``last_seen``, of each entity."""
    spans = seen.filter(F.col("debut").isNotNull()).select(
        entity, F.to_date("debut").alias("debut"), F.to_date("last_seen").alias("last_day")
    )
    debuts = spans.groupBy("debut").agg(
        F.count(entity).alias("appeared"), F.max("last_day").alias("last_day")
    )
    by_day = W.orderBy("debut")
    every_day = W.partitionBy()
    return (
        debuts.select(
            F.sum("appeared").over(by_day).alias("entities"),
            F.date_add("debut", 1).alias("first"),
            F.coalesce(
                F.lead("debut").over(by_day),
                F.greatest(F.date_add("debut", 1), F.max("last_day").over(every_day)),
            ).alias("last"),
        )
        .select("entities", F.explode(F.sequence("first", "last")).alias("date"))
        .select("date", "entities")
    )
