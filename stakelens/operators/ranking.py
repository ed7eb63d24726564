"""Running totals, ranks and prefix sums per period."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens.operators import skew as sk

# Slices per factor of ten; one slice holds values within about 0.02 % of each other.
SLICES_PER_DECADE = 10_000

# Parts that validators are dealt to; more than there are tasks, few enough to merge ties.
SALT = "salt"
SALTS = 1024

# What is added up downwards through the stakes of a period.
SUMMED = ("validators", "stake", "flow")


def running_total(period: str, value: str) -> Column:
    """Running total over all periods, for a table with one row per period.

    The window has no partitioning and so runs in one task, on no more rows than
    there are calendar periods.
    """
    return F.sum(value).over(W.orderBy(period))


def cumulative_stake(flows: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Adds ``cum``, the running stake of each validator, and ``salt``, its part of the rows.

    A validator has at most one row per calendar period, which bounds the window. With
    ``opening`` (validator, balance), the stakes at the end of the period before, later flows
    are enough: the running stakes are those over all flows.
    """
    salted = flows.withColumn(SALT, F.pmod(F.xxhash64("validator"), F.lit(SALTS)))
    dealt = sk.dealt(salted, SALT)
    # Grouped by salt, rows stay where they are for this window and for `stake_levels`.
    running = F.sum("flow").over(W.partitionBy(SALT, "validator").orderBy("days"))
    if opening is None:
        return dealt.withColumn("cum", running)
    known = opening.select("validator", "balance")
    started = dealt.withColumn("cum", running).join(known, "validator", "left")
    cum = F.col("cum") + F.coalesce("balance", F.lit(0).cast("decimal(38,0)"))
    return started.withColumn("cum", cum.cast("decimal(38,0)")).drop("balance")


def closing_balances(
    positions: DataFrame, opening: DataFrame | None, first: date, last: date
) -> DataFrame:
    """Stake of every validator at the end of each month from ``first`` to ``last``.

    ``positions`` has days, validator and cum in these months, ``opening`` the balances before
    them. A validator keeps its stake in months without a movement.
    Output: month, validator, balance.
    """
    month = F.trunc("days", "month").alias("month")
    moved = positions.groupBy("validator", month).agg(F.max_by("cum", "days").alias("balance"))
    if opening is not None:
        before = F.add_months(F.lit(first), -1).alias("month")
        moved = moved.unionByName(opening.select("validator", before, "balance"))
    following = F.lead("month").over(W.partitionBy("validator").orderBy("month"))
    until = F.coalesce(F.add_months(following, -1), F.lit(last))
    held = F.explode(F.sequence("month", "until", F.expr("INTERVAL 1 MONTH"))).alias("month")
    return (
        moved.withColumn("until", until)
        .select("validator", "balance", held)
        .filter(F.col("month") >= F.lit(first))
        .select("month", "validator", "balance")
    )


def _slice(value: str) -> Column:
    """Whole number that never decreases as the value grows."""
    number = F.col(value).cast("double")
    magnitude = F.floor(F.log10(F.abs(number) + 1) * SLICES_PER_DECADE)
    return (F.signum(number) * magnitude).cast("int")


def _all_set(*names: str) -> Column:
    return reduce(and_, [F.col(name).isNotNull() for name in names])


def stake_levels(positions: DataFrame, opening_total: Decimal | None = None) -> DataFrame:
    """Rank and prefix sum of every distinct stake of a period, largest first.

    ``opening_total`` is the total before the first period, if earlier flows are left out.

    ``positions`` has days, validator, flow, cum. Validators with equal stake share
    the lowest of their places (10, 10, 5 rank 2, 2, 3) and the prefix sum of the
    whole tie. Validators absent from a period are not ranked in it, while
    ``total`` is the running total of all flows up to it.

    A window over a period would sort all its validators in one task. Instead
    equal stakes become one row, rows are cut into slices by magnitude, and each
    slice starts from the count and sum of the slices above it. The number of slices
    in a period is bounded by the range of its stakes. The sums of a slice are those of
    its lowest stake, and the sum of a period that of its lowest slice, so that neither
    needs a shuffle of its own.

    Output: days, cum, validators, rank, run, total.
    """
    # This filter and the next two hold for every row. Saying so gives the readers of
    # a table the same columns and filters, so that Spark shuffles it once for them.
    sliced = positions.withColumn("slice", _slice("cum")).filter(_all_set("days", "slice"))
    keys = ["days", "slice", "cum"]
    salted = [SALT] if SALT in positions.columns else []
    # Ties within a salt are merged before anything moves: rows are dealt by salt already.
    merged = sliced.groupBy(*salted, *keys).agg(
        F.count("*").alias("validators"), F.sum("flow").alias("flow")
    )
    levels = (
        # The one shuffle of the levels serves the merging of ties and both windows below. Merged
        # by adaptive execution, its partitions would be as large as those before it were.
        sk.dealt(merged, "days", "slice")
        .groupBy(*keys)
        .agg(F.sum("validators").alias("validators"), F.sum("flow").alias("flow"))
        .withColumn("stake", F.col("cum") * F.col("validators"))
    )
    falling = W.partitionBy("days", "slice").orderBy(F.desc("cum"))
    inside = levels.select(
        "days",
        "slice",
        "cum",
        "validators",
        *[
            F.sum(name).over(falling.rowsBetween(W.unboundedPreceding, 0)).alias(f"{name}_inside")
            for name in SUMMED
        ],
        F.lead("cum").over(falling).isNull().alias("lowest"),
    ).filter(_all_set(*[f"{name}_inside" for name in SUMMED]))
    # The lowest stake of a slice has the sums of the whole slice.
    downwards = W.partitionBy("days").orderBy(F.desc("slice"))
    slices = (
        inside.filter("lowest")
        .select(
            "days",
            "slice",
            *[F.col(f"{name}_inside").alias(name) for name in SUMMED],
        )
        .select(
            "*",
            *[
                F.sum(name).over(downwards.rowsBetween(W.unboundedPreceding, 0)).alias(f"{name}_to")
                for name in SUMMED
            ],
            F.lead("slice").over(downwards).isNull().alias("lowest"),
        )
        .filter(_all_set(*SUMMED, *[f"{name}_to" for name in SUMMED]))
    )
    total = running_total("days", "flow_to")
    if opening_total is not None:
        total = (total + F.lit(opening_total)).cast("decimal(38,0)")
    totals = slices.filter("lowest").select("days", total.alias("total"))
    starts = slices.select(
        "days",
        "slice",
        (F.col("validators_to") - F.col("validators")).alias("validators_above"),
        (F.col("stake_to") - F.col("stake")).alias("stake_above"),
    ).join(totals, "days")
    return inside.join(starts, ["days", "slice"]).select(
        "days",
        "cum",
        "validators",
        (F.col("validators_above") + F.col("validators_inside")).alias("rank"),
        (F.col("stake_above") + F.col("stake_inside")).alias("run"),
        "total",
    )


def within_share(pct: int) -> Column:
    """Whether a prefix sum is at most ``pct`` percent of the total, exactly."""
    return F.col("run") * 100 <= F.col("total") * pct
