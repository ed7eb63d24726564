"""Sums of doubles that come out equal in every bit, however the rows are dealt and ordered.

Adding doubles rounds after each step, so the sum depends on the order. Here each value is cut
into whole numbers on a scale of its own magnitude; whole numbers are added exactly, and the
few magnitudes of a group meet at the end, largest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A bin holds the values whose magnitude lies within this many powers of two.
BIN_BITS = 32
# Below a power of two, a fraction of a double has no more bits than these.
FRACTION_BITS = 53
_COUNTED = "decimal(20,0)"


def _is_special(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def _scaled(value: Column, bin_: Column) -> Column:
    """The value over 2**(BIN_BITS * bin), exactly: two steps, as one might overflow."""
    half = F.pow(F.lit(2.0), -bin_ * (BIN_BITS // 2))
    return value * half * half


def exact_sum(
    df: DataFrame, keys: list[str], value: Column, name: str, times: Column | None = None
) -> DataFrame:
    """One row for each combination of `keys` with the sum of `value`, each counted `times`.

    NULL values count as nothing; a group of these sums to 0. NaN, or infinities of both
    signs, give NaN, and infinities of one sign that infinity. The sum is exact within a
    magnitude; at most 70 magnitudes of a group are then added, always in the same order.
    """
    x = F.col("x")
    finite = ~_is_special(x) & (x != 0)
    bin_ = F.floor(F.log2(F.abs(x)) / BIN_BITS).cast("int")
    cut = df.select(
        *keys, value.cast("double").alias("x"), (F.lit(1) if times is None else times).alias("t")
    ).select(*keys, "t", F.when(_is_special(x), x).alias("special"), "x",
             F.when(finite, bin_).alias("bin"))
    scaled = _scaled(x, F.col("bin"))
    # Whole and fractional part as whole numbers; a value not in a bin has neither.
    whole = F.when(F.col("bin").isNotNull(), F.floor(scaled))
    fraction = F.when(
        F.col("bin").isNotNull(), (scaled - F.floor(scaled)) * F.lit(2.0**FRACTION_BITS)
    )
    t = F.col("t").cast(_COUNTED)
    binned = cut.groupBy(*keys, "bin").agg(
        F.sum(whole.cast("bigint").cast(_COUNTED) * t).alias("whole"),
        F.sum(fraction.cast("bigint").cast(_COUNTED) * t).alias("fraction"),
        F.sum("special").alias("special"),
    )
    bins = F.collect_list(
        F.when(F.col("bin").isNotNull(), F.struct((-F.col("bin")).alias("b"), "whole", "fraction"))
    )
    half = lambda b: F.pow(F.lit(2.0), -b["b"] * (BIN_BITS // 2))
    of_bin = lambda b: (
        b["whole"].cast("double") + b["fraction"].cast("double") / F.lit(2.0**FRACTION_BITS)
    ) * half(b) * half(b)
    added = F.aggregate(F.array_sort("bins"), F.lit(0.0), lambda s, b: s + of_bin(b))
    return (
        binned.groupBy(*keys)
        .agg(bins.alias("bins"), F.sum("special").alias("special"))
        .select(*keys, F.coalesce(F.col("special"), added).alias(name))
    )
