"""Signed stake flows per period and validator, from either staking source.

Amounts stay whole micro-units in DECIMAL(38,0): ranks and thresholds computed
from them do not depend on the order in which Spark adds them up.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakelens.functions import columns as C
from stakelens.operators import skew as sk
from stakelens.spec import AttributeLeg

# A single movement of 10^9 units or more is taken for bad data.
MICRO_BOUND = 10**15

# What makes two legs of typed actions, or two entries of the log, the same.
LEG = ("block_timestamp", "tx_id", "validator", "staked")
ENTRY = ("tx_id", "block_timestamp", "name", "size", "huge")

# Sizes below MICRO_BOUND are added up as two whole numbers, of their bits above these and of
# these. Neither sum overflows before 2**38 movements, and no row is added as a DECIMAL.
LOW_BITS = 25


def _marked_legs(staking: DataFrame, denom: str, inbound: tuple[str, ...]) -> DataFrame:
    """Legs of typed staking actions, and the readings each belongs to as a bit set.

    Readings differ in the denomination of the positive leg of a redelegation, ``inbound``.
    """
    source = F.col("redelegate_source_validator_address")
    target = F.col("validator_address")
    amount = F.col("amount").cast(C.MICRO)

    def leg(validator: Column, staked: Column, readings: Column) -> Column:
        return F.struct(
            validator.alias("validator"), staked.alias("staked"), readings.alias("readings")
        )

    own = F.col("currency") == denom
    every = F.when(own, F.lit((1 << len(inbound)) - 1)).otherwise(0)
    positive = _bits({i: F.col("currency") == name for i, name in enumerate(inbound)})
    single = leg(target, F.when(F.col("action") == "undelegate", -amount).otherwise(amount), every)
    legs = F.when(source.isNull(), F.array(single)).otherwise(
        F.array(leg(source, -amount, every), leg(target, amount, positive))
    )
    others = [name for name in inbound if name != denom]
    read = own | (source.isNotNull() & F.col("currency").isin(others)) if others else own
    return (
        staking.filter(read & F.col("amount").isNotNull())
        .select("block_timestamp", "tx_id", F.explode(legs).alias("leg"))
        .select("block_timestamp", "tx_id", "leg.*")
        .filter("readings != 0")
    )


def typed_legs(staking: DataFrame, denom: str, inbound_denom: str | None = None) -> DataFrame:
    """Legs of typed staking actions, identical legs of one transaction merged.

    A redelegation gives a negative leg for its source and a positive one for its
    target; any other action one leg, negative for ``undelegate``. Both legs come
    from a single scan. With ``inbound_denom`` the positive redelegation leg is
    taken from rows of that currency instead.

    Output: block_timestamp, tx_id, validator, staked.
    """
    legs = _marked_legs(staking, denom, (inbound_denom or denom,))
    # Dealt by the whole row, so no transaction or validator, however
    # frequent, ends up in one task.
    return sk.dealt(legs.select(*LEG), *LEG).distinct()


def typed_flows(
    staking: DataFrame, grain: str, denom: str, inbound_denom: str | None = None
) -> DataFrame:
    """Net stake moved per period and validator: days, validator, flow."""
    return (
        typed_legs(staking, denom, inbound_denom)
        .groupBy(C.period("block_timestamp", grain).alias("days"), "validator")
        .agg(F.sum("staked").alias("flow"))
    )


def typed_flows_both(
    staking: DataFrame, grain: str, denom: str, inbound_denom: str
) -> DataFrame:
    """The flows without and with another inbound denomination, from one scan.

    Output: days, validator, flow, flow_nakamoto (NULL where there is none).
    """
    legs = _marked_legs(staking, denom, (denom, inbound_denom))
    merged = sk.dealt(legs, *LEG).groupBy(*LEG).agg(F.bit_or("readings").alias("readings"))
    staked = [F.when(_overlap(F.col("readings"), F.lit(1 << i)), F.col("staked")) for i in (0, 1)]
    return merged.groupBy(C.period("block_timestamp", grain).alias("days"), "validator").agg(
        F.sum(staked[0]).alias("flow"), F.sum(staked[1]).alias("flow_nakamoto")
    )


def _is(msg_type: str, keys: tuple[str, ...]) -> Column:
    return (F.col("msg_type") == msg_type) & F.col("attribute_key").isin(*keys)


def _bits(matches: dict[int, Column]) -> Column:
    """Bit set of the numbers whose condition holds."""
    bits = [F.when(match, F.lit(1 << i)).otherwise(F.lit(0)) for i, match in matches.items()]
    return reduce(lambda left, right: left.bitwiseOR(right), bits, F.lit(0))


def _overlap(left: Column, right: Column) -> Column:
    return left.bitwiseAND(right) != 0


def attribute_entries(attributes: DataFrame, legs: tuple[AttributeLeg, ...]) -> DataFrame:
    """What each transaction moves and which validators it names, without repeats.

    An amount equal in time, denomination and size is one entry however many
    messages repeat it, and so is a validator; merging the legs' rows comes to the
    same. ``legs`` holds three bit sets of ``n`` legs: those through which an amount
    is added, those through which it is taken away, and those a validator is named in.

    Only an amount below zero may be out of bounds; its size is in ``huge``, as a DECIMAL.

    Output: tx_id, block_timestamp, name (denomination or validator), size, huge, legs.
    """
    n = len(legs)
    paid = [_is(leg.msg_type, leg.amount_keys) for leg in legs]
    named = [_is(leg.msg_type, (leg.validator_key,)) for leg in legs]
    outbound = _bits({i: paid[i] for i, leg in enumerate(legs) if leg.sign < 0})
    inbound = _bits({i: paid[i] for i, leg in enumerate(legs) if leg.sign > 0})
    # Compared and grouped as a DECIMAL, an amount costs several times what it does as a number.
    micro, small = F.col("micro"), F.col("small")
    within = (micro < MICRO_BOUND) & (micro > -MICRO_BOUND)
    is_amount, is_validator = reduce(or_, paid), reduce(or_, named)
    entries = (
        attributes.filter(is_amount | is_validator)
        .withColumn("denom", F.when(is_amount, C.denomination("attribute_value")))
        .withColumn("micro", C.micro_amount("attribute_value", "denom"))
        .withColumn("small", F.when(within, micro).cast("bigint"))
        .select(
            "tx_id",
            F.when(is_amount, F.col("block_timestamp")).alias("block_timestamp"),
            F.when(is_amount, F.col("denom")).otherwise(F.col("attribute_value")).alias("name"),
            F.abs(small).alias("size"),
            F.when(micro <= -MICRO_BOUND, -micro).alias("huge"),
            # An amount below zero turns its legs round. One that does not parse or is
            # out of bounds has no legs: it drops out after the aggregation, as a
            # filter here would be pushed below the parsing and parse twice.
            F.when(is_validator, F.shiftleft(_bits(dict(enumerate(named))), 2 * n))
            .when(small > 0, inbound.bitwiseOR(F.shiftleft(outbound, n)))
            .when(
                (small < 0) | (micro <= -MICRO_BOUND), outbound.bitwiseOR(F.shiftleft(inbound, n))
            )
            .when(small == 0, inbound.bitwiseOR(outbound))
            .otherwise(0)
            .alias("legs"),
        )
    )
    return entries.groupBy(*ENTRY).agg(F.bit_or("legs").alias("legs"))


def _applied_legs(
    attributes: DataFrame, readings: tuple[tuple[AttributeLeg, ...], ...], grain: str
) -> DataFrame:
    """Stake each transaction moves per validator it names, in each reading of the legs.

    Within a transaction every amount of a leg applies to every validator of that
    leg. Joining amounts to validators would emit all those pairs only to add them
    up again; here the amounts are added up first, so a transaction of ``a``
    amounts and ``v`` validators costs ``a + v`` rows instead of ``a * v``. If a
    transaction is hot, its validators are, on one side of the join: adaptive
    execution splits that partition.

    Output: tx_id, days, validator, and for reading i entries_i and the parts of its stake
    (``_staked`` puts them together), which are NULL where no leg of the reading applies; one
    row per combination of legs.
    """
    legs = tuple(leg for reading in readings for leg in reading)
    n = len(legs)
    every = (1 << n) - 1
    # Both halves select on the aggregated bit sets, which cannot be pushed below the
    # aggregation, and so share its scan and its shuffle.
    entries = attribute_entries(attributes, legs)
    moved, named = F.col("legs").bitwiseAND((1 << 2 * n) - 1), F.shiftright("legs", 2 * n)
    amounts = (
        entries.filter(moved != 0)
        .groupBy("tx_id", C.period("block_timestamp", grain).alias("days"), moved.alias("moved"))
        .agg(
            F.count("*").alias("amounts"),
            F.sum(F.shiftright("size", LOW_BITS)).alias("high"),
            F.sum(F.col("size").bitwiseAND((1 << LOW_BITS) - 1)).alias("low"),
            F.sum("huge").alias("huge"),
        )
        .withColumn("plus", F.col("moved").bitwiseAND(every))
        .withColumn("minus", F.shiftright("moved", n))
    )
    validators = entries.filter(named != 0).select(
        "tx_id", F.col("name").alias("validator"), named.alias("named")
    )
    first, any_applies, results = 0, F.lit(False), []
    for i, reading in enumerate(readings):
        own = F.lit(((1 << len(reading)) - 1) << first)
        first += len(reading)
        mine = F.col("named").bitwiseAND(own)
        added = _overlap(F.col("plus"), mine).cast("int")
        taken = _overlap(F.col("minus"), mine).cast("int")
        applies = added + taken > 0
        any_applies = any_applies | applies
        sign = added - taken
        results.append(
            F.when(applies, (added + taken) * F.col("amounts")).alias(f"entries_{i}")
        )
        results += [F.when(applies, sign * F.col(x)).alias(f"{x}_{i}") for x in ("high", "low")]
        huge = F.when(applies & F.col("huge").isNotNull(), (sign * F.col("huge")).cast(C.MICRO))
        results.append(huge.alias(f"huge_{i}"))
    return (
        validators.join(amounts, "tx_id")
        .filter(any_applies)
        .select("tx_id", "days", "validator", *results)
    )


def _staked(high: Column, low: Column, huge: Column) -> Column:
    """Micro-units of which these are the parts; NULL where there are none."""
    small = high.cast(C.MICRO) * F.lit(1 << LOW_BITS) + low.cast(C.MICRO)
    # A size is in bounds or huge, so a sum may have one kind only.
    none = F.lit(0).cast(C.MICRO)
    whole = F.coalesce(small.cast(C.MICRO), none) + F.coalesce(huge, none)
    return F.when(high.isNotNull() | huge.isNotNull(), whole.cast(C.MICRO))


def _staked_sum(i: int) -> Column:
    """Sum of the stake of reading ``i`` over rows of ``_applied_legs``."""
    return _staked(*[F.sum(f"{x}_{i}") for x in ("high", "low", "huge")])


def attribute_legs(
    attributes: DataFrame, legs: tuple[AttributeLeg, ...], grain: str
) -> DataFrame:
    """Stake each transaction moves per validator it names.

    Output: tx_id, days, validator, entries, staked; one row per combination of legs.
    """
    return _applied_legs(attributes, (legs,), grain).select(
        "tx_id",
        "days",
        "validator",
        F.col("entries_0").alias("entries"),
        _staked(F.col("high_0"), F.col("low_0"), F.col("huge_0")).alias("staked"),
    )


def attribute_flows(
    attributes: DataFrame, legs: tuple[AttributeLeg, ...], grain: str
) -> DataFrame:
    """Net stake moved per period and validator: days, validator, flow."""
    return (
        _applied_legs(attributes, (legs,), grain)
        .groupBy("days", "validator")
        .agg(_staked_sum(0).alias("flow"))
    )


def attribute_flows_both(
    attributes: DataFrame,
    legs: tuple[AttributeLeg, ...],
    nakamoto_legs: tuple[AttributeLeg, ...],
    grain: str,
) -> DataFrame:
    """The flows of two readings of the legs, from one read of the log.

    Output: days, validator, flow, flow_nakamoto (NULL where there is none).
    """
    return (
        _applied_legs(attributes, (legs, nakamoto_legs), grain)
        .groupBy("days", "validator")
        .agg(_staked_sum(0).alias("flow"), _staked_sum(1).alias("flow_nakamoto"))
    )
