"""Concentration of stake: voting power, power share and Nakamoto coefficient."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens.functions import columns as C
from stakelens.operators import flows as fl
from stakelens.operators import ranking as rk
from stakelens.sources.tables import ChainTables
from stakelens.spec import ChainSpec


def stake_flows(tables: ChainTables, spec: ChainSpec, for_nakamoto: bool = False) -> DataFrame:
    """Net stake per period and validator in micro-units: days, validator, flow."""
    if spec.staking == "typed":
        inbound = spec.nakamoto_inbound_denom if for_nakamoto else None
        return fl.typed_flows(tables.staking, spec.grain, spec.denom, inbound)
    legs = spec.nakamoto_legs if for_nakamoto else spec.power_legs
    return fl.attribute_flows(tables.msg_attributes, legs, spec.grain)


def stake_flows_both(tables: ChainTables, spec: ChainSpec) -> DataFrame:
    """The flows of a network whose Nakamoto coefficient counts other ones, from one read.

    Output: days, validator, flow, flow_nakamoto (NULL where there is none).
    """
    if spec.staking == "typed":
        return fl.typed_flows_both(
            tables.staking, spec.grain, spec.denom, spec.nakamoto_inbound_denom
        )
    return fl.attribute_flows_both(
        tables.msg_attributes, spec.power_legs, spec.nakamoto_legs, spec.grain
    )


def stake_positions(
    tables: ChainTables, spec: ChainSpec, for_nakamoto: bool = False,
    flows: DataFrame | None = None, opening: DataFrame | None = None,
) -> DataFrame:
    """Flows with each validator's running stake: days, validator, flow, cum."""
    flows = stake_flows(tables, spec, for_nakamoto) if flows is None else flows
    positions = rk.cumulative_stake(flows, opening)
    return positions.filter(F.col("cum") > 0) if spec.positive_only else positions


def power_levels(
    tables: ChainTables, spec: ChainSpec, for_nakamoto: bool = False,
    flows: DataFrame | None = None,
) -> DataFrame:
    """Ranked stakes of each period: all that the three concentration metrics need.

    To compute several of them, write this once and pass it to each (``write_gold``
    does).
    """
    return rk.stake_levels(stake_positions(tables, spec, for_nakamoto, flows))


def power_table(tables: ChainTables, spec: ChainSpec) -> DataFrame:
    """Rank, stake and prefix sum of every validator in every period it moved in.

    Output: days, validator, cum, rank, run, total, money in whole units.
    """
    positions = stake_positions(tables, spec)
    return positions.join(rk.stake_levels(positions), ["days", "cum"]).select(
        "days",
        "validator",
        C.units("cum").alias("cum"),
        "rank",
        C.units("run").alias("run"),
        C.units("total").alias("total"),
    )


def voting_power(
    tables: ChainTables, spec: ChainSpec, levels: DataFrame | None = None
) -> DataFrame:
    """Stake of the top validators that together stay within the threshold.

    NULL in a period whose largest validator alone exceeds it.
    Output: days, voting_power.
    """
    levels = power_levels(tables, spec) if levels is None else levels
    stake = F.when(rk.within_share(spec.power_pct), F.col("cum") * F.col("validators"))
    return (
        levels.groupBy("days")
        .agg(F.sum(stake).alias("micro"))
        .select("days", C.units("micro").alias("voting_power"))
    )


def power_share(
    tables: ChainTables, spec: ChainSpec, levels: DataFrame | None = None
) -> DataFrame:
    """Share of the total stake held by each band of ranks.

    NULL when the total is zero. Output: days, ranks, power_share.
    """
    levels = power_levels(tables, spec) if levels is None else levels
    return (
        levels.groupBy("days", C.rank_band("rank", spec.last_band).alias("ranks"))
        .agg(
            F.sum(F.col("cum") * F.col("validators")).alias("stake"),
            F.max("total").alias("total"),
        )
        .select(
            "days",
            "ranks",
            F.round(
                F.try_divide(F.col("stake").cast("double"), F.col("total").cast("double")), 9
            ).alias("power_share"),
        )
    )


def power_share_normalized(
    tables: ChainTables, spec: ChainSpec, levels: DataFrame | None = None
) -> DataFrame:
    """``power_share`` with each period's bands scaled to fill the whole.

    Bands count by magnitude, as a normalised stacked area draws them; that matters
    only where validators with negative stake outweigh the rest of their band.
    Output: days, ranks, power_share, power_share_normalized.
    """
    share = power_share(tables, spec, levels)
    of_period = F.sum(F.abs("power_share")).over(W.partitionBy("days"))
    return share.withColumn(
        "power_share_normalized",
        F.round(F.try_divide(F.abs("power_share"), of_period), 9),
    )


def nakamoto(
    tables: ChainTables, spec: ChainSpec, levels: DataFrame | None = None
) -> DataFrame:
    """Number of top validators that together stay within the threshold, or 0.

    Output: days, nakamoto_coeff.
    """
    levels = power_levels(tables, spec, for_nakamoto=True) if levels is None else levels
    within = F.when(rk.within_share(spec.nakamoto_pct), F.col("validators")).otherwise(0)
    return levels.groupBy("days").agg(F.sum(within).alias("nakamoto_coeff"))
