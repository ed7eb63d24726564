"""Stake flows and concentration on rows worked out by hand."""

import random
from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stakelens import AXELAR, AXELAR_AS_PUBLISHED, COSMOS, OSMOSIS, TERRA
from stakelens.functions import columns as C
from stakelens.operators import flows, ranking
from stakelens.plans import power
from tests.helpers import rows, tables, ts

DAY = ts("2023-01-02T10:00:00")
D = date(2023, 1, 2)


def delegate(validator, amount, tx="t", when=DAY, action="delegate", source=None, denom="uosmo"):
    return (when, tx, action, validator, source, amount, denom)


def staked(spark, *actions, spec=OSMOSIS):
    return tables(spark, staking=list(actions))


def attributes(*messages, when=DAY):
    return [(when, *m) for m in messages]


def test_ties_share_the_lowest_place(spark):
    t = staked(
        spark,
        delegate("a", 10, "1"),
        delegate("b", 10, "2"),
        delegate("c", 5, "3"),
    )
    got = rows(power.power_table(t, OSMOSIS), "validator", "rank", "run")
    assert got == [("a", 2, 20e-6), ("b", 2, 20e-6), ("c", 3, 25e-6)]


def test_band_edges(spark):
    ranks = spark.range(9, 53).select(C.rank_band("id", "last").alias("b"), "id")
    bands = dict((r["id"], r["b"]) for r in ranks.collect())
    assert bands[10] == C.FIRST_BAND
    assert bands[11] == bands[50] == C.MIDDLE_BAND
    assert bands[51] == "last"


def test_nobody_within_the_threshold(spark):
    spec = replace(OSMOSIS, power_pct=33, nakamoto_pct=33)
    t = staked(spark, delegate("a", 90, "1"), delegate("b", 10, "2"))
    assert rows(power.voting_power(t, spec)) == [(D, None)]
    assert rows(power.nakamoto(t, spec)) == [(D, 0)]


def test_threshold_reached_exactly_counts(spark):
    spec = replace(OSMOSIS, power_pct=60, nakamoto_pct=60)
    t = staked(spark, delegate("a", 6000000, "1"), delegate("b", 4000000, "2"))
    assert rows(power.voting_power(t, spec)) == [(D, 6.0)]
    assert rows(power.nakamoto(t, spec)) == [(D, 1)]


def test_redelegation_moves_stake(spark):
    t = staked(spark, delegate("B", 5, action="redelegate", source="A"))
    assert rows(power.stake_flows(t, OSMOSIS), "validator", "flow") == [("A", -5), ("B", 5)]
    assert rows(power.power_table(t, OSMOSIS), "total") == [(0.0,), (0.0,)]


def test_zero_total_has_no_share(spark):
    t = staked(spark, delegate("B", 5, action="redelegate", source="A"))
    assert rows(power.power_share_normalized(t, OSMOSIS)) == [(D, C.FIRST_BAND, None, None)]


def test_identical_legs_of_a_transaction_merge(spark):
    t = staked(spark, delegate("a", 7), delegate("a", 7), delegate("a", 7, tx="other"))
    assert rows(power.stake_flows(t, OSMOSIS), "flow") == [(14,)]


def test_a_redelegation_leg_merges_with_an_equal_delegation(spark):
    t = staked(
        spark, delegate("a", 7), delegate("a", 7, action="redelegate", source="b")
    )
    assert rows(power.stake_flows(t, OSMOSIS), "validator", "flow") == [("a", 7), ("b", -7)]


def test_undelegation_null_amount_and_other_denoms(spark):
    t = staked(
        spark,
        delegate("a", 9, "1"),
        delegate("a", 4, "2", action="undelegate"),
        delegate("a", None, "3"),
        delegate("a", 100, "4", denom="uion"),
        delegate("a", 1, "5", action=None),
    )
    assert rows(power.stake_flows(t, OSMOSIS), "flow") == [(6,)]


def test_inbound_redelegation_of_the_published_axelar_query(spark):
    t = staked(
        spark,
        delegate("a", 100, "1", denom="uaxl"),
        delegate("b", 30, "2", action="redelegate", source="a", denom="uaxl"),
    )
    own = rows(power.stake_flows(t, AXELAR, for_nakamoto=True), "validator", "flow")
    published = rows(
        power.stake_flows(t, AXELAR_AS_PUBLISHED, for_nakamoto=True), "validator", "flow"
    )
    assert own == [("a", 70), ("b", 30)]
    assert published == [("a", 70)]
    assert rows(power.stake_flows(t, AXELAR_AS_PUBLISHED), "validator", "flow") == own


def test_a_period_ranks_only_validators_that_moved(spark):
    later = ts("2023-01-03T00:00:00")
    t = staked(spark, delegate("a", 10, "1"), delegate("b", 5, "2", when=later))
    got = rows(power.power_table(t, OSMOSIS), "days", "validator", "rank", "total")
    assert got == [(D, "a", 1, 10e-6), (date(2023, 1, 3), "b", 1, 15e-6)]


def test_positive_only_drops_from_ranking_and_totals(spark):
    t = staked(
        spark, delegate("a", 10, "1"), delegate("b", 4, "2", action="undelegate")
    )
    kept = rows(power.power_table(t, replace(OSMOSIS, positive_only=True)), "validator", "total")
    assert kept == [("a", 10e-6)]
    everyone = rows(power.power_table(t, OSMOSIS), "validator", "total")
    assert everyone == [("a", 6e-6), ("b", 6e-6)]


def test_every_amount_applies_to_every_validator(spark):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "delegate", "amount", "1uatom"),
            ("t", "delegate", "amount", "2uatom"),
            ("t", "delegate", "validator", "a"),
            ("t", "delegate", "validator", "b"),
        ),
    )
    legs = flows.attribute_legs(t.msg_attributes, COSMOS.power_legs, "month")
    assert rows(legs, "validator", "entries", "staked") == [("a", 2, 3), ("b", 2, 3)]


def test_equal_amount_and_shares_merge(spark):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "delegate", "amount", "5uatom"),
            ("t", "delegate", "new_shares", "5.000000000000000000uatom"),
            ("t", "delegate", "new_shares", "5.000000000000000000ibc/X"),
            ("t", "delegate", "validator", "a"),
        ),
    )
    assert rows(power.stake_flows(t, COSMOS), "flow") == [(10,)]
    # The Nakamoto coefficient of this network reads only the amounts.
    assert rows(power.stake_flows(t, COSMOS, for_nakamoto=True), "flow") == [(5,)]


def test_unbonding_and_redelegating_away_the_same_amount_merge(spark):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "unbond", "amount", "5uatom"),
            ("t", "unbond", "validator", "a"),
            ("t", "redelegate", "amount", "5uatom"),
            ("t", "redelegate", "source_validator", "a"),
            ("t", "redelegate", "destination_validator", "b"),
        ),
    )
    assert rows(power.stake_flows(t, TERRA), "validator", "flow") == [("a", -5), ("b", 5)]


@pytest.mark.parametrize(
    ("value", "micro"),
    [
        ("123uatom,45ibc/X", None),
        ("", None),
        (None, None),
        ("7", None),
        ("100uion", None),
        ("1000000.5uatom", 1000001),
        ("12ibc/ABC", 12),
        ("999999999999999uatom", 999999999999999),
        ("1000000000000000uatom", None),
    ],
)
def test_amounts(spark, value, micro):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "delegate", "amount", value), ("t", "delegate", "validator", "a")
        ),
    )
    assert rows(power.stake_flows(t, TERRA), "flow") == ([] if micro is None else [(micro,)])


def test_amounts_beyond_the_bound_of_the_negative_legs(spark):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "unbond", "amount", "1000000000000000uatom"),
            ("t", "unbond", "amount", "3uatom"),
            ("t", "unbond", "validator", "a"),
        ),
    )
    assert rows(power.stake_flows(t, TERRA), "flow") == [(-3,)]


CROWD = [-(10**30), -5, -5, 0, 0, 1, 2, 999, 10**18, 10**30, *range(10**6, 10**6 + 900, 3)]


def test_levels_of_negative_zero_huge_and_crowded_stakes(spark):
    positions = spark.createDataFrame(
        [(D, str(i), Decimal(s)) for i, s in enumerate(CROWD)],
        "days date, validator string, cum decimal(38,0)",
    ).withColumn("flow", F.col("cum"))
    levels = ranking.stake_levels(positions).collect()
    got = {int(r["cum"]): (r["rank"], int(r["run"])) for r in levels}
    want = {
        s: (sum(o >= s for o in CROWD), sum(o for o in CROWD if o >= s)) for s in CROWD
    }
    assert got == want


def test_slices_never_fall_as_stakes_rise(spark):
    rng = random.Random(1)
    stakes = sorted(
        sign * rng.randrange(10**digits) + step
        for sign in (-1, 1)
        for digits in range(1, 37)
        for step in (0, 1)
        for _ in range(20)
    )
    df = spark.createDataFrame([(Decimal(s),) for s in stakes], "cum decimal(38,0)")
    slices = [r[1] for r in df.select("cum", ranking._slice("cum")).collect()]
    assert slices == sorted(slices)
    assert len(set(slices)) > 1000


def test_huge_amounts_below_zero_add_up_beside_small_ones(spark):
    t = tables(
        spark,
        msg_attributes=attributes(
            ("t", "unbond", "amount", "-1000000000000000uatom"),
            ("t", "unbond", "amount", "-90000000000000000000000000000001uatom"),
            ("t", "unbond", "amount", "-999999999999999uatom"),
            ("t", "unbond", "amount", "7uatom"),
            ("t", "unbond", "validator", "a"),
            ("u", "unbond", "amount", "-2000000000000000uatom"),
            ("u", "unbond", "validator", "b"),
        ),
    )
    huge = 10**15 + 90_000_000_000_000_000_000_000_000_000_001 + 999_999_999_999_999 - 7
    want = [("a", huge), ("b", 2 * 10**15)]
    assert rows(power.stake_flows(t, TERRA), "validator", "flow") == want
    legs = flows.attribute_legs(t.msg_attributes, TERRA.power_legs, "month")
    added = legs.groupBy("validator").agg(F.sum("staked").alias("staked"))
    assert rows(added, "validator", "staked") == want
    both = flows.attribute_flows_both(
        t.msg_attributes, TERRA.power_legs, TERRA.nakamoto_legs, "month"
    )
    assert rows(both, "validator", "flow", "flow_nakamoto") == [(v, n, n) for v, n in want]


def test_entries_are_grouped_and_added_up_as_numbers(spark):
    log = tables(spark, msg_attributes=attributes(("t", "delegate", "amount", "1uatom")))
    entries = flows.attribute_entries(log.msg_attributes, COSMOS.power_legs)
    assert dict(entries.dtypes)["size"] == "bigint"
    many = [("t", "delegate", "amount", f"{10**15 - 1 - i}uatom") for i in range(9300)]
    log = tables(spark, msg_attributes=attributes(("t", "delegate", "validator", "a"), *many))
    whole = sum(10**15 - 1 - i for i in range(9300))
    assert whole > 2**63
    assert rows(power.stake_flows(log, COSMOS), "flow") == [(whole,)]


def test_denominations_are_what_the_patterns_find(spark):
    values = ["5uatom", "5.4ibc/A", "9", "", None, "12uionu", "3atom", "7u\nx", "7\ni", "é8ué\rx"]
    values += ["1 u2 i", "4i\u0085u", "ui\nu", "u", "i", "6U", "\nu\n"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    by_pattern = [F.regexp_substr("value", F.lit(p)) for p in ("i.*", "u.*")]
    for row in df.select("value", C.denomination("value"), F.coalesce(*by_pattern)).collect():
        assert row[1] == row[2], row
    text = df.select(C.denomination("value"))._jdf.queryExecution().toString()
    assert "regexp" not in text
