"""Random small inputs against plain loops, and facts that must always hold."""

import random
from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from stakelens import COSMOS, OSMOSIS, TERRA
from stakelens.operators import debut, flows
from stakelens.plans import governance as gov
from stakelens.plans import power
from tests import brute
from tests.helpers import rows, tables, ts

START = ts("2023-01-30T08:00:00")


def when(rng, days):
    return START + timedelta(days=rng.randrange(days))


def random_staking(seed, n=400):
    rng = random.Random(seed)
    return [
        (
            when(rng, 6),
            f"t{rng.randrange(60)}",
            rng.choice(["delegate", "undelegate", "redelegate", None]),
            f"v{rng.randrange(12)}",
            rng.choice([None, None, f"v{rng.randrange(12)}"]),
            rng.choice([None, 0, 1, 2, 5, 5, 5, 10**20]),
            rng.choice(["uosmo", "uosmo", "uion"]),
        )
        for _ in range(n)
    ]


def random_attributes(seed, n=400):
    rng = random.Random(seed)
    values = ["5uatom", "5uatom", "7uatom", "-3uatom", "3uatom", "5.4ibc/A", "xuatom", "9", None]
    out = []
    for _ in range(n):
        message = rng.choice(["unbond", "delegate", "redelegate", "vote"])
        key = rng.choice(
            ["amount", "new_shares", "validator", "source_validator", "destination_validator"]
        )
        value = rng.choice(values) if key in ("amount", "new_shares") else f"v{rng.randrange(5)}"
        out.append((when(rng, 70), f"t{rng.randrange(25)}", message, key, value))
    return out


def _month(t):
    return t.date().replace(day=1)


def _levels(table):
    found = {}
    for days, _, cum, rank, run, total in table:
        n = found.get((days, cum), (0,))[0]
        found[days, cum] = (n + 1, rank, run, total)
    return found


def _got_levels(df):
    return {
        (r["days"], int(r["cum"])): (r["validators"], r["rank"], int(r["run"]), int(r["total"]))
        for r in df.collect()
    }


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("positive_only", [False, True])
def test_typed_levels_match_loops(spark, seed, positive_only):
    actions = random_staking(seed)
    spec = replace(OSMOSIS, positive_only=positive_only)
    legs = [(t, v, s) for t, _, v, s in brute.legs_typed(actions, "uosmo")]
    want = _levels(brute.power(legs, lambda t: t.date(), positive_only))
    assert _got_levels(power.power_levels(tables(spark, staking=actions), spec)) == want


@pytest.mark.parametrize("seed", [3, 4])
@pytest.mark.parametrize("for_nakamoto", [False, True])
def test_attribute_levels_match_loops(spark, seed, for_nakamoto):
    messages = random_attributes(seed)
    spec_legs = COSMOS.nakamoto_legs if for_nakamoto else COSMOS.power_legs
    legs = [(t, v, s) for t, _, v, _, s in brute.legs_attributes(messages, spec_legs)]
    want = _levels(brute.power(legs, _month, True))
    t = tables(spark, msg_attributes=messages)
    assert _got_levels(power.power_levels(t, COSMOS, for_nakamoto)) == want


def third_to(rows, **hot):
    """Every third row gets the given values, by position in the row."""
    at = {int(k[1:]): v for k, v in hot.items()}
    return [
        tuple(at.get(j, v) if i % 3 == 0 else v for j, v in enumerate(row))
        for i, row in enumerate(rows)
    ]


def test_a_third_of_the_actions_in_one_transaction_and_validator(spark):
    actions = third_to(random_staking(12), _1="hot", _3="v0")
    legs = [(t, v, s) for t, _, v, s in brute.legs_typed(actions, "uosmo")]
    want = _levels(brute.power(legs, lambda t: t.date(), False))
    assert _got_levels(power.power_levels(tables(spark, staking=actions), OSMOSIS)) == want


def test_a_third_of_the_messages_in_one_transaction(spark):
    messages = third_to(random_attributes(13), _1="hot")
    legs = [(t, v, s) for t, _, v, _, s in brute.legs_attributes(messages, TERRA.power_legs)]
    want = _levels(brute.power(legs, _month, True))
    t = tables(spark, msg_attributes=messages)
    assert _got_levels(power.power_levels(t, TERRA)) == want


def test_a_third_of_the_actions_on_one_day(spark):
    actions = third_to(random_staking(14), _0=START)
    legs = [(t, v, s) for t, _, v, s in brute.legs_typed(actions, "uosmo")]
    want = _levels(brute.power(legs, lambda t: t.date(), False))
    assert _got_levels(power.power_levels(tables(spark, staking=actions), OSMOSIS)) == want


def test_redelegations_add_up_to_nothing(spark):
    actions = [(*a[:2], "redelegate", a[3], "src", *a[5:]) for a in random_staking(5)]
    legs = flows.typed_legs(tables(spark, staking=actions).staking, "uosmo")
    # Per row the legs cancel; merging equal ones may drop one of a pair, so compare
    # transactions with a single action.
    alone = [t for t in {a[1] for a in actions} if sum(a[1] == t for a in actions) == 1]
    sums = legs.filter(F.col("tx_id").isin(alone)).groupBy("tx_id").agg(F.sum("staked"))
    assert all(total == 0 for _, total in rows(sums))


def test_nakamoto_never_falls_with_the_threshold(spark):
    # Stakes that are never negative, so that prefix sums never fall either.
    actions = [a for a in random_staking(6) if a[2] != "undelegate" and a[4] is None]
    t = tables(spark, staking=actions)
    low = dict(rows(power.nakamoto(t, replace(OSMOSIS, nakamoto_pct=30))))
    high = dict(rows(power.nakamoto(t, replace(OSMOSIS, nakamoto_pct=60))))
    assert low.keys() == high.keys()
    assert all(low[d] <= high[d] for d in low)


def test_normalised_shares_add_up_to_one(spark):
    t = tables(spark, msg_attributes=random_attributes(7))
    sums = power.power_share_normalized(t, TERRA).groupBy("days").agg(
        F.sum("power_share_normalized")
    )
    assert all(abs(total - 1) < 1e-8 for _, total in rows(sums))


def test_row_order_and_partitions_do_not_matter(spark):
    actions = random_staking(8)
    t = tables(spark, staking=actions)
    shuffled = tables(spark, staking=random.Random(0).sample(actions, len(actions)))
    shuffled = replace(shuffled, staking=shuffled.staking.repartition(13))
    assert rows(power.power_table(t, OSMOSIS)) == rows(power.power_table(shuffled, OSMOSIS))


def random_votes(seed, n=500):
    rng = random.Random(seed)
    return [
        (
            when(rng, 80),
            f"t{rng.randrange(300)}",
            rng.choice([None, *[f"u{i}" for i in range(40)]]),
            rng.randrange(12),
            rng.choice([None, 1, 2, 3, 4]),
            rng.choice([None, 0.25, 1.0]),
        )
        for _ in range(n)
    ]


def test_appeared_before_equals_the_inequality_join(spark):
    votes = tables(spark, votes=random_votes(9)).votes
    votes.createOrReplaceTempView("votes")
    naive = spark.sql(
        """
        SELECT x.proposal_id, count(DISTINCT y.voter) AS active
        FROM (SELECT proposal_id, to_date(min(block_timestamp)) AS d FROM votes GROUP BY 1) x,
             (SELECT voter, to_date(min(block_timestamp)) AS d FROM votes GROUP BY 1) y
        WHERE y.d < x.d GROUP BY 1"""
    )
    got = gov.participants_vs_active(tables(spark, votes=random_votes(9)), OSMOSIS)
    assert rows(got, "proposal_id", "active_users") == rows(naive)
    days = rows(debut.appeared_before(votes, "voter"), "date")
    assert len(days) == len(set(days))


def test_splitting_hot_voters_changes_nothing(spark):
    hot = [v[:2] + ("whale",) + v[3:] for v in random_votes(11)]
    t = tables(spark, votes=random_votes(10) + hot)
    whole = rows(gov.voters_by_type(t, COSMOS))
    assert rows(gov.voters_by_type(t, COSMOS, parts=20)) == whole
    assert whole
