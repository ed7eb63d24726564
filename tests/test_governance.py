"""Participation metrics on rows worked out by hand."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stakelens import COSMOS, OSMOSIS, TERRA
from stakelens.functions import columns as C
from stakelens.operators import debut
from stakelens.plans import governance as gov
from tests.helpers import rows, tables, ts

START = ts("2023-01-02T12:00:00")
D = START.date()


def vote(voter, days=0, tx=None, proposal=1, option=1, weight=None):
    tx = tx or f"{voter}-{days}-{proposal}"
    return (START + timedelta(days=days), tx, voter, proposal, option, weight)


def test_newcomer_cutoff(spark):
    labels = [("v", '[{"account_address": "acc"}]'), ("w", None), ("x", "[]")]
    staking = [(START, "t", "delegate", v, None, 1, "uosmo") for v in "vwx"] + [
        (START - timedelta(days=90), "u", "delegate", "v", None, 1, "uion")
    ]
    votes = [vote("acc", 29), vote("acc", 30), vote("acc", -1), vote("other", 0)]
    t = tables(spark, votes=votes, labels=labels, staking=staking)
    assert rows(gov.voters_by_type(t, OSMOSIS)) == [
        (D + timedelta(days=-1), "New validator", 1, 1),
        (D + timedelta(days=29), "New validator", 1, 1),
        (D + timedelta(days=30), "Old validator", 1, 1),
    ]


def test_voters_count_once_per_day_and_shared_transactions_once(spark):
    votes = [
        vote("a", tx="t1", proposal=1),
        vote("a", tx="t1", proposal=2),
        vote("b", tx="t1"),
        vote("b", tx="t2"),
        vote(None, tx="t3"),
    ]
    t = tables(spark, votes=votes)
    assert rows(gov.voters_by_type(t, COSMOS)) == [(D, "New delegator", 2, 2)]


def test_average_is_over_voter_days(spark):
    votes = [vote("a", 0, tx="1"), vote("a", 0, tx="2"), vote("a", 1, tx="3"), vote("b", 1)]
    t = tables(spark, votes=votes)
    assert rows(gov.avg_votes_per_voter(t, COSMOS)) == [
        (D, "New delegator", pytest.approx(4 / 3, abs=1e-9))
    ]


def test_option_codes_and_missing_weights(spark):
    options = [1, 2, 3, 4, 0, None]
    votes = [vote(f"v{i}", option=o, weight=0.5 if i else None) for i, o in enumerate(options)]
    got = rows(gov.vote_options(tables(spark, votes=votes), OSMOSIS))
    assert sorted(got) == [
        (1, "Abstain", 1, 1, 0.5),
        (1, "No", 1, 1, 0.5),
        (1, "No with veto", 3, 3, 1.5),
        (1, "Yes", 1, 1, 0.0),
    ]


def test_days_are_counted_by_midnights(spark):
    df = spark.createDataFrame(
        [(ts("2023-01-02T23:59:59"), ts("2023-01-03T00:00:01"))], "a timestamp, b timestamp"
    )
    got = df.select(C.days_between("a", "b").alias("f"), C.days_between("b", "a").alias("r"))
    assert rows(got) == [(1, -1)]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame(
        [(ts("2023-01-01T23:00:00"),), (ts("2023-01-02T01:00:00"),)], "t timestamp"
    )
    got = rows(df.select(C.period("t", "week").alias("w"), C.period("t", "month").alias("m")))
    assert got == [
        (date(2022, 12, 26), date(2023, 1, 1)),
        (date(2023, 1, 2), date(2023, 1, 1)),
    ]


def test_proposals_by_week_and_source(spark):
    deposits = [(START + timedelta(days=d), p) for d, p in [(0, 1), (1, 2), (1, 1), (7, 3)]]
    t = tables(spark, proposal_deposits=deposits, votes=[vote("a", 14, proposal=9)])
    assert rows(gov.proposals_weekly(t, COSMOS)) == [
        (D, 2, 2),
        (D + timedelta(days=7), 1, 3),
    ]
    assert rows(gov.proposals_weekly(t, TERRA)) == [(D + timedelta(days=14), 1, 1)]


def test_time_to_governance_keeps_negative_gaps(spark):
    transactions = [(START, "a"), (START + timedelta(days=5), "a"), (START, "b"), (START, "c")]
    votes = [vote("a", 4), vote("a", 1), vote("b", -3), vote("nobody"), vote(None)]
    t = tables(spark, wallet="tx_sender", votes=votes, transactions=transactions)
    assert rows(gov.time_to_governance_avg(t, TERRA)) == [(-1.0,)]
    assert rows(gov.time_to_governance_daily(t, TERRA)) == [
        (D + timedelta(days=-3), -3.0, 1),
        (D + timedelta(days=1), 1.0, 1),
    ]


def test_participation_by_debut_ignores_the_null_voter_in_counts_only(spark):
    votes = [vote("a", 0, proposal=1), vote("a", 3, proposal=2), vote("b"), vote(None)]
    t = tables(spark, votes=votes)
    assert rows(gov.participation_by_debut(t, OSMOSIS)) == [
        (D, 2, pytest.approx(4 / 3, abs=1e-9))
    ]


def test_active_users_are_those_of_earlier_days(spark):
    votes = [
        vote("a", 0, proposal=1),
        vote("b", 2, proposal=2),
        vote("a", 2, proposal=2),
        vote("c", 2, proposal=1),
        vote("a", 9, proposal=3),
        vote("b", 9, proposal=3, tx="one more"),
    ]
    t = tables(spark, votes=votes)
    assert rows(gov.participants_vs_active(t, OSMOSIS)) == [
        (D + timedelta(days=2), 2, 2, 2, 1),
        (D + timedelta(days=9), 3, 2, 2, 3),
    ]


def test_a_voter_without_a_timestamp_is_active_on_no_day(spark):
    votes = spark.createDataFrame(
        [("a", "2023-01-01"), ("b", "2023-01-05"), ("c", None)], "voter string, day string"
    ).select("voter", F.to_timestamp("day").alias("block_timestamp"))
    days = {str(r.date): r.entities for r in debut.appeared_before(votes, "voter").collect()}
    assert days["2023-01-02"] == 1


def test_an_early_null_voter_keeps_a_later_proposal(spark):
    t = tables(spark, votes=[vote(None, 0, proposal=1), vote("a", 1, proposal=2)])
    assert rows(gov.participants_vs_active(t, OSMOSIS)) == [
        (D + timedelta(days=1), 2, 1, 1, 0)
    ]


def test_account_address_from_variant(spark):
    labels = spark.sql(
        """SELECT * FROM VALUES ('a', parse_json('[{"account_address":"x"}]')),
           ('b', parse_json('{}')) AS t(address, raw_metadata)"""
    )
    got = labels.select("address", C.account_address(labels).alias("account"))
    assert rows(got) == [("a", "x"), ("b", None)]
