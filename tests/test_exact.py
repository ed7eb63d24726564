"""Exact sums, the presence filter, hot voters and the stored layout."""

import math
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stakelens import COSMOS, OSMOSIS, TERRA
from stakelens.operators import exact, flows, presence
from stakelens.plans import governance as gov
from stakelens.plans import power
from stakelens.sources import fixtures, layout
from stakelens.sources.tables import ChainTables
from tests.helpers import rows, tables, ts

SF_DIR = "/root/testdata/sf0.001"


def _summed(spark, values, times=None, parts=3):
    data = [(1, v, t) for v, t in zip(values, times or [1] * len(values), strict=True)]
    df = spark.createDataFrame(data, "k int, x double, t bigint").repartition(parts)
    col = None if times is None else F.col("t")
    found = exact.exact_sum(df, ["k"], F.col("x"), "s", col).collect()
    return found[0]["s"]


@pytest.mark.parametrize(
    "values",
    [
        [1e17], [1e17, 1.0, -1e17], [0.1] * 10, [1e300, 1.0, -1e300], [5e-324, 5e-324],
        [1.7976931348623157e308], [2.0**k for k in range(-1074, 1000, 37)], [-0.0], [0.0, None],
        [-1.0000000000000002], [2.0**32, 2.0**32 - 2.0**-20], [1e-310, -3e-310, 1e308],
        [-(2.0**-53), 1.0],
    ],
)
def test_sums_of_doubles_are_exact(spark, values):
    assert _summed(spark, values) == math.fsum(v for v in values if v is not None)


def test_sums_of_doubles_that_are_not_numbers(spark):
    inf = float("inf")
    assert math.isnan(_summed(spark, [1.0, float("nan")]))
    assert math.isnan(_summed(spark, [inf, -inf, 1.0]))
    assert _summed(spark, [inf, 1.0]) == inf
    assert _summed(spark, [None, None]) == 0.0
    assert _summed(spark, [0.25, 1e17], [4, 3]) == 3e17 + 1


def test_the_order_of_rows_changes_no_bit(spark):
    pick = random.Random(4)
    values = [pick.uniform(-1, 1) * 10.0 ** pick.randint(-20, 20) for _ in range(3000)]
    sums = set()
    for parts in (1, 4, 13):
        pick.shuffle(values)
        sums.add(_summed(spark, values, parts=parts).hex())
    assert len(sums) == 1
    assert float.fromhex(sums.pop()) == pytest.approx(math.fsum(values), rel=1e-15)


def test_weights_beyond_decimals_and_not_numbers(spark):
    day = ts("2023-01-01")
    votes = [(day, f"t{i}", f"v{i}", 1, 1, w) for i, w in enumerate([1e17, 0.5, None])]
    votes += [(day, "t9", "v9", 2, 3, float("nan")), (day, "t8", "v8", None, None, 2.0)]
    t = tables(spark, votes=votes)
    for source in (t.votes, gov.distinct_votes(t.votes)):
        got = {r["proposal_id"]: r for r in gov.vote_options(ChainTables(votes=source), OSMOSIS).collect()}
        assert got[1]["weight"] == 1e17 and got[1]["voters"] == 3
        assert math.isnan(got[2]["weight"])
        assert (got[None]["vote"], got[None]["weight"]) == ("No with veto", 2.0)


def test_a_filter_of_keys_loses_none_and_stops_most_others(spark):
    keys = spark.createDataFrame([(f"w{i}",) for i in range(500)] + [(None,)], "key string")
    df = spark.createDataFrame(
        [(f"{c}{i}", i) for c in "wx" for i in range(2000)] + [(None, 1)], "wallet string, n int"
    )
    kept = {r["wallet"] for r in presence.probably_in(df, "wallet", keys, "key").collect()}
    assert {f"w{i}" for i in range(500)} <= kept
    assert len(kept) <= 510
    none = presence.probably_in(df, "wallet", keys.filter("key IS NULL"), "key")
    assert none.count() == 0


def test_wallets_without_votes_do_not_reach_the_shuffle(spark):
    t = fixtures.chain_tables(spark, SF_DIR, TERRA)
    df = gov.time_to_governance(t, TERRA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The transactions pass the filter's joins before their first exchange.
    branch = plan[plan.index("tx_sender") :] if "tx_sender" in plan else plan
    assert plan.count("getbit") >= 2
    assert "BroadcastHashJoin [bucket_1" in plan.replace("cast(", "") and branch


@pytest.fixture
def database(spark, tmp_path):
    spark.sql(f"CREATE DATABASE laid_out LOCATION '{tmp_path}/db'")
    yield "laid_out"
    spark.sql("DROP DATABASE laid_out CASCADE")


def test_the_bucketed_log_needs_no_shuffle_by_transaction(spark, database):
    given = fixtures.chain_tables(spark, SF_DIR, COSMOS)
    layout.store(given, COSMOS, database, buckets=8)
    held = layout.read(spark, COSMOS, database)
    want = power.stake_flows(given, COSMOS)
    got = power.stake_flows(held, COSMOS)
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tx_id" not in plan
    assert re.search(r"hashpartitioning\(days", plan)
    assert "hashpartitioning(tx_id" in want._jdf.queryExecution().executedPlan().toString()


def test_one_month_of_the_log_is_read_by_its_partition(spark, database):
    given = fixtures.chain_tables(spark, SF_DIR, COSMOS)
    layout.store(given, COSMOS, database, buckets=4)
    held = layout.read(spark, COSMOS, database)
    month = datetime(1996, 5, 1).date()
    one = layout.of_months(held.msg_attributes, [month])
    got = flows.attribute_flows(one, COSMOS.power_legs, "month")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block_month", plan)
    assert "hashpartitioning(tx_id" not in plan
    want = flows.attribute_flows(
        layout.of_months(given.msg_attributes, [month]), COSMOS.power_legs, "month"
    )
    assert rows(got) == rows(want) != []
