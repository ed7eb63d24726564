"""What the physical plans must and must not contain."""

import re
from contextlib import contextmanager
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stakelens import AXELAR, COSMOS, OSMOSIS
from stakelens.operators import flows
from stakelens.plans import governance as gov
from stakelens.plans import power
from stakelens.sources import fixtures
from stakelens.sources.tables import ChainTables
from tests.helpers import tables
from tests.test_properties import random_attributes, random_staking, random_votes

SF_DIR = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@contextmanager
def conf(spark, **settings):
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(entry.metric_queries()))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.metric_queries()[name](spark, SF_DIR))
    for banned in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "ArrowEval"):
        assert banned not in text


def test_the_staking_table_is_read_once_and_pruned(spark, tmp_path):
    path = str(tmp_path / "staking")
    t = tables(spark, staking=random_staking(1))
    t.staking.withColumn("unused", F.lit("x")).write.parquet(path)
    staking = spark.read.parquet(path)
    text = plan(flows.typed_flows(staking, "day", "uosmo"))
    assert text.count("FileScan") == 1
    assert "EqualTo(currency,uosmo)" in text
    assert "unused" not in text


def test_the_attribute_log_is_read_once_and_pruned(spark, tmp_path):
    path = str(tmp_path / "attributes")
    t = tables(spark, msg_attributes=random_attributes(1))
    t.msg_attributes.withColumn("unused", F.lit("x")).write.parquet(path)
    attributes = spark.read.parquet(path)
    with conf(spark, spark_sql_adaptive_enabled="false"):
        text = plan(flows.attribute_flows(attributes, COSMOS.power_legs, "month"))
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text
    assert "msg_type" in text.split("PushedFilters")[1]
    assert "unused" not in text


def test_ranking_reads_the_flows_once(spark):
    t = tables(spark, staking=random_staking(2))
    with conf(spark, spark_sql_adaptive_enabled="false"):
        text = plan(power.voting_power(t, OSMOSIS))
    assert text.count("Scan ExistingRDD") == 1
    assert "ReusedExchange" in text
    # No window sorts a whole period: those over it are cut by slice.
    windows = re.findall(r"Window .*windowspecdefinition\((.*)", text)
    assert any("slice" in w for w in windows)


def test_the_first_aggregation_of_the_legs_uses_the_whole_row(spark):
    t = tables(spark, staking=random_staking(2))
    text = plan(flows.typed_legs(t.staking, "uosmo"))
    keys = r"block_timestamp#\d+, tx_id#\d+, validator#\d+, staked"
    assert re.search(rf"hashpartitioning\({keys}", text)


READS = {
    gov.proposals_weekly: {"proposal_deposits": {"block_timestamp", "proposal_id"}},
    gov.voters_by_type: {
        "votes": {"block_timestamp", "voter", "tx_id", "proposal_id"},
    },
    gov.avg_votes_per_voter: {"votes": {"block_timestamp", "voter", "tx_id"}},
    gov.vote_options: {"votes": {"proposal_id", "vote_option", "voter", "tx_id", "vote_weight"}},
    gov.time_to_governance_avg: {
        "votes": {"block_timestamp", "voter"},
        "transactions": {"block_timestamp", "tx_from"},
    },
    gov.participation_by_debut: {"votes": {"block_timestamp", "voter", "proposal_id"}},
    gov.participants_vs_active: {"votes": {"block_timestamp", "voter", "tx_id", "proposal_id"}},
}


@pytest.mark.parametrize("metric", READS, ids=lambda m: m.__name__)
def test_governance_metrics_read_only_what_they_use(spark, tmp_path, metric):
    def stored(name, df):
        # Plans shorten long paths, so the folder is called by the first letter.
        path = str(tmp_path / name[0])
        df.withColumn("unused", F.lit(1)).write.parquet(path)
        return spark.read.parquet(path)

    found = tables(
        spark,
        votes=random_votes(1),
        proposal_deposits=[(v[0], v[3]) for v in random_votes(2)],
        transactions=[(v[0], v[2]) for v in random_votes(3)],
    )
    names = ("votes", "proposal_deposits", "transactions")
    stored_tables = ChainTables(**{n: stored(n, getattr(found, n)) for n in names})
    text = plan(metric(stored_tables, COSMOS))
    for name, columns in READS[metric].items():
        scans = [line for line in text.splitlines() if f"/{name[0]}]" in line]
        assert scans, text
        read = [set(re.findall(r"(\w+):", s.split("ReadSchema: struct<")[1])) for s in scans]
        assert set().union(*read) == columns


def _hot_attributes(spark):
    """One transaction with as many validators as all others together."""
    n = 20000
    ids = spark.range(2 * n)
    tx = F.when(F.col("id") < n, "hot").otherwise(F.concat(F.lit("t"), "id"))
    base = ids.select(
        F.timestamp_seconds(F.lit(1675000000)).alias("block_timestamp"),
        tx.alias("tx_id"),
        F.lit("delegate").alias("msg_type"),
        F.concat(F.lit("v"), F.col("id") % 30000).alias("validator"),
        F.col("id").alias("amount"),
    )
    named = base.select(
        "block_timestamp", "tx_id", "msg_type",
        F.lit("validator").alias("attribute_key"), F.col("validator").alias("attribute_value"),
    )
    paid = base.select(
        "block_timestamp", "tx_id", "msg_type",
        F.lit("amount").alias("attribute_key"),
        F.concat(F.col("amount") + 1, F.lit("uatom")).alias("attribute_value"),
    )
    return named.unionByName(paid), n


# Sizes at which a few thousand rows count as a skewed partition.
SMALL_SKEW = {
    "spark_sql_adaptive_autoBroadcastJoinThreshold": "-1",
    "spark_sql_autoBroadcastJoinThreshold": "-1",
    "spark_sql_adaptive_skewJoin_skewedPartitionThresholdInBytes": "1k",
    "spark_sql_adaptive_skewJoin_skewedPartitionFactor": "2",
    "spark_sql_adaptive_advisoryPartitionSizeInBytes": "16k",
    "spark_sql_adaptive_coalescePartitions_enabled": "false",
}


def test_a_hot_transaction_costs_no_pairs_and_its_partition_is_split(spark):
    attributes, n = _hot_attributes(spark)
    with conf(spark, **SMALL_SKEW):
        got = flows.attribute_flows(attributes, COSMOS.power_legs, "month")
        text = plan(got, run=True)
        by_validator = {r["validator"]: int(r["flow"]) for r in got.collect()}
    assert "skew=true" in text
    # The hot transaction gives all its validators the sum of all its amounts.
    hot_sum = n * (n + 1) // 2
    assert by_validator["v0"] == hot_sum + 30001
    assert by_validator["v19999"] == hot_sum
    assert by_validator["v25000"] == 25001


def test_validators_tied_at_one_stake_are_split(spark):
    n = 40000
    ids = spark.range(n, numPartitions=8)
    staking = ids.select(
        F.timestamp_seconds(F.lit(1675000000)).alias("block_timestamp"),
        F.col("id").cast("string").alias("tx_id"),
        F.lit("delegate").alias("action"),
        F.concat(F.lit("v"), "id").alias("validator_address"),
        F.lit(None).cast("string").alias("redelegate_source_validator_address"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") + 10).cast("decimal(38,0)")
        .alias("amount"),
        F.lit("uosmo").alias("currency"),
    )
    table = power.power_table(ChainTables(staking=staking), OSMOSIS)
    with conf(spark, **SMALL_SKEW):
        text = plan(table, run=True)
        lowest = table.filter("cum = 5e-6").agg(F.count("*"), F.min("rank"), F.max("rank"))
        assert tuple(lowest.first()) == (13334, n, n)
    assert "skew=true" in text


def test_hot_voters_are_split_by_transaction(spark):
    t = tables(spark, votes=random_votes(1))
    text = plan(gov.voters_by_type(t, COSMOS))
    assert "xxhash64(tx_id" in text


def test_the_votes_are_read_once_for_validators(spark, tmp_path):
    t = fixtures.chain_tables(spark, SF_DIR, OSMOSIS)
    path = str(tmp_path / "v")
    t.votes.write.parquet(path)
    text = plan(gov.voters_by_type(replace(t, votes=spark.read.parquet(path)), OSMOSIS))
    assert text.count("/v]") == 1


def _stages(df):
    """The plan's operators, from the last back to the scans."""
    return [line.lstrip(" :+-") for line in plan(df).splitlines()]


def test_legs_and_running_stakes_are_dealt_to_all_tasks(spark):
    t = tables(spark, staking=random_staking(2))
    found = _stages(power.nakamoto(t, OSMOSIS))
    dealt = [x for x in found if x.startswith("Exchange") and "REPARTITION_BY_NUM" in x]
    assert any("hashpartitioning(salt" in x for x in dealt)
    assert any("hashpartitioning(block_timestamp" in x for x in dealt)
    # Nothing is grouped at the scan.
    last = max(i for i, x in enumerate(found) if x.startswith("Exchange"))
    assert not any("Aggregate" in x for x in found[last:])


def test_legs_of_two_readings_are_dealt_before_they_are_grouped(spark):
    t = tables(spark, staking=random_staking(2))
    found = _stages(flows.typed_flows_both(t.staking, "day", "uaxl", "uosmo"))
    last = max(i for i, x in enumerate(found) if x.startswith("Exchange"))
    assert "REPARTITION_BY_NUM" in found[last]
    assert not any("Aggregate" in x for x in found[last:])


@pytest.mark.parametrize("spec", [COSMOS, OSMOSIS], ids=lambda s: s.name)
def test_votes_are_dealt_by_voter_and_transaction_before_they_are_counted(spark, spec):
    found = _stages(gov.voters_by_type(fixtures.chain_tables(spark, SF_DIR, spec), spec))
    dealt = [x for x in found if x.startswith("Exchange") and "REPARTITION_BY_NUM" in x]
    assert any(re.search(r"hashpartitioning\(date#\d+, type#\d+, voter#\d+, tx_id", x) for x in dealt)


@pytest.mark.parametrize(
    "metric", [power.power_table, power.voting_power, power.power_share,
               power.power_share_normalized, power.nakamoto], ids=lambda m: m.__name__
)
@pytest.mark.parametrize("spec", [AXELAR, OSMOSIS], ids=lambda s: s.name)
def test_legs_running_stakes_and_levels_are_dealt_to_all_tasks(spark, metric, spec):
    """Adaptive execution leaves these three shuffles alone, so their tasks stay small."""
    found = _stages(metric(fixtures.chain_tables(spark, SF_DIR, spec, "staking"), spec))
    dealt = [x for x in found if x.startswith("Exchange") and "REPARTITION_BY_NUM" in x]
    for first in (r"block_timestamp#\d+, tx_id#\d+", r"salt#\d+L?,", r"days#\d+, slice#\d+"):
        assert any(re.search(rf"hashpartitioning\({first}", x) for x in dealt), first
    assert not any("REPARTITION_BY_COL" in x for x in found)
