from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from stakelens import AXELAR_AS_PUBLISHED, COSMOS, OSMOSIS, TERRA
from stakelens.plans import gold, governance, power
from stakelens.sources import fixtures
from stakelens.sources.tables import TABLE_NAMES, ChainTables, required_tables
from tests.helpers import rows

SF_DIR = "/root/testdata/sf0.001"


def stored(spark, root, spec):
    """The fixture tables as parquet folders laid out per chain, read back."""
    found = fixtures.chain_tables(spark, SF_DIR, spec)
    for name in required_tables(spec):
        df = getattr(found, name)
        df = df.withColumn("unused", F.lit(1))
        if "block_timestamp" in df.columns:
            df = df.withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp"))
        if "proposal_id" in df.columns:
            df = df.withColumn("proposal_id", F.col("proposal_id").cast("bigint"))
        df.write.parquet(f"{root}/{spec.name}/core/{TABLE_NAMES[name]}")
    return ChainTables.from_parquet(spark, str(root), spec)


@pytest.mark.parametrize(
    "spec", [OSMOSIS, COSMOS, TERRA, AXELAR_AS_PUBLISHED], ids=lambda spec: spec.label
)
def test_gold_tables_hold_the_metrics(spark, tmp_path, monkeypatch, spec):
    t = stored(spark, tmp_path / "in", spec)
    reads, write = Counter(), DataFrameWriter.parquet

    def counted(self, path, *args, **kwargs):
        reads.update({name: _scans(self._df, TABLE_NAMES[name]) for name in required_tables(spec)})
        return write(self, path, *args, **kwargs)

    with monkeypatch.context() as patched:
        patched.setattr(DataFrameWriter, "parquet", counted)
        paths = gold.write_gold(t, spec, str(tmp_path / "out"))
    # The validators' debuts are a second read of the staking table, which they alone need.
    most = {"staking": 2 if spec is OSMOSIS else 1}
    assert all(0 < reads[name] <= most.get(name, 1) for name in required_tables(spec)), reads
    want = {
        "voting_power": power.voting_power,
        "power_share": power.power_share_normalized,
        "nakamoto": power.nakamoto,
        "time_to_governance_avg": governance.time_to_governance_avg,
        "time_to_governance_daily": governance.time_to_governance_daily,
        **gold.GOVERNANCE,
    }
    assert set(want) <= set(paths)
    assert ("stake_levels_nakamoto" in paths) == (spec in (COSMOS, AXELAR_AS_PUBLISHED))
    for name, metric in want.items():
        got = rows(spark.read.parquet(paths[name]))
        assert got == rows(metric(t, spec)), name
        assert got, name


def test_gold_tables_are_sorted(spark, tmp_path):
    t = stored(spark, tmp_path / "in", OSMOSIS)
    metrics = {"power_share": power.power_share, **gold.GOVERNANCE}
    for name in ("power_share", "voters_by_type"):
        metric = metrics[name]
        order = gold.SHOWN_BY[name]
        shown = [tuple(r) for r in gold.shown(name, metric(t, OSMOSIS)).select(*order).collect()]
        assert shown == sorted(shown)
        assert len(shown) > 100


def test_a_run_replaces_the_last_unless_it_fails(spark, tmp_path):
    t = stored(spark, tmp_path / "in", TERRA)
    out = str(tmp_path / "out")
    first = gold.write_gold(t, TERRA, out)
    assert gold.current(spark, TERRA, out) == first
    broken = t.votes.withColumn("vote_option", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        gold.write_gold(replace(t, votes=broken), TERRA, out)
    assert gold.current(spark, TERRA, out) == first
    assert not spark.read.parquet(first["vote_options"]).isEmpty()
    again = gold.write_gold(replace(t, votes=t.votes.filter("proposal_id > 100")), TERRA, out)
    assert gold.current(spark, TERRA, out) == again
    got = spark.read.parquet(again["vote_options"])
    assert got.filter("proposal_id <= 100").isEmpty() and not got.isEmpty()


def _scans(df, name):
    """Reads of a table in the plan that would run, those of a reused exchange left out."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        plan = df._jdf.queryExecution().executedPlan()
        return sum(f"/{name}" in str(leaf) for leaf in _leaves(plan))
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")


def _leaves(plan):
    if plan.nodeName().startswith("Scan parquet"):
        return [plan.relation().location().rootPaths().mkString(",")]
    if plan.nodeName().startswith("ReusedExchange"):
        return []
    children = plan.children()
    return [leaf for i in range(children.size()) for leaf in _leaves(children.apply(i))]


@pytest.mark.parametrize("kind, fails", [("timestamp", True), ("timestamp_ntz", False)])
def test_days_of_another_zone_are_refused(spark, kind, fails):
    votes = spark.sql(f"SELECT CAST('2023-01-01' AS {kind}) AS block_timestamp")
    assert ChainTables(votes=votes).votes is votes
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        if fails:
            with pytest.raises(ValueError, match="Asia/Tokyo"):
                ChainTables(votes=votes)
        else:
            ChainTables(votes=votes)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tables_from_the_catalog(spark, monkeypatch):
    asked = []
    table = spark.createDataFrame([(1,)], "x int")
    monkeypatch.setattr(type(spark), "table", lambda self, name: asked.append(name) or table)
    t = ChainTables.from_catalog(spark, TERRA)
    assert t.votes is table
    assert t.staking is None
    assert sorted(asked) == [
        "terra.core.fact_governance_votes",
        "terra.core.fact_msg_attributes",
        "terra.core.fact_transactions",
    ]
    assert "labels" in required_tables(OSMOSIS)
    assert "labels" not in required_tables(COSMOS)


def test_tables_of_the_session_catalog(spark, tmp_path):
    """Three-part names, of the catalog every session has."""
    own = replace(TERRA, name="spark_catalog")
    spark.sql(f"CREATE DATABASE core LOCATION '{tmp_path}/core'")
    try:
        want = fixtures.chain_tables(spark, SF_DIR, TERRA)
        for name in required_tables(TERRA):
            getattr(want, name).write.saveAsTable(f"core.{TABLE_NAMES[name]}")
        got = ChainTables.from_catalog(spark, own)
        assert got.staking is None
        metric = governance.time_to_governance_daily
        assert rows(metric(got, own)) == rows(metric(want, TERRA))
    finally:
        spark.sql("DROP DATABASE core CASCADE")
