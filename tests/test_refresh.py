"""Gold kept up from new rows equals gold from all rows, and reads only the new ones."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens import COSMOS, OSMOSIS, TERRA
from stakelens.operators import ranking
from stakelens.plans import gold, power, refresh
from stakelens.sources import fixtures, layout
from stakelens.sources.tables import MONTH, required_tables
from tests.helpers import rows

SF_DIR = "/root/testdata/sf0.001"


def _blocks(spark, spec):
    """The fixture, with all rows of a transaction at the time of its first."""
    found = fixtures.chain_tables(spark, SF_DIR, spec)

    def at_once(df):
        first = F.min("block_timestamp").over(W.partitionBy("tx_id"))
        return df.withColumn("block_timestamp", first)

    changed = {
        name: at_once(getattr(found, name))
        for name in ("staking", "msg_attributes", "votes")
        if getattr(found, name) is not None
    }
    return replace(found, **changed)


def _stored_by_month(spark, tables, spec, folder):
    """The tables as parquet, partitioned by month; labels as they are."""
    paths = {}
    for name in required_tables(spec):
        df = getattr(tables, name)
        if "block_timestamp" in df.columns:
            month = F.trunc(F.to_date("block_timestamp"), "month")
            paths[name] = f"{folder}/{name}"
            df.withColumn(MONTH, month).write.partitionBy(MONTH).parquet(paths[name])
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    return replace(tables, **read), paths


def _cut(tables, keep):
    """Tables without the rows of months that do not pass."""
    return replace(
        tables,
        **{
            name: df.filter(keep(F.trunc(F.to_date("block_timestamp"), "month")))
            for name, df in vars(tables).items()
            if df is not None and "block_timestamp" in df.columns
        },
    )


def _results(spark, paths):
    names = [n for n in paths if n in gold.SHOWN_BY or n == "time_to_governance_avg"]
    return {name: rows(spark.read.parquet(paths[name])) for name in sorted(names)}


def _months(tables):
    found = set()
    for df in vars(tables).values():
        if df is not None and "block_timestamp" in df.columns:
            month = F.trunc(F.to_date("block_timestamp"), "month")
            found |= {r[0] for r in df.select(month).distinct().collect()}
    return sorted(found - {None})


@pytest.mark.parametrize("spec", [OSMOSIS, COSMOS], ids=lambda s: s.label)
def test_a_refresh_equals_a_run_from_nothing_and_reads_only_new_months(spark, tmp_path, spec):
    whole = _blocks(spark, spec)
    whole, paths = _stored_by_month(spark, whole, spec, tmp_path / "in")
    months = _months(whole)
    new = months[-3:]
    out = str(tmp_path / "out")
    refresh.refresh(_cut(whole, lambda m: m < F.lit(new[0])), spec, out)
    # The files of old months become unreadable: a second run must not look into them.
    for path in paths.values():
        for file in (tmp_path / "in").glob(f"{path.rsplit('/', 1)[1]}/*/*.parquet"):
            if date.fromisoformat(file.parent.name.split("=")[1]) < new[0]:
                file.write_bytes(b"not parquet at all")
    got = refresh.refresh(whole, spec, out, new)
    assert gold.current(spark, spec, out) == got
    all_rows = _blocks(spark, spec)
    want = gold.write_gold(all_rows, spec, str(tmp_path / "want"))
    assert _results(spark, got) == _results(spark, want)


def test_late_rows_reopen_their_month(spark, tmp_path):
    whole = _blocks(spark, OSMOSIS)
    months = _months(whole)
    late, out = months[len(months) // 2], str(tmp_path / "out")
    early = replace(
        whole,
        votes=whole.votes.filter((F.trunc("block_timestamp", "month") != F.lit(late))),
        staking=whole.staking.filter(
            (F.trunc("block_timestamp", "month") != F.lit(late)) | (F.col("tx_id").endswith("3"))
        ),
    )
    first = refresh.refresh(early, OSMOSIS, out)
    got = refresh.refresh(_cut(whole, lambda m: m == F.lit(late)), OSMOSIS, out, [late])
    want = gold.write_gold(whole, OSMOSIS, str(tmp_path / "want"))
    assert _results(spark, got) == _results(spark, want)
    assert _results(spark, first) != _results(spark, want)


def test_rows_without_a_time_and_empty_months(spark, tmp_path):
    whole = _blocks(spark, TERRA)
    none = F.lit(None).cast("timestamp_ntz")
    untimed = F.col("tx_id").endswith("7")
    votes = whole.votes.withColumn(
        "block_timestamp", F.when(untimed, none).otherwise(F.col("block_timestamp"))
    )
    whole = replace(whole, votes=votes)
    out = str(tmp_path / "out")
    refresh.refresh(replace(whole, votes=votes.filter(~untimed)), TERRA, out)
    got = refresh.refresh(whole, TERRA, out, [None, date(2031, 1, 1)])
    want = gold.write_gold(whole, TERRA, str(tmp_path / "want"))
    assert _results(spark, got) == _results(spark, want)


def test_a_failed_refresh_changes_nothing(spark, tmp_path):
    whole = _blocks(spark, OSMOSIS)
    last, out = _months(whole)[-1], str(tmp_path / "out")
    first = refresh.refresh(whole, OSMOSIS, out)
    noted = refresh.State(spark, OSMOSIS, out).load().noted
    broken = whole.votes.withColumn("vote_option", F.raise_error(F.lit("broken")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        refresh.refresh(replace(whole, votes=broken), OSMOSIS, out, [last])
    assert gold.current(spark, OSMOSIS, out) == first
    assert refresh.State(spark, OSMOSIS, out).load().noted == noted


@pytest.mark.parametrize("spec", [OSMOSIS, COSMOS], ids=lambda s: s.label)
def test_a_month_is_appended_without_earlier_flows(spark, spec):
    tables = _blocks(spark, spec)
    flows = power.stake_flows(tables, spec).cache()
    months = sorted({r[0] for r in flows.select(F.trunc("days", "month")).distinct().collect()})
    cut = months[-6]
    earlier, later = flows.filter(F.col("days") < F.lit(cut)), flows.filter(F.col("days") >= F.lit(cut))
    positions = ranking.cumulative_stake(earlier)
    balances = ranking.closing_balances(positions, None, months[0], months[-7])
    opening = balances.filter(F.col("month") == F.lit(months[-7]))
    positive = F.col("cum") > 0 if spec.positive_only else F.lit(True)
    before = ranking.stake_levels(positions.filter(positive))
    total = before.orderBy(F.desc("days")).first()["total"]
    resumed = ranking.cumulative_stake(later, opening)
    whole = ranking.cumulative_stake(flows)
    new = F.col("days") >= F.lit(cut)
    columns = ["days", "validator", "flow", "cum"]
    assert rows(resumed, *columns) == rows(whole.filter(new), *columns)
    levels = ranking.stake_levels(resumed.filter(positive), total)
    assert rows(levels) == rows(ranking.stake_levels(whole.filter(positive)).filter(new))
    # Balances of a month follow from those of the month before.
    again = ranking.closing_balances(resumed, opening, cut, months[-1])
    straight = ranking.closing_balances(whole, None, months[0], months[-1])
    assert rows(again) == rows(straight.filter(F.col("month") >= F.lit(cut)))
    flows.unpersist()


def test_of_months_prunes_partitions(spark, tmp_path):
    tables, _ = _stored_by_month(spark, _blocks(spark, TERRA), TERRA, tmp_path)
    one = layout.of_months(tables.votes, [date(1996, 5, 1)])
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block_month" in text
    assert "GreaterThanOrEqual(block_timestamp" in text
    assert {r[0] for r in one.select(F.trunc("block_timestamp", "month")).distinct().collect()} == {
        date(1996, 5, 1)
    }
