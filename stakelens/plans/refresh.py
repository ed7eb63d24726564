"""Gold tables kept up from new rows only.

A refresh reads the months that it is told have new rows, and nothing else, from the inputs.
What it learns is stored as state, by month, in a form that later months do not change:

- net stake per period and validator, and each validator's balance at the end of the month;
- the ranked stakes of the month's periods, and the running total at its end;
- votes without repeats, first transactions of wallets, first deposits of proposals and first
  stakings with validators, whose union over the months gives what all rows would give.

A month that is named again, because rows came late, replaces its state; as balances build on
one another, ranked stakes and balances are made again from there on, out of stored flows.
Metrics come from the state of all months. They equal those of a run over all rows, provided
that the rows of a transaction share a month, as they have the time of its block.

State and metrics of a run are written to folders of its own and noted when all is there, so a
failed run changes nothing.
"""

from __future__ import annotations

import json
from dataclasses import replace
from datetime import date, datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stakelens.functions import columns as C
from stakelens.operators import debut as db
from stakelens.operators import ranking as rk
from stakelens.plans import gold, governance, power
from stakelens.sources.layout import of_months
from stakelens.sources.tables import MONTH, ChainTables
from stakelens.spec import ChainSpec

NOTED = "run string, name string, month date, columns string"
# The month of rows without a time, as a folder name may not be missing.
NO_MONTH = date(1000, 1, 1)


def reduced(tables: ChainTables, spec: ChainSpec) -> ChainTables:
    """The inputs of the governance metrics in the smallest form that gives the same metrics.

    Each has a ``block_timestamp`` and may be cut by it; the metrics of the union of such cuts
    are those of all rows.
    """
    found = {"votes": governance.distinct_votes(tables.votes)}
    wallet = spec.wallet_column
    found["transactions"] = db.first_seen(tables.transactions, wallet, wallet, "block_timestamp")
    if spec.proposals_from == "deposits":
        found["proposal_deposits"] = db.first_seen(
            tables.proposal_deposits, "proposal_id", "proposal_id", "block_timestamp"
        )
    staked = None
    if spec.newcomer == "validator":
        address = "validator_address"
        own = tables.staking.filter(F.col("currency") == spec.denom)
        staked = db.first_seen(own, address, address, "block_timestamp").withColumn(
            "currency", F.lit(spec.denom)
        )
    return ChainTables(staking=staked, labels=tables.labels, **found)


class State:
    """What earlier runs have stored for a network under a folder."""

    def __init__(self, spark: SparkSession, spec: ChainSpec, out: str):
        self.spark, self.base = spark, f"{out}/{spec.label}/state"
        self.noted: dict[tuple[str, date], str] = {}  # newest run by table and month
        self.columns: dict[str, str] = {}  # of each table, as JSON

    def load(self) -> State:
        """Reads what the finished runs have noted: a row for each run, table and month."""
        rows = self.spark.read.schema(NOTED).parquet(f"{self.base}/runs")
        newest = rows.groupBy("name", "month").agg(
            F.max("run").alias("run"), F.max_by("columns", "run").alias("columns")
        )
        for name, month, run, columns in newest.collect():
            self.noted[name, month], self.columns[name] = run, columns
        return self

    def months(self, name: str) -> list[date]:
        return sorted(month for table, month in self.noted if table == name)

    def write(self, name: str, df: DataFrame, run: str, months: list[date] | None) -> None:
        """Stores rows of these months, which replace what was held for them.

        Without ``months``, the months that the rows have.
        """
        path = f"{self.base}/{run}/{name}"
        df.write.partitionBy(MONTH).parquet(path)
        own = df.schema.jsonValue()
        own["fields"].sort(key=lambda f: f["name"] == MONTH)  # last, as in the folders
        self.columns[name] = json.dumps(own)
        if months is None:
            months = [r[0] for r in self._read(name, run).select(MONTH).distinct().collect()]
        self.noted |= {(name, month): run for month in months}

    def _read(self, name: str, run: str) -> DataFrame:
        columns = StructType.fromJson(json.loads(self.columns[name]))
        return self.spark.read.schema(columns).parquet(f"{self.base}/{run}/{name}")

    def read(self, name: str, months: list[date] | None = None) -> DataFrame:
        """The rows held for all months, or for some."""
        wanted = self.months(name) if months is None else months
        runs: dict[str, list[date]] = {}
        for month in wanted:
            runs.setdefault(self.noted[name, month], []).append(month)
        parts = [
            self._read(name, run).filter(F.col(MONTH).isin(own)) for run, own in runs.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def note(self, run: str) -> None:
        """Makes a run's months count for later runs."""
        rows = [
            (r, name, month, self.columns[name])
            for (name, month), r in self.noted.items()
            if r == run
        ]
        noted = self.spark.createDataFrame(rows, NOTED)
        noted.coalesce(1).write.mode("append").parquet(f"{self.base}/runs")


def _by_month(df: DataFrame, time: str) -> DataFrame:
    month = F.coalesce(C.period(time, "month"), F.lit(NO_MONTH))
    return df.withColumn(MONTH, month)


def refresh(
    tables: ChainTables, spec: ChainSpec, out: str, months: list[date | None] | None = None
) -> dict[str, str]:
    """Brings state and gold up to date; returns the paths of the metrics.

    ``months`` are the first days of the months with new or late rows, ``None`` among them for
    rows without a time; left out, all rows are read, and nothing is expected to be there yet.
    """
    spark = tables.votes.sparkSession
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    state = State(spark, spec, out)
    if months is not None:
        state.load()
        tables = replace(
            tables,
            **{
                name: of_months(table, months)
                for name, table in vars(tables).items()
                if table is not None and "block_timestamp" in table.columns
            },
        )
    named = None if months is None else [NO_MONTH if m is None else m for m in months]
    small = reduced(tables, spec)
    for name in ("votes", "transactions", "proposal_deposits", "staking"):
        table = getattr(small, name)
        if table is not None:
            state.write(name, _by_month(table, "block_timestamp"), run, named)
    state.write("flows", _by_month(_flows(tables, spec), "days"), run, named)
    _rank(state, spec, run, named)
    paths = _write_metrics(state, tables, spec, out, run)
    state.note(run)
    gold.finish(spark, spec, out, run, paths)
    return paths


def _flows(tables: ChainTables, spec: ChainSpec) -> DataFrame:
    if spec.nakamoto_differs:
        return power.stake_flows_both(tables, spec)
    return power.stake_flows(tables, spec)


def _rank(state: State, spec: ChainSpec, run: str, named: list[date] | None) -> None:
    """Ranked stakes and balances from the first named month on, out of stored flows."""
    held = [month for month in state.months("flows") if month != NO_MONTH]
    if named is not None:
        first = min((m for m in named if m != NO_MONTH), default=None)
        if first is None:
            return
        again, before = [m for m in held if m >= first], [m for m in held if m < first]
    else:
        again, before = held, []
    if not again:
        return
    moved = state.read("flows", again)
    for suffix, column in _readings(spec):
        flows = moved.filter(F.col(column).isNotNull()).select(
            "days", "validator", F.col(column).alias("flow")
        )
        opening = total = None
        if before:
            opening = state.read(f"balances{suffix}", before[-1:])
            known = state.read(f"totals{suffix}").filter(F.col(MONTH) < F.lit(again[0]))
            newest = known.orderBy(F.desc(MONTH)).first()
            total = newest["total"] if newest else None
        stakes = rk.cumulative_stake(flows, opening)
        # Each month's balances go on to the next month that is held.
        closing = rk.closing_balances(stakes, opening, again[0], again[-1])
        closing = closing.filter(F.col("month").isin(again))
        state.write(f"balances{suffix}", closing.withColumnRenamed("month", MONTH), run, again)
        ranked = rk.stake_levels(
            stakes.filter(F.col("cum") > 0) if spec.positive_only else stakes, total
        )
        state.write(f"levels{suffix}", _by_month(ranked, "days"), run, again)
        ends = state.read(f"levels{suffix}", again).groupBy(MONTH)
        state.write(
            f"totals{suffix}", ends.agg(F.max_by("total", "days").alias("total")), run, again
        )


def _readings(spec: ChainSpec) -> list[tuple[str, str]]:
    """Suffix of the tables and column of the flows, for each way to count stake."""
    return [("", "flow")] + ([("_nakamoto", "flow_nakamoto")] if spec.nakamoto_differs else [])


def _write_metrics(
    state: State, tables: ChainTables, spec: ChainSpec, out: str, run: str
) -> dict[str, str]:
    """All metrics, from the state of all months."""
    held = {
        name: state.read(name).drop(MONTH)
        for name in ("votes", "transactions", "proposal_deposits", "staking")
        if state.months(name)
    }
    small = ChainTables(labels=tables.labels, **held)
    suffix = _readings(spec)[-1][0]
    return gold.write_metrics(
        small,
        spec,
        f"{out}/{spec.label}/{run}",
        state.read("levels").drop(MONTH),
        state.read(f"levels{suffix}").drop(MONTH),
    )
