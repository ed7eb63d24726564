"""All metrics of one network, written as parquet tables for a dashboard to read."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.plans import governance, power
from stakelens.sources.tables import ChainTables
from stakelens.spec import ChainSpec

GOVERNANCE = {
    "proposals_weekly": governance.proposals_weekly,
    "voters_by_type": governance.voters_by_type,
    "avg_votes_per_voter": governance.avg_votes_per_voter,
    "vote_options": governance.vote_options,
    "participation_by_debut": governance.participation_by_debut,
    "participants_vs_active": governance.participants_vs_active,
}

# Columns a metric is shown in the order of; the rest have a single row.
SHOWN_BY = {
    "voting_power": ["days"],
    "power_share": ["days", "ranks"],
    "nakamoto": ["days"],
    "proposals_weekly": ["weeks"],
    "voters_by_type": ["date"],
    "avg_votes_per_voter": ["weeks"],
    "vote_options": ["proposal_id"],
    "time_to_governance_daily": ["date"],
    "participation_by_debut": ["date"],
    "participants_vs_active": ["date"],
}


FINISHED = "run string, tables array<string>"


def shown(name: str, df: DataFrame) -> DataFrame:
    """A metric's rows in presentation order. Metrics themselves are not sorted."""
    return df.orderBy(*SHOWN_BY[name]) if name in SHOWN_BY else df


def write_gold(tables: ChainTables, spec: ChainSpec, out: str) -> dict[str, str]:
    """Write each metric, sorted, to ``<out>/<label of spec>/<run>/<metric>``; returns the paths.

    ``out`` must be storage that the driver and all executors share. Each call is a run
    with a folder of its own, noted as finished when all its tables are there: readers of
    ``current`` see the tables of one run, and a run that fails changes nothing for them.
    Older runs stay until their folders are removed.

    What several metrics need is written first and read back, so that its inputs are
    worked through once: the ranked stakes behind the concentration metrics (with the flows
    of both, if the Nakamoto coefficient counts other ones), and the votes without repeats,
    from which all governance metrics follow, so that the votes themselves are read once.
    """
    session = tables.votes.sparkSession
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid4().hex[:8]}"
    folder = f"{out}/{spec.label}/{run}"
    paths = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        return _written(paths, folder, name, df)

    if spec.nakamoto_differs:
        moved = write("stake_flows", power.stake_flows_both(tables, spec))
        flows, flows_nakamoto = (
            moved.filter(F.col(name).isNotNull()).select(
                "days", "validator", F.col(name).alias("flow")
            )
            for name in ("flow", "flow_nakamoto")
        )
        ranked = write("stake_levels", power.power_levels(tables, spec, flows=flows))
        ranked_nakamoto = write(
            "stake_levels_nakamoto", power.power_levels(tables, spec, flows=flows_nakamoto)
        )
    else:
        ranked = ranked_nakamoto = write("stake_levels", power.power_levels(tables, spec))
    votes = write("votes", governance.distinct_votes(tables.votes))
    paths |= write_metrics(replace(tables, votes=votes), spec, folder, ranked, ranked_nakamoto)
    finish(session, spec, out, run, paths)
    return paths


def _written(paths: dict[str, str], folder: str, name: str, df: DataFrame) -> DataFrame:
    """Writes a table, notes its path, and reads it back."""
    paths[name] = f"{folder}/{name}"
    df.write.parquet(paths[name])
    return df.sparkSession.read.schema(df.schema).parquet(paths[name])


def write_metrics(
    tables: ChainTables,
    spec: ChainSpec,
    folder: str,
    ranked: DataFrame,
    ranked_nakamoto: DataFrame,
) -> dict[str, str]:
    """Writes all metrics from ranked stakes and the other tables; returns their paths.

    What several of them need is shared: each voter, each proposal, the debuts of validators,
    and the wait of each wallet until its first vote.
    """
    paths: dict[str, str] = {}

    def write(name: str, df: DataFrame) -> DataFrame:
        return _written(paths, folder, name, df)

    shared = governance.Shared(
        voters=write("voters", governance.voters(tables)),
        proposals=write("proposals", governance.proposals(tables)),
        debuts=write("validator_debuts", governance.validator_debuts(tables, spec))
        if spec.newcomer == "validator"
        else None,
    )
    waits = write("time_to_governance", governance.time_to_governance(tables, spec, shared))
    results = {
        "voting_power": power.voting_power(tables, spec, ranked),
        "power_share": power.power_share_normalized(tables, spec, ranked),
        "nakamoto": power.nakamoto(tables, spec, ranked_nakamoto),
        "time_to_governance_avg": governance.time_to_governance_avg(tables, spec, waits),
        "time_to_governance_daily": governance.time_to_governance_daily(tables, spec, waits),
    }
    results |= {name: metric(tables, spec, shared) for name, metric in GOVERNANCE.items()}
    for name, df in results.items():
        write(name, shown(name, df))
    return paths


def finish(
    session: SparkSession, spec: ChainSpec, out: str, run: str, paths: dict[str, str]
) -> None:
    """Notes that all tables of a run are there."""
    done = session.createDataFrame([(run, list(paths))], FINISHED)
    done.coalesce(1).write.mode("append").parquet(_runs(spec, out))


def _runs(spec: ChainSpec, out: str) -> str:
    return f"{out}/{spec.label}/runs"


def current(session: SparkSession, spec: ChainSpec, out: str) -> dict[str, str]:
    """Paths of the tables of the newest finished run: one short row is read."""
    runs = session.read.schema(FINISHED).parquet(_runs(spec, out))
    newest = runs.orderBy(F.desc("run")).first()
    return {name: f"{out}/{spec.label}/{newest['run']}/{name}" for name in newest["tables"]}
