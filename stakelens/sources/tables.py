"""Where a network's input tables come from: a catalog or a parquet folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import TimestampType

from stakelens.sources import schemas
from stakelens.spec import ChainSpec

# Warehouse table of each input.
TABLE_NAMES = {
    "staking": "fact_staking",
    "msg_attributes": "fact_msg_attributes",
    "votes": "fact_governance_votes",
    "proposal_deposits": "fact_governance_proposal_deposits",
    "transactions": "fact_transactions",
    "labels": "dim_labels",
}

# Column of the month by which stored tables may be partitioned.
MONTH = "block_month"

UTC_NAMES = ("UTC", "Etc/UTC", "Z", "GMT", "Etc/GMT", "+00:00", "Etc/UCT", "UCT", "Zulu")


def required_tables(spec: ChainSpec) -> list[str]:
    """Inputs the metrics of one network read; the rest need not exist."""
    needed = ["votes", "transactions"]
    needed.append("staking" if spec.staking == "typed" else "msg_attributes")
    if spec.proposals_from == "deposits":
        needed.append("proposal_deposits")
    if spec.newcomer == "validator":
        needed.append("labels")
    return needed


def _check_zone(table: DataFrame, name: str) -> None:
    """Days are those of the session's zone, unless timestamps have no zone of their own."""
    zone = table.sparkSession.conf.get("spark.sql.session.timeZone")
    zoned = any(isinstance(f.dataType, TimestampType) for f in table.schema.fields)
    if zoned and zone not in UTC_NAMES:
        raise ValueError(
            f"{name} has timestamps, and days would be those of {zone}: set "
            "spark.sql.session.timeZone to UTC"
        )


@dataclass(frozen=True)
class ChainTables:
    """One DataFrame per input table; an input a network does not use is ``None``."""

    staking: DataFrame | None = None
    msg_attributes: DataFrame | None = None
    votes: DataFrame | None = None
    proposal_deposits: DataFrame | None = None
    transactions: DataFrame | None = None
    labels: DataFrame | None = None

    def __post_init__(self):
        for name in TABLE_NAMES:
            table = getattr(self, name)
            if table is not None:
                _check_zone(table, name)

    @classmethod
    def from_catalog(cls, spark: SparkSession, spec: ChainSpec) -> ChainTables:
        """Tables named ``<chain>.core.<table>``."""
        chain = spec.name
        return cls(
            **{t: spark.table(f"{chain}.core.{TABLE_NAMES[t]}") for t in required_tables(spec)}
        )

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, spec: ChainSpec) -> ChainTables:
        """Parquet folders ``<root>/<chain>/core/<table>``, read with fixed schemas."""
        declared = {
            "staking": schemas.STAKING,
            "msg_attributes": schemas.MSG_ATTRIBUTES,
            "votes": schemas.VOTES,
            "proposal_deposits": schemas.PROPOSAL_DEPOSITS,
            "transactions": schemas.transactions(spec.wallet_column),
            "labels": schemas.LABELS,
        }
        return cls(
            **{
                t: spark.read.schema(declared[t]).parquet(
                    f"{root}/{spec.name}/core/{TABLE_NAMES[t]}"
                )
                for t in required_tables(spec)
            }
        )
