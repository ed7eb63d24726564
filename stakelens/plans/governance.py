"""Who votes, how often, how soon, and on what."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stakelens.functions import columns as C
from stakelens.operators import debut as db
from stakelens.operators import exact as ex
from stakelens.operators import presence as pr
from stakelens.operators import ranking as rk
from stakelens.operators import skew as sk
from stakelens.sources.tables import ChainTables
from stakelens.spec import ChainSpec


# How often a vote occurs, where equal votes are one row.
TIMES = "times"


@dataclass(frozen=True)
class Shared:
    """What several metrics need. To compute them all, write each once (``write_gold`` does)."""

    voters: DataFrame | None = None
    proposals: DataFrame | None = None
    debuts: DataFrame | None = None


def voters(tables: ChainTables) -> DataFrame:
    """Each voter's first and last vote, and its proposals; a NULL voter has a row.

    Output: voter, debut, last_seen, n_proposals.
    """
    return tables.votes.groupBy("voter").agg(
        F.min("block_timestamp").alias("debut"),
        F.max("block_timestamp").alias("last_seen"),
        F.countDistinct("proposal_id").alias("n_proposals"),
    )


def proposals(tables: ChainTables) -> DataFrame:
    """Each proposal's first vote, voting transactions and voters.

    Output: proposal_id, debut, votes, participants.
    """
    return tables.votes.groupBy("proposal_id").agg(
        F.min("block_timestamp").alias("debut"),
        F.countDistinct("tx_id").alias("votes"),
        F.countDistinct("voter").alias("participants"),
    )


def distinct_votes(votes: DataFrame) -> DataFrame:
    """Votes without repeats: what every metric here counts, each set of them mergeable.

    The earliest time of each is kept, by day; options are told apart only as far as they
    have labels of their own. All metrics give for these rows what they give for all votes.
    Rows of two periods, or of a period read twice in parts, are merged by calling this on
    their union.

    Output: date, proposal_id, vote_option, voter, tx_id, vote_weight, block_timestamp, times.
    """
    option = F.when(F.col("vote_option").between(1, 3), F.col("vote_option"))
    weight = F.col("vote_weight")
    times = F.sum(TIMES) if TIMES in votes.columns else F.count(F.lit(1))
    return votes.groupBy(
        F.to_date("block_timestamp").alias("date"),
        "proposal_id",
        option.alias("vote_option"),
        "voter",
        "tx_id",
        F.when(weight != 0, weight).alias("vote_weight"),
    ).agg(F.min("block_timestamp").alias("block_timestamp"), times.alias(TIMES))


def _or(shared: DataFrame | None, make, *args) -> DataFrame:
    return make(*args) if shared is None else shared


def proposals_weekly(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """New and cumulative proposals by week of their first deposit (or vote).

    Output: weeks, new_proposals, cum_proposals.
    """
    if spec.proposals_from == "deposits":
        seen = db.first_seen(tables.proposal_deposits, "proposal_id", "proposal_id")
    else:
        seen = _or(shared.proposals, db.first_seen, tables.votes, "proposal_id", "proposal_id")
    weekly = (
        seen.groupBy(C.period("debut", "week").alias("weeks"))
        .agg(F.count("proposal_id").alias("new_proposals"))
    )
    return weekly.withColumn("cum_proposals", rk.running_total("weeks", "new_proposals"))


def validator_debuts(tables: ChainTables, spec: ChainSpec) -> DataFrame:
    """First day anyone staked with a validator, by the account it votes with.

    Only staking in the network's denom counts. Output: voter, debut.
    """
    staked = db.first_seen(
        tables.staking.filter(F.col("currency") == spec.denom), "validator_address", "address"
    )
    accounts = tables.labels.select(
        "address", C.account_address(tables.labels).alias("account")
    ).distinct()
    return (
        staked.join(accounts, "address")
        .groupBy(F.col("account").alias("voter"))
        .agg(F.to_date(F.min("debut")).alias("debut"))
    )


def _dated(votes: DataFrame) -> DataFrame:
    """Votes of which the voter and the time are known."""
    return votes.filter(F.col("voter").isNotNull() & F.col("block_timestamp").isNotNull())


def voters_by_type(
    tables: ChainTables,
    spec: ChainSpec,
    shared: Shared = Shared(),
    parts: int = sk.PARTS,
) -> DataFrame:
    """Distinct voters and voting transactions per day, newcomers apart.

    A voter is new from its own first vote, or, where newcomers are validators,
    from the first staking action on that validator.
    Output: date, type, voters, votes.
    """
    votes = _dated(tables.votes).select(
        F.to_date("block_timestamp").alias("date"), "voter", "tx_id", "proposal_id"
    )
    if spec.newcomer == "validator":
        # Only the few validator accounts are counted. Spark may broadcast the debuts; if
        # they are too many for that, a validator has a row per own vote, which adaptive
        # execution splits.
        debuts = _or(shared.debuts, validator_debuts, tables, spec)
        return _by_type(votes.join(debuts, "voter"), spec)
    # The filter keeps the time in both uses of this table, which then share one shuffle.
    per_voter = _or(shared.voters, _first_votes, tables.votes).filter(
        F.col("voter").isNotNull() & F.col("debut").isNotNull()
    )
    debuts = per_voter.select("voter", F.to_date("debut").alias("debut"))
    return _by_type(
        sk.join_split(votes, debuts, "voter", ["tx_id", "proposal_id"], parts), spec
    )


def _first_votes(votes: DataFrame) -> DataFrame:
    return db.first_seen(_dated(votes), "voter", "voter")


def _by_type(votes: DataFrame, spec: ChainSpec) -> DataFrame:
    kind = C.tenure("debut", "date", spec.newcomer).alias("type")
    typed = votes.select("date", kind, "voter", "tx_id")
    # Counting two things doubles the rows, and the parts of a hot voter grow with its votes.
    return sk.dealt(typed, *typed.columns).groupBy("date", "type").agg(
        F.countDistinct("voter").alias("voters"),
        F.countDistinct("tx_id").alias("votes"),
    )


def avg_votes_per_voter(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """Mean voting transactions per voter and day, by week, newcomers apart.

    Votes are counted per voter and day before anything else, so a voter has at
    most one row per calendar day when its debut is attached.
    Output: weeks, type, avg_votes_per_voter.
    """
    voter_days = (
        _dated(tables.votes)
        .groupBy("voter", F.to_date("block_timestamp").alias("date"))
        .agg(F.countDistinct("tx_id").alias("votes"))
    )
    if spec.newcomer == "validator":
        debuts = _or(shared.debuts, validator_debuts, tables, spec)
        voter_days = voter_days.join(debuts, "voter")
    else:
        # The first vote is the earliest of these days: no second read of the votes.
        voter_days = voter_days.withColumn(
            "debut", F.min("date").over(W.partitionBy("voter"))
        )
    return (
        voter_days.groupBy(
            F.trunc("date", "week").alias("weeks"),
            C.tenure("debut", "date", spec.newcomer).alias("type"),
        )
        .agg(F.avg("votes").alias("avg_votes_per_voter"))
        .withColumn("avg_votes_per_voter", F.round("avg_votes_per_voter", 9))
    )


def vote_options(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """Voters, votes and weight per proposal and option.

    A missing weight counts as 0, one that is not a number makes the sum none; the sum does
    not depend on the order of the votes. Output: proposal_id, vote, voters, votes, weight.
    """
    votes = tables.votes.withColumn("vote", C.vote_label("vote_option"))
    keys = ["proposal_id", "vote"]
    counts = votes.groupBy(*keys).agg(
        F.countDistinct("voter").alias("voters"),
        F.countDistinct("tx_id").alias("votes"),
    )
    times = F.col(TIMES) if TIMES in votes.columns else None
    weights = ex.exact_sum(votes, keys, F.col("vote_weight"), "weight", times)
    same = counts["proposal_id"].eqNullSafe(weights["proposal_id"]) & (
        counts["vote"] == weights["vote"]
    )
    # A row on either side for each proposal and option.
    return counts.join(weights, same).select(
        counts["proposal_id"], counts["vote"], "voters", "votes",
        F.round("weight", 6).alias("weight"),
    )


def time_to_governance(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """Days from a wallet's first transaction to its first vote; may be negative.

    Wallets that never voted are dropped where the transactions are read, all but a few, so
    that they are neither added up nor shuffled. Both sides are one row per wallet before
    they meet. The two metrics below need only this, so ``write_gold`` reads the transactions
    once for both. Output: wallet, governance_debut, days_to_vote.
    """
    seen = _or(shared.voters, db.first_seen, tables.votes, "voter", "voter")
    first_votes = seen.select(
        F.col("voter").alias("wallet"), F.col("debut").alias("governance_debut")
    ).filter(F.col("wallet").isNotNull())
    voted = pr.probably_in(tables.transactions, spec.wallet_column, first_votes, "wallet")
    wallets = db.first_seen(voted, spec.wallet_column, "wallet")
    return wallets.join(first_votes, "wallet").select(
        "wallet",
        "governance_debut",
        C.days_between("debut", "governance_debut").alias("days_to_vote"),
    )


def time_to_governance_avg(
    tables: ChainTables, spec: ChainSpec, waits: DataFrame | None = None
) -> DataFrame:
    """One row: avg_time_to_governance_participation."""
    waits = time_to_governance(tables, spec) if waits is None else waits
    return waits.agg(
        F.round(F.avg("days_to_vote"), 9).alias("avg_time_to_governance_participation")
    )


def time_to_governance_daily(
    tables: ChainTables, spec: ChainSpec, waits: DataFrame | None = None
) -> DataFrame:
    """By day of the first vote.

    Output: date, avg_time_to_governance_participation, participants.
    """
    waits = time_to_governance(tables, spec) if waits is None else waits
    return waits.groupBy(F.to_date("governance_debut").alias("date")).agg(
        F.round(F.avg("days_to_vote"), 9).alias("avg_time_to_governance_participation"),
        # Wallets are unique and not NULL after the join.
        F.count("*").alias("participants"),
    )


def participation_by_debut(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """Voters by day of their first vote, and on how many proposals they voted.

    Output: date, n_users, avg_proposals_per_user.
    """
    return (
        _or(shared.voters, voters, tables)
        .groupBy(F.to_date("debut").alias("date"))
        .agg(
            F.count("voter").alias("n_users"),
            F.round(F.avg("n_proposals"), 9).alias("avg_proposals_per_user"),
        )
    )


def participants_vs_active(
    tables: ChainTables, spec: ChainSpec, shared: Shared = Shared()
) -> DataFrame:
    """Participants of each proposal against voters active before its first day.

    A proposal that nobody could precede is absent.
    Output: date, proposal_id, votes, participants, active_users.
    """
    opened = _or(shared.proposals, proposals, tables).withColumn("date", F.to_date("debut"))
    if shared.voters is None:
        active = db.appeared_before(tables.votes, "voter")
    else:
        active = db.spans_before(shared.voters, "voter")
    # At most one row per calendar day between the first and the last vote.
    return opened.join(active, "date").select(
        "date", "proposal_id", "votes", "participants", F.col("entities").alias("active_users")
    )
