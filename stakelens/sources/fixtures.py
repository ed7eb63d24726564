"""The input tables, derived from the test data's star schema (see FIXTURES.md).

The reference data is in a remote warehouse, so tests, bench and the driver's
queries read these instead. Each function reads its whole base table.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stakelens.sources.tables import ChainTables, required_tables
from stakelens.spec import COSMOS, OSMOSIS, ChainSpec

# Networks whose rows differ from those of the other network with the same kind of source,
# so that their queries prove something of their own.
SHIFTED = ("axelar", "terra")


@cache
def _schema(spark: SparkSession, path: str) -> StructType:
    """Schema from the file footers, looked up once: each lookup is a Spark job."""
    return spark.read.parquet(path).schema


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


def _micro(spec: ChainSpec):
    """Micro-units moved by a line; a shifted network adds the number of the part."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (cents + F.col("l_partkey") if spec.name in SHIFTED else cents) * 10000


def staking(spark: SparkSession, sf_dir: str, spec: ChainSpec = OSMOSIS) -> DataFrame:
    """Typed staking actions; every first line of an order appears twice."""
    copies = F.when(F.col("l_linenumber") == 1, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))
    )
    return (
        _read(spark, sf_dir, "lineitem")
        .withColumn("copy", F.explode(copies))
        .select(
            F.col("l_shipdate").alias("block_timestamp"),
            F.col("l_orderkey").cast("string").alias("tx_id"),
            F.when(
                (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "undelegate"
            )
            .when(F.col("l_returnflag") == "N", "redelegate")
            .otherwise("delegate")
            .alias("action"),
            F.col("l_suppkey").cast("string").alias("validator_address"),
            F.when(
                F.col("l_returnflag") == "N",
                (F.col("l_suppkey") + F.col("l_linenumber")).cast("string"),
            ).alias("redelegate_source_validator_address"),
            _micro(spec).cast("decimal(38,0)").alias("amount"),
            F.when(F.col("l_linenumber") == 7, "uion").otherwise(spec.denom).alias("currency"),
        )
    )


def msg_attributes(spark: SparkSession, sf_dir: str, spec: ChainSpec = COSMOS) -> DataFrame:
    """Key/value message attributes: amount, shares and one or two validators each."""
    micro = _micro(spec)
    lines = _read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("block_timestamp"),
        F.col("l_orderkey").cast("string").alias("tx_id"),
        F.when(F.col("l_returnflag") == "N", "redelegate")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "unbond")
        .otherwise("delegate")
        .alias("msg_type"),
        F.when(F.col("l_linenumber") == 7, "ibc/27AB")
        .when(F.col("l_linenumber") == 6, "")
        .otherwise("uatom")
        .alias("denom"),
        F.when(
            (F.col("l_linenumber") == 5) & (F.col("l_quantity") == 50), micro * 1000000
        )
        .otherwise(micro)
        .cast("string")
        .alias("micro"),
        F.concat(F.lit("val"), F.col("l_suppkey").cast("string")).alias("validator"),
        F.concat(
            F.lit("val"), (F.col("l_suppkey") + F.col("l_linenumber")).cast("string")
        ).alias("source"),
    )
    msg_type = F.col("msg_type")

    def attribute(key, value):
        return F.struct(key.alias("attribute_key"), value.alias("attribute_value"))

    validator_key = F.when(msg_type == "redelegate", "destination_validator").otherwise(
        "validator"
    )
    shares = F.concat("micro", F.lit(".000000000000000000"), "denom")
    both = [
        attribute(F.lit("amount"), F.concat("micro", "denom")),
        attribute(validator_key, F.col("validator")),
    ]
    attributes = (
        F.when(msg_type == "delegate", F.array(*both, attribute(F.lit("new_shares"), shares)))
        .when(
            msg_type == "redelegate",
            F.array(*both, attribute(F.lit("source_validator"), F.col("source"))),
        )
        .otherwise(F.array(*both))
    )
    return lines.select(
        "block_timestamp", "tx_id", "msg_type", F.explode(attributes).alias("attribute")
    ).select("block_timestamp", "tx_id", "msg_type", "attribute.*")


def votes(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """Every line is a vote. Voters of orders that are not urgent have names of their own, so
    that some voters have no transactions and some wallets no votes. If ``hot``, a third of
    the votes is one voter's."""
    wallet = F.col("o_custkey").cast("string")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    voter = F.when(urgent, wallet).otherwise(F.concat(F.lit("m"), wallet))
    if hot:
        voter = F.when(F.col("o_orderkey") % 3 == 0, "hot").otherwise(voter)
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", voter.alias("voter"))
    return (
        _read(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_shipdate").alias("block_timestamp"),
            F.col("l_orderkey").cast("string").alias("tx_id"),
            "voter",
            (
                (F.year("l_shipdate") - 1995) * 36
                + F.month("l_shipdate") * 3
                + F.col("l_partkey") % 3
            ).alias("proposal_id"),
            F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber")).alias("vote_option"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("vote_weight"),
        )
    )


def proposal_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("block_timestamp"),
        (
            (F.year("o_orderdate") - 1995) * 36
            + F.month("o_orderdate") * 3
            + F.col("o_custkey") % 3
        ).alias("proposal_id"),
    )


def transactions(spark: SparkSession, sf_dir: str, spec: ChainSpec = OSMOSIS) -> DataFrame:
    """One for each order; a shifted network has them up to 59 days later, by customer."""
    at = F.col("o_orderdate")
    if spec.name in SHIFTED:
        at = at + F.make_dt_interval((F.col("o_custkey") % 60).cast("int"))
    return _read(spark, sf_dir, "orders").select(
        at.alias("block_timestamp"), F.col("o_custkey").cast("string").alias(spec.wallet_column)
    )


def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("address"),
        F.concat(
            F.lit('[{"account_address":"'),
            (F.col("s_suppkey") * 3).cast("string"),
            F.lit('"}]'),
        ).alias("raw_metadata"),
    )


def chain_tables(
    spark: SparkSession, sf_dir: str, spec: ChainSpec, *names: str
) -> ChainTables:
    """The named inputs of a network, or all that its metrics read."""
    makers = {
        "staking": lambda: staking(spark, sf_dir, spec),
        "msg_attributes": lambda: msg_attributes(spark, sf_dir, spec),
        "votes": lambda: votes(spark, sf_dir),
        "proposal_deposits": lambda: proposal_deposits(spark, sf_dir),
        "transactions": lambda: transactions(spark, sf_dir, spec),
        "labels": lambda: address_labels(spark, sf_dir),
    }
    return ChainTables(**{name: makers[name]() for name in names or required_tables(spec)})
