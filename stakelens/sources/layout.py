"""A layout of the inputs that the metrics read with less work: months and buckets.

Tables with times are partitioned by month, so that a month is read without its neighbours.
The attribute log is also bucketed by transaction, so that bringing the entries of a
transaction together needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stakelens.functions import columns as C
from stakelens.sources.tables import MONTH, TABLE_NAMES, ChainTables, required_tables
from stakelens.spec import ChainSpec

# Tables whose rows are brought together by transaction.
BUCKETED = {"msg_attributes": "tx_id"}


def store(tables: ChainTables, spec: ChainSpec, database: str, buckets: int = 200) -> None:
    """Writes the inputs of a network as tables of a database of the session's catalog.

    ``buckets`` should make a bucket of a month some 100-200 MB. Rows of a month and bucket
    are in one file; tables without buckets have as many files a month as tasks write them.
    """
    for name in required_tables(spec):
        df, table = getattr(tables, name), f"{database}.{TABLE_NAMES[name]}"
        if "block_timestamp" not in df.columns:
            df.write.saveAsTable(table)
            continue
        df = df.withColumn(MONTH, C.period("block_timestamp", "month"))
        if name in BUCKETED:
            key = BUCKETED[name]
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = df.write
        writer.partitionBy(MONTH).saveAsTable(table)


def read(spark: SparkSession, spec: ChainSpec, database: str) -> ChainTables:
    """The inputs that ``store`` has written; they keep their month as a column."""
    return ChainTables(
        **{t: spark.table(f"{database}.{TABLE_NAMES[t]}") for t in required_tables(spec)}
    )


def of_months(df: DataFrame, months: list) -> DataFrame:
    """Rows of the given months (their first days; None for rows without a time).

    A filter on the time for any table, which readers push down, and one on the month for
    tables that are partitioned by it.
    """
    at = F.col("block_timestamp")
    known = sorted({m for m in months if m is not None})
    wanted = at.isNull() if None in months else F.lit(False)
    for first in known:
        start = F.lit(first).cast(df.schema["block_timestamp"].dataType)
        end = F.add_months(F.lit(first), 1).cast(df.schema["block_timestamp"].dataType)
        wanted = wanted | ((at >= start) & (at < end))
    if MONTH in df.columns:
        listed = F.col(MONTH).isin(known) if known else F.lit(False)
        df = df.filter(listed | F.col(MONTH).isNull() if None in months else listed)
    return df.filter(wanted)
