"""Schemas of the input tables, declared so that no read has to infer one."""

from __future__ import annotations

from pyspark.sql import types as T

_TS = T.StructField("block_timestamp", T.TimestampType(), False)
_TX = T.StructField("tx_id", T.StringType(), False)

STAKING = T.StructType(
    [
        _TS,
        _TX,
        T.StructField("action", T.StringType()),
        T.StructField("validator_address", T.StringType()),
        T.StructField("redelegate_source_validator_address", T.StringType()),
        T.StructField("amount", T.DecimalType(38, 0)),
        T.StructField("currency", T.StringType()),
    ]
)

MSG_ATTRIBUTES = T.StructType(
    [
        _TS,
        _TX,
        T.StructField("msg_type", T.StringType()),
        T.StructField("attribute_key", T.StringType()),
        T.StructField("attribute_value", T.StringType()),
    ]
)

VOTES = T.StructType(
    [
        _TS,
        _TX,
        T.StructField("voter", T.StringType()),
        T.StructField("proposal_id", T.LongType()),
        T.StructField("vote_option", T.IntegerType()),
        T.StructField("vote_weight", T.DoubleType()),
    ]
)

PROPOSAL_DEPOSITS = T.StructType([_TS, T.StructField("proposal_id", T.LongType())])


def transactions(wallet_column: str = "tx_from") -> T.StructType:
    return T.StructType([_TS, T.StructField(wallet_column, T.StringType())])


LABELS = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("raw_metadata", T.StringType()),
    ]
)
