from datetime import datetime
from decimal import Decimal

from stakelens.sources import schemas
from stakelens.sources.tables import ChainTables


def ts(text):
    return datetime.fromisoformat(text)


def tables(spark, *, wallet="tx_from", **rows):
    """ChainTables from lists of tuples, one list per input table."""
    declared = {
        "staking": schemas.STAKING,
        "msg_attributes": schemas.MSG_ATTRIBUTES,
        "votes": schemas.VOTES,
        "proposal_deposits": schemas.PROPOSAL_DEPOSITS,
        "transactions": schemas.transactions(wallet),
        "labels": schemas.LABELS,
    }
    def row(name, values):
        """Whole numbers may be given for decimals."""
        types = [field.dataType.typeName() for field in declared[name]]
        return tuple(
            Decimal(v) if kind == "decimal" and v is not None else v
            for v, kind in zip(values, types, strict=True)
        )

    return ChainTables(
        **{
            name: spark.createDataFrame([row(name, r) for r in data], declared[name])
            for name, data in rows.items()
        }
    )


def rows(df, *order):
    """Rows as a list of tuples, sorted with NULL first."""
    df = df.select(*order) if order else df
    return sorted(
        (tuple(r) for r in df.collect()),
        key=lambda row: [(v is not None, v if v is not None else 0) for v in row],
    )
