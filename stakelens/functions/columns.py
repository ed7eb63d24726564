"""Column expressions shared by the metrics. All are built-in, none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICRO = T.DecimalType(38, 0)

# Fixed values.
NEWCOMER_DAYS = 30
FIRST_BAND = "1. Top 10 validators"
MIDDLE_BAND = "2. Top 10-50 validators"
MICRO_PER_UNIT = 1e6
# At these a pattern's ``.`` stops.
LINE_ENDS = "\n\r\u0085\u2028\u2029"


def period(ts: Column | str, grain: str) -> Column:
    """First date of the day, (Monday) week or month a timestamp falls in."""
    date = F.to_date(ts)
    # trunc() on a date knows no 'day' unit and would give NULL.
    return date if grain == "day" else F.trunc(date, grain)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights passed from start to end; negative when end comes first."""
    return F.datediff(F.to_date(end), F.to_date(start))


def _line_from(value: Column, letter: str) -> Column:
    """What the pattern ``letter.*`` finds; NULL where that is nothing.

    For short values a search for characters takes a fraction of the time of a pattern.
    """
    at = F.instr(value, letter)
    found = F.when(at > 0, F.substring(value, at, F.length(value)))
    return reduce(lambda text, end: F.substring_index(text, end, 1), LINE_ENDS, found)


def denomination(value: Column | str) -> Column:
    """Text from the first ``i`` to the end of its line, else from the first ``u``, else NULL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(_line_from(value, "i"), _line_from(value, "u"))


def micro_amount(value: Column | str, denom: Column | str) -> Column:
    """Number left after removing the denomination, half up to whole micro-units.

    NULL when nothing numeric is left, so malformed values can be filtered out
    instead of failing the job.
    """
    value = F.col(value) if isinstance(value, str) else value
    denom = F.col(denom) if isinstance(denom, str) else denom
    return F.replace(value, denom, F.lit("")).try_cast(MICRO)


def units(micro: Column | str) -> Column:
    """Micro-units as a double of whole units; used at the output edge only."""
    micro = F.col(micro) if isinstance(micro, str) else micro
    return micro.cast("double") / F.lit(MICRO_PER_UNIT)


def vote_label(option: Column | str) -> Column:
    """Name of a vote option; every unknown code, and NULL, is the veto."""
    option = F.col(option) if isinstance(option, str) else option
    return (
        F.when(option == 1, "Yes")
        .when(option == 2, "Abstain")
        .when(option == 3, "No")
        .otherwise("No with veto")
    )


def tenure(debut: Column | str, date: Column | str, noun: str) -> Column:
    """New until the cutoff day after the debut (and before it), then Old."""
    return F.when(days_between(debut, date) < NEWCOMER_DAYS, f"New {noun}").otherwise(
        f"Old {noun}"
    )


def rank_band(rank: Column | str, last_band: str) -> Column:
    """Band of a rank. The bounds overlap, so rank 10 is in the first band."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return (
        F.when(rank.between(1, 10), FIRST_BAND)
        .when(rank.between(10, 50), MIDDLE_BAND)
        .otherwise(last_band)
    )


def account_address(labels: DataFrame, column: str = "raw_metadata") -> Column:
    """``account_address`` of the first metadata object, from VARIANT or JSON text."""
    path = "$[0].account_address"
    if isinstance(labels.schema[column].dataType, T.VariantType):
        return F.try_variant_get(F.col(column), path, "string")
    return F.get_json_object(F.col(column), path)


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(value, F.lit(0))
