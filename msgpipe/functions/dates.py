"""Epoch milliseconds to UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last millisecond of the years 1 to 9999, UTC.
MIN_MILLIS = -62135596800000
MAX_MILLIS = 253402300799999


def epoch_millis(text: Column) -> Column:
    """Whole number as text to BIGINT; NULL for anything else."""
    return text.try_cast("bigint")


def millis_to_timestamp(millis: Column) -> Column:
    """NULL outside the years 1 to 9999, where no timestamp is defined."""
    return F.when(millis.between(MIN_MILLIS, MAX_MILLIS), F.timestamp_millis(millis))


def millis_error(raw: Column, millis: Column, name: str = "internalDate") -> Column:
    """Message for a value :func:`epoch_millis` or the timestamp range refuses."""
    return (
        F.when(millis.isNull(), F.concat(F.lit(f"{name} is not an integer: '"),
                                         F.coalesce(raw, F.lit("")), F.lit("'")))
        .when(~millis.between(MIN_MILLIS, MAX_MILLIS),
              F.concat(F.lit(f"{name} is out of range: "), millis.cast("string")))
    )
