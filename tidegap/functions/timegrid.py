"""Timestamps to slot numbers on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000
DAY_US = 24 * HOUR_US


def epoch_micros(df: DataFrame, ts_col: str) -> Column:
    """Microseconds since 1970-01-01 of a date or timestamp column.

    A timestamp without zone is read as UTC, so the result does not depend on
    the session time zone.
    """
    dtype = df.schema[ts_col].dataType
    ts = F.col(ts_col)
    day_us, hour_us, minute_us = (F.lit(x).cast("bigint") for x in (DAY_US, HOUR_US, MINUTE_US))
    if isinstance(dtype, T.DateType):
        return F.unix_date(ts) * day_us
    if isinstance(dtype, T.TimestampNTZType):
        second = F.extract(F.lit("SECOND"), ts)
        return (
            F.unix_date(F.to_date(ts)) * day_us
            + F.hour(ts) * hour_us
            + F.minute(ts) * minute_us
            + (second * F.lit(1_000_000)).cast("bigint")
        )
    return F.unix_micros(ts)


def floor_div(x: Column, by) -> Column:
    """Integer division that rounds down, also below zero."""
    by = by if isinstance(by, Column) else F.lit(by)
    return F.call_function("div", x - F.pmod(x, by), by)


def div(x: str | Column, by) -> Column:
    """Integer division of numbers that are not negative."""
    x = F.col(x) if isinstance(x, str) else x
    return F.call_function("div", x, by if isinstance(by, Column) else F.lit(by))


def slot_number(df: DataFrame, ts_col: str, step_us: int) -> Column:
    return floor_div(epoch_micros(df, ts_col), F.lit(step_us).cast("bigint"))
