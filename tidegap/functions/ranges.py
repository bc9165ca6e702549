"""Geometric ranges as array columns, for parameter grids that follow the data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 2**62 is the last power of two a BIGINT holds.
_MAX_STEPS = 62


def _powers(start: Column, base: int) -> Column:
    steps = F.sequence(F.lit(0), F.lit(_MAX_STEPS))
    return F.transform(steps, lambda i: start * F.pow(F.lit(float(base)), i))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def exp_range(start, end, base: int = 2) -> Column:
    """``start, start*base, ...`` while smaller than ``end``."""
    start, end = _col(start).cast("double"), _col(end).cast("double")
    return F.filter(_powers(start, base), lambda x: x < end).cast("array<bigint>")


def exp_range_inc(start, end, base: int = 2) -> Column:
    """``start, start*base, ...`` while not larger than ``end``."""
    start, end = _col(start).cast("double"), _col(end).cast("double")
    return F.filter(_powers(start, base), lambda x: x <= end).cast("array<bigint>")


def exp_range_cover(start, end, base: int = 2) -> Column:
    """:func:`exp_range` and one element more, the first that reaches ``end``."""
    start, end = _col(start).cast("double"), _col(end).cast("double")
    below = F.filter(_powers(start, base), lambda x: x < end)
    cover = F.filter(_powers(start, base), lambda x: x >= end)
    return F.concat(below, F.slice(cover, 1, 1)).cast("array<bigint>")
