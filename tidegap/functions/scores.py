"""Error measures as aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rmse(err) -> Column:
    err = F.col(err) if isinstance(err, str) else err
    return F.sqrt(F.avg(err * err))


def mae(err) -> Column:
    err = F.col(err) if isinstance(err, str) else err
    return F.avg(F.abs(err))
