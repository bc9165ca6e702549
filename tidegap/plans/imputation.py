"""Fill every missing slot of a series with a fixed ``(k, d, v)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin
from tidegap.operators.filling import fill
from tidegap.operators.neighbours import predict_lists
from tidegap.operators.season_blocks import OWN, Shape, grouped
from tidegap.operators.series import attach_facts, missing_slots, season_stats
from tidegap.operators.tiles import nearest_lists
from tidegap.plans.grid import CHOSEN, Grid
from tidegap.plans.search import knn_predict


def impute(series: DataFrame, period: int, k: int = CHOSEN.k[0], d: int = CHOSEN.d[0],
           v: int = CHOSEN.v[0], width: int | None = None, form: str = "tiles") -> DataFrame:
    """The series with its gaps filled: ``value, imputed, is_imputed``.

    All missing slots are asked for, those near the ends too; one without any usable
    candidate stays NULL.
    """
    series = pin(series, "series")
    queries = missing_slots(series).select("series_id", F.col("idx").alias("q_idx"))
    grid = Grid([k], [d], [v])
    return fill(series, knn_predict(queries, series, period, grid, width, form=form))


def impute_by_best(series: DataFrame, period: int, best: DataFrame,
                   width: int | None = None) -> DataFrame:
    """Fill every series with its own ``(k, d, v)`` from ``best(series_id, k, d, v)``.

    The triples travel with the queries, so all series are filled in one search, however
    many triples there are; three numbers come to the driver. A series without a best
    triple stays as it is. ``width`` is that of :func:`tidegap.plans.grid.Grid.shape`.
    """
    series = pin(series.withColumn("value", F.when(~F.isnan("value"), F.col("value"))), "series")
    side = F.lit(width) if width else F.col("d") + period // 2
    own = best.select("series_id", *[F.col(c).cast("int").alias(c) for c in ("k", "d", "v")], side.cast("int").alias("width"))
    ends = season_stats(series, period).select(
        "series_id", F.lit(0).cast("bigint").alias("_lo"), (F.col("n_slots") - 1).alias("_hi"))
    gaps = missing_slots(series).select("series_id", F.col("idx").alias("q_idx"))
    queries = pin(attach_facts(gaps, own.join(ends, "series_id"), "q_idx", "_lo", "_hi").select(
        "series_id", "q_idx", *OWN), "queries")
    widest = queries.agg(F.max("width"), F.max("v")).first()
    if widest[0] is None:
        return fill(series, queries.select("series_id", "q_idx", F.lit(None).cast("double").alias("prediction")))
    lists = nearest_lists(queries, series, grouped(Shape(period, *widest), queries))
    asked = queries.select("series_id", "q_idx", "d", "v", F.array("k").alias("ks"))
    return fill(series, predict_lists(lists, asked))
