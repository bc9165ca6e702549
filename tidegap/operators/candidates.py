"""Seasonal candidates as rows: same place in other seasons, plus or minus a shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import task_count
from tidegap.functions.windows import shift_rank
from tidegap.operators.series import attach_facts, season_stats, slot_of_season


def candidate_slots(queries: DataFrame, series: DataFrame, period: int, width: int,
                    max_shift: int) -> DataFrame:
    """All ``(query, shift, season)`` with the slot they point at.

    Seasons run from the second to the last but one complete season. A candidate
    whose window of ``width`` slots leaves the series is dropped. The rows come
    out of two explodes; no join makes them.
    """
    stats = season_stats(series, period).where("n_seasons >= 3").select(
        "series_id", "n_slots", "n_seasons", F.lit(0).cast("bigint").alias("_lo"),
        (F.col("n_slots") - 1).alias("_hi"))
    h_idx = (F.col("season").cast("bigint") * period + slot_of_season("q_idx", period)
             + F.col("shift"))
    return (
        attach_facts(queries, stats, "q_idx", "_lo", "_hi")
        # A query is a small row that grows into many; do not leave it to its size.
        .repartition(task_count(series.sparkSession), "series_id", "q_idx")
        .withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
        .withColumn("season", F.explode(F.sequence(F.lit(1), (F.col("n_seasons") - 2).cast("int"))))
        .withColumn("h_idx", h_idx)
        .where((F.col("h_idx") >= width) & (F.col("h_idx") + width <= F.col("n_slots") - 1))
        .select(*queries.columns, "h_idx", "shift",
                shift_rank(F.col("shift")).alias("shift_rank"), "season")
    )


def knn_candidates(queries: DataFrame, series: DataFrame, period: int, width: int,
                   max_shift: int) -> DataFrame:
    """:func:`candidate_slots` with the candidate's own value ``h_value``.

    The query counts as missing, also where it turns up as its own candidate.
    """
    pivots = series.select("series_id", F.col("idx").alias("h_idx"), F.col("value").alias("h_value"))
    return candidate_slots(queries, series, period, width, max_shift).join(
        pivots, ["series_id", "h_idx"]
    ).withColumn("h_value", F.when(F.col("h_idx") != F.col("q_idx"), F.col("h_value")))
