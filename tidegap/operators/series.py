"""Series on a regular slot grid: build, trim, measure.

A series table has the columns ``series_id, idx, ts, value``: one row per slot,
``idx`` counted from a whole season, ``value`` NULL where the slot is missing.
Every step splits a series by blocks of slots, so one very long series spreads
over the cluster like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegap.cluster import task_count
from tidegap.functions.timegrid import div, floor_div, slot_number

# The series of rows whose key is NULL.
NO_SERIES = "(null)"

# Slots per block wherever a series is cut for distribution.
BLOCK = 4096


def observed(value: str | Column) -> Column:
    """The value, or NULL for NaN and the negative numbers that mark a missing one."""
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    return F.when((value >= 0) & ~F.isnan(value), value)


def attach_facts(rows: DataFrame, facts: DataFrame, position: str, lo: str, hi: str,
                 block: int = BLOCK) -> DataFrame:
    """Join one row of facts per series to its rows, without a hot key.

    ``facts`` is repeated for each block of positions between its columns ``lo``
    and ``hi``; the join runs on series and block.
    """
    spread = facts.withColumn("_block", F.explode(F.sequence(div(lo, block), div(hi, block))))
    return (
        rows.withColumn("_block", div(position, block))
        .join(spread, ["series_id", "_block"])
        .drop("_block")
    )


def build_series(rows: DataFrame, ts: str, step_us: int, period: int, value: Column,
                 series: str | Column | None = None, trim: bool = False) -> DataFrame:
    """Aggregate raw rows per slot and lay them on a gap-free grid.

    ``value`` is an aggregate column; its NULL means missing, as does a slot
    without rows. NaN is missing too. ``series`` names the column that tells series
    apart; without it there is a single one, and rows where it is NULL are the series
    ``NO_SERIES``. Rows without a time have no slot; :func:`rows_without_time` counts
    them. Slot 0 starts at the last whole season (counted from
    1970-01-01 UTC) that is not after the first row. ``trim=True`` gives the
    result of :func:`trim_series` without building the trimmed rows first.
    """
    if series is None:
        series = F.lit("all")
    series = F.col(series) if isinstance(series, str) else series
    slotted = rows.select(
        "*", F.coalesce(series.cast("string"), F.lit(NO_SERIES)).alias("series_id"), slot_number(rows, ts, step_us).alias("slot")
    ).where(F.col("slot").isNotNull())
    counts = slotted.groupBy("series_id", "slot").agg(value.cast("double").alias("value")).withColumn(
        "value", F.when(~F.isnan("value"), F.col("value")))
    slot = F.col("slot")
    if trim:
        # Reads the counts, whose shuffle the join below uses again.
        seen = counts.where(F.col("value").isNotNull())
        start = F.col("lo") + F.pmod(-F.col("lo"), F.lit(period))
    else:
        # Only two columns and no shuffle of the rows.
        seen = slotted
        start = F.col("lo") - F.pmod(F.col("lo"), F.lit(period))
    bounds = seen.groupBy("series_id").agg(F.min(slot).alias("lo"), F.max(slot).alias("hi"))
    bounds = bounds.withColumn("origin", start)
    if trim:
        bounds = bounds.withColumn("lo", F.col("origin")).where("lo <= hi")
    block = F.col("block")
    grid = (
        bounds.withColumn("block", F.explode(F.sequence(floor_div(F.col("lo"), BLOCK),
                                                        floor_div(F.col("hi"), BLOCK))))
        .repartition(task_count(rows.sparkSession), "series_id", "block")
        .select("series_id", "origin",
                F.explode(F.sequence(F.greatest("lo", block * BLOCK),
                                     F.least("hi", block * BLOCK + (BLOCK - 1)))).alias("slot"))
    )
    return grid.join(counts, ["series_id", "slot"], "left").select(
        "series_id",
        (slot - F.col("origin")).alias("idx"),
        F.timestamp_micros(slot * F.lit(step_us).cast("bigint")).alias("ts"),
        "value",
    )


def rows_without_time(rows: DataFrame, ts: str) -> int:
    """How many rows :func:`build_series` cannot place; one number comes to the driver."""
    return rows.where(F.col(ts).isNull()).count()


def trim_series(series: DataFrame, period: int) -> DataFrame:
    """Drop missing ends and start at the first whole season; ``idx`` starts at 0."""
    seen = series.where(F.col("value").isNotNull())
    bounds = (
        seen.groupBy("series_id")
        .agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
        .withColumn("start", (F.ceil(F.col("first") / period) * period).cast("bigint"))
        .where("start <= last")
        .select("series_id", "start", "last")
    )
    return (
        attach_facts(series, bounds, "idx", "start", "last")
        .where(F.col("idx").between(F.col("start"), F.col("last")))
        .select("series_id", (F.col("idx") - F.col("start")).alias("idx"), "ts", "value")
    )


def missing_slots(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNull()).select("series_id", "idx", "ts")


def observed_slots(series: DataFrame) -> DataFrame:
    return series.where(F.col("value").isNotNull())


def missing_ratio(series: DataFrame, target: float = 0.9) -> DataFrame:
    """Missing slots per series and the share still to mask to reach ``target``."""
    absent = F.col("value").isNull()
    ratio = F.count_if(absent) / F.count(F.lit(1))
    return series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_slots"),
        F.count_if(absent).alias("n_missing"),
        ratio.alias("missing_ratio"),
        (F.lit(target) - ratio).alias("added_missing_ratio"),
    )


def season_stats(series: DataFrame, period: int) -> DataFrame:
    """Length, complete seasons and the index range hold-out points come from."""
    stats = series.groupBy("series_id").agg(
        (F.max("idx") + 1).alias("n_slots"),
        F.count("value").alias("n_observed"),
    )
    seasons = div("n_slots", period)
    return stats.select(
        "series_id", "n_slots", "n_observed",
        seasons.alias("n_seasons"),
        slot_of_season(F.col("n_slots") - 1, period).alias("last_slot"),
        F.lit(period).cast("bigint").alias("train_min_idx"),
        (period * (seasons - 1) - 1).alias("train_max_idx"),
    )


def slot_of_season(idx: str | Column, period: int) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.pmod(idx, F.lit(period)).cast("int")
