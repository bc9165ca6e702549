"""Predictions back into the series, and the series back into the rows it came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fill(series: DataFrame, predictions: DataFrame) -> DataFrame:
    """``series_id, idx, ts, value, imputed, is_imputed``; missing values are filled.

    ``predictions`` has at most one row per missing slot: ``series_id, q_idx,
    prediction``. Only missing slots are joined; the others pass by.
    """
    found = predictions.select("series_id", F.col("q_idx").alias("idx"),
                               F.col("prediction").alias("imputed"))
    filled = series.where(F.col("value").isNull()).join(found, ["series_id", "idx"], "left").select(
        "series_id", "idx", "ts", F.col("imputed").alias("value"), "imputed",
        F.col("imputed").isNotNull().alias("is_imputed"))
    kept = series.where(F.col("value").isNotNull()).select(
        "series_id", "idx", "ts", "value", F.lit(None).cast("double").alias("imputed"),
        F.lit(False).alias("is_imputed"))
    return kept.unionByName(filled)


def write_back(untrimmed: DataFrame, filled: DataFrame) -> DataFrame:
    """Imputed values of the filled series on the missing slots of the untrimmed one.

    The time of a slot joins the two, so slots that were trimmed keep their value.
    """
    new = filled.where("is_imputed").select("series_id", "ts", F.col("value").alias("new"))
    gaps = untrimmed.where(F.col("value").isNull()).join(new, ["series_id", "ts"], "left").select(
        "series_id", "idx", "ts", F.col("new").alias("value"),
        F.col("new").isNotNull().alias("is_imputed"))
    kept = untrimmed.where(F.col("value").isNotNull()).select(
        "series_id", "idx", "ts", "value", F.lit(False).alias("is_imputed"))
    return kept.unionByName(gaps)


def remaining_missing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing slots per series before and after the write-back."""
    def count(df, name):
        return df.groupBy("series_id").agg(F.count_if(F.col("value").isNull()).alias(name))

    return count(before, "missing_before").join(count(after, "missing_after"), "series_id")
