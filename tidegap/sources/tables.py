"""Reading and writing: count tables, masked variants, results and scores."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The column names of the count tables and of the results.
TIME, COUNT = "COUNT_TIME", "NUM_TOTAL"
RESULT = ["series_id", "train_index", "k", "d", "v", "prediction", "err"]


def read_counts(spark: SparkSession, path: str | list[str], ts: str = TIME, value: str = COUNT,
                series: str | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of count files, and the lines that are none: ``reason, line, file``.

    The rows have time, value and, if named, series. A line with another number of cells
    than the header has is rejected (``columns``), one without a readable time (``time``),
    and one whose count is there but no number (``count``); an empty count is a missing
    one. Every line is in one of the two tables, and none ends the job. Times are read as
    UTC whatever the session time zone. ``columns`` names the cells of files without a
    header; otherwise the header of the first file does.
    """
    names = columns or spark.read.option("header", True).csv(path).columns
    # All cells are read for both tables, so that both judge a line alike.
    bad = "_unreadable"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    raw = (spark.read.schema(schema).option("header", columns is None).option("columnNameOfCorruptRecord", bad)
           .option("columnPruning", False).csv(path))
    time, count = F.col(ts).try_cast("timestamp_ntz"), F.col(value).try_cast("double")
    reason = (F.when(F.col(bad).isNotNull(), "columns").when(time.isNull(), "time")
              .when(F.col(value).isNotNull() & count.isNull(), "count"))
    judged = raw.select("*", reason.alias("_reason"), F.col("_metadata.file_path").alias("_file"))
    rows = judged.where("_reason IS NULL").select(
        *([series] if series else []), time.alias(ts), count.alias(value))
    rejects = judged.where("_reason IS NOT NULL").select(
        F.col("_reason").alias("reason"), F.coalesce(F.col(bad), F.to_csv(F.struct(*names))).alias("line"),
        F.col("_file").alias("file"))
    return rows, rejects


def read_counts_csv(spark: SparkSession, path: str | list[str], ts: str = TIME,
                    value: str = COUNT, series: str | None = None) -> DataFrame:
    """The rows of :func:`read_counts`; lines that are none are left out."""
    return read_counts(spark, path, ts, value, series)[0]


def utc_text(ts: Column) -> Column:
    """A timestamp as UTC text; fractions of a second only where there are any."""
    seconds = F.unix_micros(ts).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")
    return (F.lit("1970-01-01").cast("timestamp_ntz")
            + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string")


def write_counts_csv(series: DataFrame, path: str, missing: float = -1.0,
                     series_column: str | None = None) -> None:
    """Time and value of every slot in time order; a missing one gets the mark.

    With ``series_column`` the series goes along under this name and the order is by
    series, then time. The files of the folder are in order too.
    """
    first = [F.col("series_id").alias(series_column)] if series_column else []
    ordered = series.orderBy(*(["series_id"] if series_column else []), "ts")
    ordered.select(*first, utc_text(F.col("ts")).alias(TIME), F.coalesce("value", F.lit(missing)).alias(COUNT),
                   ).write.option("header", True).csv(path)


def write_variant(series: DataFrame, path: str, ratio: float) -> None:
    """Add a masked series to a folder with one partition per missing ratio."""
    series.withColumn("missing_ratio", F.lit(ratio)).write.mode("append").partitionBy(
        "missing_ratio").parquet(path)


def read_variant(spark: SparkSession, path: str, ratio: float) -> DataFrame:
    """The series of one ratio; other partitions are not read."""
    return spark.read.parquet(path).where(F.col("missing_ratio") == ratio).drop("missing_ratio")


def write_results(results: DataFrame, path: str, ratio: float, distance: str = "gap",
                  started: datetime | None = None) -> None:
    """Write the results of one ratio; when and how they were made goes with them.

    A repeated run takes the place of an earlier one on the same ratio.
    """
    started = started or datetime.now(timezone.utc)
    results.select(
        *RESULT, F.lit(distance).alias("distance"),
        F.lit(started.strftime("%Y%m%d_%H%M")).alias("started"),
        F.lit(ratio).alias("missing_ratio"),
    ).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "missing_ratio").parquet(path)


def ratio_tag(path: Column) -> Column:
    """Two digits of the missing ratio in a path: 0.05 gives 05, 0.1 gives 10."""
    return F.rpad(F.regexp_extract(path, r"missing_ratio=0\.(\d+)", 1), 2, "0")


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """All rows of several result folders, with ``ratio_tag`` of the file they lie in."""
    parts = [
        spark.read.parquet(path).select("*", ratio_tag(F.col("_metadata.file_path")).alias("ratio_tag"))
        for path in paths
    ]
    rows = reduce(DataFrame.unionByName, parts)
    whole = {"train_index": "bigint", "k": "int", "d": "int", "v": "int"}
    return rows.select(*[F.col(c).cast(whole[c]).alias(c) if c in whole else F.col(c)
                         for c in rows.columns])


def write_of_ratio(df: DataFrame, path: str, ratio: float) -> DataFrame:
    """Write a table as the part of one missing ratio, in place of an earlier one; hand it over."""
    df.withColumn("missing_ratio", F.lit(ratio)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("missing_ratio").parquet(path)
    return read_variant(df.sparkSession, path, ratio)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write a score, best-row or imputed table once and hand over the written copy."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
