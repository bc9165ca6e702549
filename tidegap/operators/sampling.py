"""Seeded sampling without replacement: hold-out points and artificial gaps.

The order of the points is the order of an md5 of seed, series and slot, so a
sample does not depend on partitioning and plain SQL gives the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegap.cluster import pin
from tidegap.operators.prefix import with_before
from tidegap.operators.series import attach_facts, observed_slots, season_stats

# Fixed value: the seed of hold-outs and masks.
SEED = 2017
_BUCKET_ROWS = 4096


def _hash_order(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("series_id"),
                             F.col("idx").cast("string")))


def _ranks(pool: DataFrame, seed: int) -> DataFrame:
    """Add ``rank`` (from 1) in the order of the hash, known only as far as a cut needs it.

    ``pool`` has ``series_id, idx, pool_size, wanted``, the last an array of cuts. A
    series is cut into ranges of the hash; a histogram tells how many rows lie below a
    range. Rows of a range that no cut falls into need no order: they get the rank of
    its first row. Only ranges with a cut are sorted, and the histogram is summed in
    blocks, so no task sees a whole series or all its ranges.
    """
    ranges = F.greatest(F.lit(1), F.floor(F.col("pool_size") / _BUCKET_ROWS))
    head = F.conv(F.substring("_h", 1, 8), 16, 10).cast("decimal(20,0)")
    keyed = pool.withColumn("_h", _hash_order(seed)).withColumn(
        "_range", F.floor(head * ranges / F.lit(1 << 32)).cast("bigint"))
    counts = pin(keyed.groupBy("series_id", "_range").agg(
        F.count(F.lit(1)).alias("_n"), F.first("wanted").alias("_cuts")), "ranges")
    hist = (
        with_before(counts, ["series_id"], "_range", "_n", "_before")
        .select("series_id", "_range", "_before", F.exists("_cuts", lambda w: (
            w > F.col("_before")) & (w < F.col("_before") + F.col("_n"))).alias("_cut"))
    )
    placed = keyed.join(hist, ["series_id", "_range"])
    inside = Window.partitionBy("series_id", "_range").orderBy("_h", "idx")
    ordered = placed.where("_cut").withColumn("rank", F.col("_before") + F.row_number().over(inside))
    whole = placed.where("NOT _cut").withColumn("rank", F.col("_before") + 1)
    return whole.unionByName(ordered).drop("_h", "_range", "_before", "_cut")


def holdout_sample(series: DataFrame, period: int, share: float = 0.05,
                   seed: int = SEED) -> DataFrame:
    """Observed points of the training range; their number is a share of all slots.

    Returns ``series_id, q_idx, truth``. The training range leaves out the first
    and the last complete season.
    """
    stats = season_stats(series, period).where("n_seasons >= 3").select(
        "series_id", "n_slots", "train_min_idx", "train_max_idx")
    observed = observed_slots(series)
    pool = (
        attach_facts(observed, stats, "idx", "train_min_idx", "train_max_idx")
        .where(F.col("idx").between(F.col("train_min_idx"), F.col("train_max_idx")))
        .select("series_id", "idx", "value",
                F.col("n_slots").alias("pool_size"),
                F.array(F.floor(F.lit(share) * F.col("n_slots"))).alias("wanted"))
    )
    return _ranks(pool, seed).where(F.col("rank") <= F.col("wanted")[0]).select(
        "series_id", F.col("idx").alias("q_idx"), F.col("value").alias("truth"))


def mask_to_ratios(series: DataFrame, ratios: list[float], seed: int = SEED) -> DataFrame:
    """The series once per ratio, in column ``ratio``, masked as :func:`mask_to_ratio` does.

    All ratios share one order of the points, so a larger ratio masks what a smaller one
    does, and more.
    """
    stats = series.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("_slots"), F.count("value").alias("pool_size"),
        F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    ratio = F.array(*[F.lit(float(r)) for r in ratios])
    gone = F.col("_slots") - F.col("pool_size")
    stats = stats.select("series_id", "_lo", "_hi", "pool_size", F.transform(
        ratio, lambda r: F.floor(r * F.col("_slots")) - gone).alias("wanted"))
    observed = attach_facts(observed_slots(series), stats, "idx", "_lo", "_hi")
    each = F.explode(F.arrays_zip(ratio.alias("ratio"), F.col("wanted").alias("upto")))
    masked = _ranks(observed, seed).select("series_id", "idx", "ts", "value", "rank", each.alias("m")).select(
        F.col("m.ratio").alias("ratio"), "series_id", "idx", "ts",
        F.when(F.col("rank") > F.col("m.upto"), F.col("value")).alias("value"))
    absent = series.where(F.col("value").isNull()).select(F.explode(ratio).alias("ratio"), "series_id", "idx", "ts", "value")
    return masked.unionByName(absent)


def mask_to_ratio(series: DataFrame, ratio: float, seed: int = SEED) -> DataFrame:
    """Set observed values to NULL until ``floor(ratio * slots)`` are missing.

    A series that already misses as many stays as it is.
    """
    return mask_to_ratios(series, [ratio], seed).drop("ratio")
