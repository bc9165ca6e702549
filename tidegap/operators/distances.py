"""Gap-sensitive window distance between queries and their seasonal candidates.

Three plans give the same rows:

``joins``   one row per window offset, two equi-joins, ``row_number``; for narrow
            windows, and the shape a plain SQL text has too
``arrays``  window slices compared by higher-order functions
``tiles``   the tiles of ``arrays`` handed to an Arrow function that also keeps only
            the nearest neighbours per tile (:mod:`tidegap.operators.tiles`)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegap.cluster import task_count
from tidegap.functions.windows import joint_offsets, ratio, shift_rank, side_sums
from tidegap.operators.candidates import knn_candidates
from tidegap.operators.season_blocks import Shape, tile_sides
from tidegap.operators.series import slot_of_season
from tidegap.operators.tiles import l2_tiles

CANDIDATE = ["h_idx", "shift", "shift_rank", "season", "h_value"]


def _offset_rows(cands: DataFrame, series: DataFrame, width: int) -> DataFrame:
    """Jointly observed offsets of every candidate with an observed pivot."""
    q_vals = series.select("series_id", F.col("idx").alias("q_at"), F.col("value").alias("q_val"))
    h_vals = series.select("series_id", F.col("idx").alias("h_at"), F.col("value").alias("h_val"))
    sides = F.explode(F.array(F.lit(-1), F.lit(1)))
    return (
        cands.where(F.col("h_value").isNotNull())
        .select("series_id", "q_idx", *CANDIDATE, sides.alias("side"))
        .withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(width))))
        .withColumn("q_at", F.col("q_idx") + F.col("side") * F.col("j"))
        .withColumn("h_at", F.col("h_idx") + F.col("side") * F.col("j"))
        .where("h_at <> q_idx")
        .join(q_vals.where("q_val IS NOT NULL"), ["series_id", "q_at"])
        .join(h_vals.where("h_val IS NOT NULL"), ["series_id", "h_at"])
        .withColumn("diff", F.abs(F.col("q_val") - F.col("h_val")))
    )


def gap_distance_joins(queries: DataFrame, series: DataFrame, shape: Shape,
                       d: list[int]) -> DataFrame:
    """Rows ``series_id, q_idx, <candidate>, d, dist`` by joins on the offsets."""
    cands = knn_candidates(queries, series, shape.period, shape.width, shape.max_shift)
    by_side = Window.partitionBy("series_id", "q_idx", "h_idx", "shift", "side").orderBy("j")
    keys = ["series_id", "q_idx", *CANDIDATE]
    near = _offset_rows(cands, series, shape.width).withColumn("rn", F.row_number().over(by_side))
    per_side = (
        near.where(F.col("rn") <= max(d))
        .withColumn("d", F.explode(F.filter(F.array(*map(F.lit, d)), lambda x: x >= F.col("rn"))))
        .groupBy(*keys, "side", "d")
        .agg((F.max("j") + F.min("j")).alias("ends"), F.count(F.lit(1)).alias("n"),
             F.sum("j").alias("sj"), F.sum("diff").alias("sd"),
             F.sum(F.col("j") * F.col("diff")).alias("sjd"))
    )
    return per_side.groupBy(*keys, "d").agg(
        (F.sum(F.col("ends") * F.col("sd") - F.col("sjd"))
         / F.sum(F.col("ends") * F.col("n") - F.col("sj"))).alias("dist"))


def _array_candidates(queries: DataFrame, series: DataFrame, shape: Shape) -> DataFrame:
    """Candidates next to the arrays their windows are slices of."""
    left, right, _ = tile_sides(queries, series, shape)
    at = F.lit(shape.margin + 1) + F.col("slot")
    # Few bytes and much work: leave the number of partitions to no estimate of bytes.
    left = left.repartition(task_count(series.sparkSession), "series_id", "qc", "hc")
    windows = left.withColumn("slot", F.explode("slots")).select(
        "series_id", "qc", "hc", (F.col("q_season") * shape.period + F.col("slot")).alias("q_idx"),
        F.reverse(F.slice("q_vals", at - shape.width, shape.width)).alias("q_left"),
        F.slice("q_vals", at + 1, shape.width).alias("q_right"))
    met = windows.join(right, ["series_id", "qc", "hc"])
    shifts = F.sequence(F.lit(-shape.max_shift), F.lit(shape.max_shift))
    start = F.col("season").cast("bigint") * shape.period
    h_idx = start + slot_of_season("q_idx", shape.period) + F.col("shift")
    return (
        met.withColumn("shift", F.explode(shifts))
        .withColumn("h_idx", h_idx)
        .where((F.col("h_idx") >= shape.width) & (F.col("h_idx") + shape.width <= F.col("n_slots") - 1))
        .withColumn("shift_rank", shift_rank(F.col("shift")))
        .withColumn("centre", (F.col("h_idx") - start + shape.margin).cast("int"))
        .withColumn("h_value", F.when(F.col("h_idx") != F.col("q_idx"),
                                      F.get("vals", F.col("centre"))))
    )


_SIDES = {"left": -1, "right": 1}


def _q_at(side: str):
    return lambda j: F.get(f"q_{side}", j - 1)


def _h_at(side: str):
    return lambda j: F.get("vals", F.col("centre") + _SIDES[side] * j)


def _joint(side: str, width: int, keep: int) -> Column:
    own = _SIDES[side] * (F.col("q_idx") - F.col("h_idx"))
    return joint_offsets(_q_at(side), _h_at(side), width, keep, own)


def _with_kept(cands: DataFrame, width: int, keep: int) -> DataFrame:
    """Add the nearest joint offsets per side, looking far only where it is needed."""
    near = min(width, 2 * keep)
    for side in _SIDES:
        cands = cands.withColumn(f"kept_{side}", _joint(side, near, keep))
    if near < width:
        for side in _SIDES:
            kept = f"kept_{side}"
            cands = cands.withColumn(kept, F.when(F.size(kept) == keep, F.col(kept)).otherwise(
                _joint(side, width, keep)))
    return cands


def _array_distances(d: list[int]) -> list[Column]:
    out = []
    for one in d:
        sides = [side_sums(F.col(f"kept_{s}"), _q_at(s), _h_at(s), one) for s in _SIDES]
        out.append(ratio([a for a, _ in sides], [b for _, b in sides]))
    return out


def gap_distance_arrays(queries: DataFrame, series: DataFrame, shape: Shape,
                        d: list[int], keep_unusable: bool = False) -> DataFrame:
    """Same rows as :func:`gap_distance_joins`, from array slices.

    ``keep_unusable`` also returns candidates that are missing or share no offset
    with the query; their distance is NULL.
    """
    cands = _array_candidates(queries, series, shape)
    if not keep_unusable:
        cands = cands.where("h_value IS NOT NULL")
    kept = _with_kept(cands, shape.width, max(d))
    usable = F.col("h_value").isNotNull()
    dists = F.array(*[
        F.struct(F.lit(one).alias("d"), F.when(usable, dist).alias("dist"))
        for one, dist in zip(d, _array_distances(d))])
    rows = kept.select("series_id", "q_idx", *CANDIDATE, F.explode(dists).alias("x")).select(
        "series_id", "q_idx", *CANDIDATE, "x.d", "x.dist")
    # Asked after the explode, so that the offsets are searched once per candidate.
    return rows if keep_unusable else rows.where("dist IS NOT NULL")


def l2_distance(queries: DataFrame, series: DataFrame, shape: Shape) -> DataFrame:
    """Plain Euclidean distance over all jointly observed offsets of the window.

    Made in the tiles, from one running sum per pair of seasons and shift.
    """
    return l2_tiles(queries, series, shape)


def l2_distance_arrays(queries: DataFrame, series: DataFrame, shape: Shape) -> DataFrame:
    """Same rows as :func:`l2_distance`, from array slices."""
    cands = _array_candidates(queries, series, shape).where("h_value IS NOT NULL")
    for side in _SIDES:
        cands = cands.withColumn(f"kept_{side}", _joint(side, shape.width, shape.width))

    def squares(side):
        q_at, h_at = _q_at(side), _h_at(side)
        return F.aggregate(f"kept_{side}", F.lit(0.0), lambda acc, j: acc + (
            (q_at(j) - h_at(j)) * (q_at(j) - h_at(j))))

    shared = (F.size("kept_left") > 0) | (F.size("kept_right") > 0)
    # Asked after the explode, so that the offsets are searched once per candidate.
    dist = F.when(shared, F.sqrt(squares("left") + squares("right")))
    return cands.select("series_id", "q_idx", *CANDIDATE, F.explode(F.array(dist)).alias("dist")).where(
        "dist IS NOT NULL")
