"""From candidate distances to predictions for every ``(k, d, v)``.

A ring is the part of the candidates that one step of ``v`` adds. The nearest
``max(k)`` of each ring are kept first; the neighbours of a ``v`` are the nearest of
its rings together. So no candidate is copied once per ``v`` before the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Distance of an unusable candidate, mark of the query's own slot.
MAX_DISTANCE = 999.0
OWN_SLOT = -2.0

# Distances are ordered by so many decimal places, so that sums in another order do
# not turn neighbours around.
PLACES = 9

# A total order: distance first, then the order 0, -1, 1, -2, ... of the shifts.
NEAREST_FIRST = ["dist", "shift_rank", "season"]


def ring_of(shift: Column, v: list[int]) -> Column:
    """How many of the sorted ``v`` are too small for this shift."""
    return sum((F.when(F.abs(shift) > one, 1).otherwise(0) for one in sorted(v)),
               F.lit(0)).cast("int")


def rounded(dist: Column) -> Column:
    return F.floor(dist * 10.0**PLACES + 0.5) / 10.0**PLACES


def per_v(nearest: DataFrame, v: list[int]) -> DataFrame:
    """The rows of each ring once per ``v`` that holds the ring."""
    v = sorted(v)
    v_of_ring = F.slice(F.array(*map(F.lit, v)), F.col("ring") + 1, len(v))
    return nearest.select("series_id", "q_idx", "d", F.explode(v_of_ring).alias("v"), *NEAREST_FIRST, "h_value")


def nearest_per_ring(distances: DataFrame, k: list[int], v: list[int]) -> DataFrame:
    """The ``max(k)`` nearest candidates per query, ``d`` and ring, once per ``v``.

    Spark cuts to ``max(k)`` rows per group before it shuffles them.
    """
    v = sorted(v)
    inside = distances.where(F.abs(F.col("shift")) <= v[-1]).withColumn(
        "ring", ring_of(F.col("shift"), v)).withColumn("dist", rounded(F.col("dist")))
    group = Window.partitionBy("series_id", "q_idx", "d", "ring").orderBy(*NEAREST_FIRST)
    ranked = inside.withColumn("_rn", F.row_number().over(group)).where(F.col("_rn") <= max(k))
    return per_v(ranked, v)


def with_empty(nearest: DataFrame, queries: DataFrame, d: list[int], v: list[int]) -> DataFrame:
    """Add one row without distance per query, ``d`` and ``v``, so that none is lost."""
    per_d = queries.select("series_id", "q_idx", F.explode(F.array(*map(F.lit, d))).alias("d"))
    empty = per_d.select(
        "series_id", "q_idx", "d", F.explode(F.array(*map(F.lit, v))).alias("v"),
        F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("shift_rank"),
        F.lit(None).cast("int").alias("season"), F.lit(None).cast("double").alias("h_value"))
    return nearest.select(*empty.columns).unionByName(empty)


def predict(nearest: DataFrame, queries: DataFrame, k: list[int], d: list[int],
            v: list[int]) -> DataFrame:
    """Mean of the nearest ``k`` for every ``(k, d, v)``; fewer than ``k``: of those.

    ``nearest`` holds at least the ``max(k)`` nearest per query, ``d`` and ``v``.
    A query without any candidate gets NULL.
    """
    order = [F.col("dist").asc_nulls_last(), *NEAREST_FIRST[1:]]
    group = Window.partitionBy("series_id", "q_idx", "d", "v")
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        with_empty(nearest, queries, d, v)
        .withColumn("rn", F.row_number().over(group.orderBy(*order)))
        .where(F.col("rn") <= max(k) + 1)
        .withColumn("prediction", F.avg("h_value").over(upto))
        .withColumn("last", F.greatest(F.count("dist").over(group), F.lit(1)))
    )
    # Row ``rn`` answers k = rn; the last row also answers every larger k.
    answered = F.filter(
        F.array(*map(F.lit, sorted(k))),
        lambda one: (one == F.col("rn")) | ((F.col("rn") == F.col("last")) & (one > F.col("rn"))))
    return ranked.where("rn <= last").select(
        "series_id", "q_idx", F.explode(answered).alias("k"), "d", "v", "prediction")


def asked_grid(queries: DataFrame, k: list[int], d: list[int], v: list[int]) -> DataFrame:
    """``series_id, q_idx, d, v, ks``: what is asked for every query of a grid."""
    every = lambda values: F.explode(F.array(*map(F.lit, values)))
    return queries.select("series_id", "q_idx", every(d).alias("d")).select(
        "series_id", "q_idx", "d", every(v).alias("v"), F.array(*map(F.lit, sorted(k))).alias("ks"))


def predict_lists(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """Mean of the nearest ``k`` for every ``k`` of ``asked(series_id, q_idx, d, v, ks)``.

    ``lists`` holds candidates, nearest first, from any number of tiles; together they hold
    the nearest ``max(ks)``. Fewer than ``k``: the mean of those; none: NULL. Lists are
    merged whole, so a candidate is no row of its own.
    """
    nothing = F.array().cast(lists.schema["near"].dataType)
    both = lists.select("series_id", "q_idx", "d", "v", "near", F.lit(None).cast("array<int>").alias("ks")).unionByName(
        asked.select("series_id", "q_idx", "d", "v", nothing.alias("near"), "ks"))
    # The order of the fields is that of the neighbours: distance, shift, season.
    merged = both.groupBy("series_id", "q_idx", "d", "v").agg(
        F.array_sort(F.flatten(F.collect_list("near"))).alias("near"), F.max("ks").alias("ks"))
    n = F.least(F.col("k"), F.size("value"))
    total = F.aggregate(F.slice("value", 1, n), F.lit(0.0), lambda acc, x: acc + x)
    return merged.select("series_id", "q_idx", F.explode("ks").alias("k"), "d", "v", F.col("near.h_value").alias("value")).select(
        "series_id", "q_idx", "k", "d", "v", F.when(n > 0, total / n).alias("prediction"))


def reference_distances(distances: DataFrame, sentinel: float = -1.0) -> DataFrame:
    """Treat unusable candidates as very far ones that keep their missing mark.

    They enter a mean when there are fewer than ``k`` usable ones.
    """
    own = F.col("h_idx") == F.col("q_idx")
    return distances.withColumn("dist", F.coalesce("dist", F.lit(MAX_DISTANCE))).withColumn(
        "h_value", F.coalesce("h_value", F.when(own, OWN_SLOT).otherwise(sentinel)))
