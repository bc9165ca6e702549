"""Errors of predictions, their measures per parameter, and the best parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegap.cluster import pin
from tidegap.functions.scores import mae, rmse

PARAMS = ["k", "d", "v"]
# Different values that are put in order in one place, and ranges that one round makes of a larger cell.
_RANGE_VALUES, _CUTS = 1 << 16, 1024


def knn_errors(predictions: DataFrame, queries: DataFrame) -> DataFrame:
    """Signed error per query and ``(k, d, v)``: prediction minus truth."""
    return predictions.join(queries, ["series_id", "q_idx"]).select(
        "series_id", F.col("q_idx").alias("train_index"), *PARAMS, "prediction",
        (F.col("prediction") - F.col("truth")).alias("err"))


def rmse_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(rmse("err").alias("rmse"))


def mae_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(mae("err").alias("mae"))


def scores(results: DataFrame, *keys: str) -> DataFrame:
    """RMSE and MAE per ``(k, d, v)`` and what else is given, best first.

    ``n`` points had a prediction, ``n_null`` had none and enter neither measure.
    """
    return results.groupBy(*keys, *PARAMS).agg(
        rmse("err").alias("rmse"), mae("err").alias("mae"), F.count("err").alias("n"),
        F.count_if(F.col("err").isNull()).alias("n_null"),
    ).orderBy(*keys, F.col("rmse").asc_nulls_last(), *PARAMS)


def rmse_grouping_sets(results: DataFrame) -> DataFrame:
    """RMSE by ``k``, by ``d``, by ``v``, by all three and over everything.

    The rows are summed once per ``(k, d, v)``; the sets are built from those sums,
    so the large table is neither read nor multiplied five times.
    """
    sums = results.groupBy(*PARAMS).agg(
        F.sum(F.col("err") * F.col("err")).alias("se"), F.count("err").alias("n"))
    k, d, v = (F.col(c) for c in PARAMS)
    return sums.groupingSets([[k], [d], [v], [k, d, v], []], k, d, v).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sqrt(F.sum("se") / F.sum("n")).alias("rmse"))


def best_params(scored: DataFrame, *keys: str) -> DataFrame:
    """The triple with the smallest RMSE, once per ``keys``; equal ones: smallest k, d, v.

    A triple without any prediction has no RMSE and is never the best.
    """
    known = scored.where(F.col("rmse").isNotNull())
    if not keys:
        return known.orderBy("rmse", *PARAMS).limit(1).select(*PARAMS, "rmse")
    best = known.groupBy(*keys).agg(F.min(F.struct("rmse", *PARAMS)).alias("best"))
    return best.select(*keys, *[f"best.{c}" for c in PARAMS], "best.rmse")


def best_rows(results: DataFrame, best: DataFrame) -> DataFrame:
    """Result rows of the best triple, with truth and prediction.

    ``best`` may hold one triple or one per series; Spark chooses the join.
    """
    keys = [c for c in ("series_id", *PARAMS) if c in best.columns]
    return results.join(best.select(*keys), keys).select(
        "series_id", "train_index", "err",
        (F.col("prediction") - F.col("err")).alias("ground_truth"),
        F.col("prediction").alias("imputed_prediction"))


def _refined(cells: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Cut every cell of ``keys, cell, before, ranks, x, n`` into ``parts`` and keep what holds a wanted rank."""
    own = [*keys, "cell"]
    steps = [i / parts for i in range(1, parts)]
    # Written once: both uses below must see the same cuts.
    cuts = pin(cells.groupBy(*own).agg(F.percentile_approx("x", steps).alias("cuts")), "cuts")
    placed = cells.join(cuts, own).withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    upto = Window.partitionBy(*own).orderBy("part")  # as many rows as parts
    hist = (
        placed.groupBy(*own, "part").agg(F.sum("n").alias("m"), F.max("before").alias("start"), F.max("ranks").alias("wanted"))
        .withColumn("start", F.col("start") + F.sum("m").over(upto) - F.col("m"))
        .withColumn("wanted", F.filter("wanted", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("m"))))
        .where(F.size("wanted") > 0).drop("m")
    )
    return placed.join(hist, [*own, "part"]).select(
        *keys, (F.col("cell") * _CUTS + F.col("part")).alias("cell"), F.col("start").alias("before"),
        F.col("wanted").alias("ranks"), "total", "x", "n")


def exact_percentiles(rows: DataFrame, keys: list[str], column: str,
                      shares: list[float]) -> DataFrame:
    """Exact interpolated percentiles per key, as one array column named ``column``.

    Equal values are counted first. While some cell of a key holds more different values
    than are put in order in one place, approximate percentiles cut it into ranges, a
    histogram tells in which of them each wanted rank lies, and only those go on. So no
    task sorts all values of a key, however many there are, and there may be any number
    of keys. One number a round comes to the driver; a round divides the largest cell by
    about a thousand.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(
        *keys, F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts = pin(counts, "counts")
    positions = F.transform(F.array(*map(F.lit, shares)), lambda p: p * (F.col("total") - 1))
    ranks = F.array_distinct(F.concat(F.transform(positions, lambda p: F.floor(p)),
                                      F.transform(positions, lambda p: F.ceil(p))))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    cells = counts.join(totals.withColumn("ranks", ranks), keys).select(
        *keys, F.lit(0).cast("bigint").alias("cell"), F.lit(0).cast("bigint").alias("before"), "ranks", "total", "x", "n")
    while (largest := cells.groupBy(*keys, "cell").count().agg(F.max("count")).first()[0] or 0) > _RANGE_VALUES:
        cells = pin(_refined(cells, keys, max(2, min(_CUTS, 2 * largest // _RANGE_VALUES))), "cells")
    inside = Window.partitionBy(*keys, "cell").orderBy("x")
    start = F.col("before") + F.sum("n").over(inside) - F.col("n")
    hit = (
        cells.withColumn("start", start)
        .withColumn("rank", F.explode(F.filter(
            "ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))))
    )
    at = hit.groupBy(*keys, "total").agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    return at.select(*keys, F.transform(
        positions,
        lambda p: F.col("at")[F.floor(p)]
        + (p - F.floor(p)) * (F.col("at")[F.ceil(p)] - F.col("at")[F.floor(p)])).alias(column))


def describe_by(results: DataFrame, keys: list[str] = PARAMS,
                columns: tuple[str, ...] = ("train_index", "err")) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of the columns per key."""
    basic = results.groupBy(*keys).agg(*[
        f(c).alias(f"{c}_{name}") for c in columns
        for name, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp),
                        ("min", F.min), ("max", F.max))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                      for c in columns])
    long = results.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.column", "p.x")
    quartiles = exact_percentiles(long, [*keys, "column"], "x", [0.25, 0.5, 0.75])
    wide = quartiles.groupBy(*keys).agg(*[
        F.max(F.when(F.col("column") == c, F.col("x")[i])).alias(f"{c}_p{name}")
        for c in columns for i, name in enumerate((25, 50, 75))])
    return basic.join(wide, keys, "left")
