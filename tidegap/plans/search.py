"""Parameter search on hold-out points, and the same over several missing ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin
from tidegap.operators.distances import gap_distance_arrays, gap_distance_joins
from tidegap.operators.neighbours import asked_grid, nearest_per_ring, predict, predict_lists, reference_distances
from tidegap.operators.sampling import SEED, holdout_sample, mask_to_ratios
from tidegap.operators.scoring import knn_errors
from tidegap.operators.season_blocks import Shape, grouped
from tidegap.operators.series import season_stats
from tidegap.operators.tiles import nearest_lists
from tidegap.plans.grid import Grid, default_grid, param_grid


def knn_predict(queries: DataFrame, series: DataFrame, period: int, grid: Grid,
                width: int | None = None, short: str = "shrink", form: str = "tiles",
                sentinel: float = -1.0) -> DataFrame:
    """Predictions for every query and ``(k, d, v)`` of the grid.

    ``short="shrink"`` averages what usable candidates there are when they are fewer
    than ``k``. ``short="reference"`` fills up with unusable ones at distance 999,
    which count with their missing mark ``sentinel``.
    """
    shape = grid.shape(period, width)
    if short not in ("shrink", "reference"):
        raise ValueError(f"short: {short!r}")
    keep = short == "reference"
    # NaN is no observation, whoever built the series.
    series = series.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if form == "tiles":
        lists = nearest_lists(queries, series, grouped(shape, queries), grid.k, grid.d, grid.v,
                              sentinel if keep else None)
        return predict_lists(lists, asked_grid(queries, grid.k, grid.d, grid.v))
    near = nearest_per_ring(
        _distances(form, queries, series, shape, grid.d, keep, sentinel), grid.k, grid.v)
    return predict(near, queries, grid.k, grid.d, grid.v)


def _distances(form: str, queries: DataFrame, series: DataFrame, shape: Shape, d: list[int],
               keep: bool, sentinel: float) -> DataFrame:
    if form == "arrays":
        found = gap_distance_arrays(queries, series, shape, d, keep_unusable=keep)
        return reference_distances(found, sentinel) if keep else found
    if form == "joins" and not keep:
        return gap_distance_joins(queries, series, shape, d)
    raise ValueError(f"no form {form!r} for this search")


def longest_in_seasons(series: DataFrame, period: int) -> int:
    """Complete seasons of the longest series; one number comes to the driver."""
    return season_stats(series, period).agg(F.max("n_seasons")).first()[0] or 0


def parameter_search(series: DataFrame, period: int, grid: Grid | None = None,
                     width: int | None = None, share: float = 0.05, seed: int = SEED,
                     short: str = "shrink", form: str = "tiles", own_grid: bool = False) -> DataFrame:
    """Errors ``series_id, train_index, k, d, v, prediction, err`` on a hold-out.

    The default grid follows from the longest series. With ``own_grid`` a series keeps
    only the triples of its own default grid (:func:`tidegap.plans.grid.param_grid`).

    ``series`` is trimmed (see :func:`tidegap.operators.series.build_series`). It and
    the hold-out are written once to the scratch folder, because the search reads
    both several times.
    """
    series = pin(series, "series")
    grid = grid or default_grid(period, longest_in_seasons(series, period))
    queries = pin(holdout_sample(series, period, share, seed), "holdout")
    predictions = knn_predict(queries, series, period, grid, width, short, form)
    errors = knn_errors(predictions, queries)
    if own_grid:
        own = param_grid(season_stats(series, period), period)
        errors = errors.join(own, ["series_id", "k", "d", "v"], "left_semi").select(*errors.columns)
    return errors


def masked_variants(series: DataFrame, ratios: list[float], seed: int = SEED) -> DataFrame:
    """The series once per ratio, masked to it; ``series_id`` gets the ratio as suffix."""
    name = F.create_map(*[x for r in ratios for x in (F.lit(float(r)), F.lit(str(r)))])
    return mask_to_ratios(series, ratios, seed).select(
        F.concat_ws("@", "series_id", F.element_at(name, F.col("ratio"))).alias("series_id"), "idx", "ts", "value")


def robustness(series: DataFrame, period: int, ratios: list[float], grid: Grid,
               width: int | None = None) -> DataFrame:
    """Search errors for several missing ratios in one job, with ``missing_ratio``."""
    series = pin(series, "series")
    found = parameter_search(masked_variants(series, ratios), period, grid, width)
    return found.withColumn(
        "missing_ratio", F.substring_index("series_id", "@", -1).cast("double")
    ).withColumn("series_id", F.regexp_replace("series_id", "@[^@]*$", ""))
