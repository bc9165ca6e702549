"""The registered queries: each takes a session and a table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegap.cluster import pin, scratch_path
from tidegap.functions.timegrid import DAY_US, HOUR_US, MINUTE_US
from tidegap.operators.candidates import knn_candidates
from tidegap.operators.distances import gap_distance_arrays, gap_distance_joins, l2_distance
from tidegap.operators.filling import remaining_missing, write_back
from tidegap.operators.sampling import holdout_sample, mask_to_ratio
from tidegap.operators.scoring import (best_params, best_rows, describe_by, mae_by, rmse_by,
                                       rmse_grouping_sets, scores)
from tidegap.operators.series import (build_series, missing_ratio, missing_slots, observed,
                                      season_stats, trim_series)
from tidegap.plans.grid import Grid, exp_ranges, param_grid
from tidegap.plans.imputation import impute, impute_by_best
from tidegap.plans.search import knn_predict, parameter_search, robustness
from tidegap.sources.tables import (COUNT, TIME, read_counts, read_counts_csv, read_results, read_variant,
                                    utc_text, write_counts_csv, write_results, write_table, write_variant)


GRID = Grid([2, 4, 8], [2, 4, 8], [0, 2, 4])
SHAPE = GRID.shape(24)


def _rows(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _n():
    return F.count(F.lit(1)).cast("double")


def ev_type_hour(spark, folder, trim=True):
    return build_series(_rows(spark, folder, "events"), "ts", HOUR_US, 24, _n(), "event_type", trim)


def ev_hour(spark, folder):
    return build_series(_rows(spark, folder, "events"), "ts", HOUR_US, 24, _n(), trim=True)


def ev_5min(spark, folder):
    return build_series(_rows(spark, folder, "events"), "ts", 5 * MINUTE_US, 288, _n(), trim=True)


def ord_day(spark, folder):
    return build_series(_rows(spark, folder, "orders"), "o_orderdate", DAY_US, 7, _n(), trim=True)


def li_day(spark, folder):
    return build_series(_rows(spark, folder, "lineitem"), "l_shipdate", DAY_US, 7, _n(), trim=True)


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in columns else c for c in df.columns])


def _with_epoch(series: DataFrame) -> DataFrame:
    return series.select("series_id", "idx", F.unix_seconds("ts").alias("epoch_sec"), "value")


def _type_queries(spark, folder):
    """The hourly series per event type and its hold-out, written once."""
    series = pin(ev_type_hour(spark, folder), "series")
    return series, pin(holdout_sample(series, 24), "holdout")


def _type_results(spark, folder):
    return parameter_search(ev_type_hour(spark, folder), 24, GRID)


def series_build(spark, folder):
    return _with_epoch(ev_type_hour(spark, folder, trim=False))


def trimmed(spark, folder):
    return _with_epoch(trim_series(ev_type_hour(spark, folder, trim=False), 24))


def missing(spark, folder):
    return missing_slots(ev_5min(spark, folder)).select("series_id", "idx")


def ratio(spark, folder):
    return _rounded(missing_ratio(ev_type_hour(spark, folder)), 9,
                    "missing_ratio", "added_missing_ratio")


def stats(spark, folder):
    return season_stats(ev_type_hour(spark, folder), 24)


def ranges(spark, folder):
    return exp_ranges(stats(spark, folder))


def grid_rows(spark, folder):
    return param_grid(stats(spark, folder), 24)


def holdout(spark, folder):
    return holdout_sample(ev_type_hour(spark, folder), 24)


def masked(spark, folder):
    return mask_to_ratio(li_day(spark, folder), 0.6).select("series_id", "idx", "value")


def candidates(spark, folder):
    series, queries = _type_queries(spark, folder)
    return knn_candidates(queries, series, 24, SHAPE.width, SHAPE.max_shift).select(
        "series_id", "q_idx", "h_idx", "shift", "shift_rank", "season", "h_value")


def distance_joins(spark, folder):
    series, queries = _type_queries(spark, folder)
    return _rounded(gap_distance_joins(queries, series, SHAPE, GRID.d), 9, "dist")


def distance_arrays(spark, folder):
    series, queries = _type_queries(spark, folder)
    return _rounded(gap_distance_arrays(queries, series, SHAPE, GRID.d), 9, "dist")


def distance_l2(spark, folder):
    series, queries = _type_queries(spark, folder)
    return _rounded(l2_distance(queries, series, SHAPE), 9, "dist")


def predictions(spark, folder):
    series, queries = _type_queries(spark, folder)
    return _rounded(knn_predict(queries, series, 24, GRID), 9, "prediction")


def predictions_reference(spark, folder):
    series = pin(mask_to_ratio(ord_day(spark, folder), 0.9), "series")
    queries = pin(holdout_sample(series, 7), "holdout")
    return _rounded(knn_predict(queries, series, 7, Grid([16, 256], [2], [0, 2]), short="reference"),
                    9, "prediction")


def errors(spark, folder):
    return _rounded(_type_results(spark, folder), 9, "prediction", "err")


def default_grid_search(spark, folder):
    return _rounded(parameter_search(ord_day(spark, folder), 7), 9, "prediction", "err")


def _score(*keys):
    return lambda spark, folder: _rounded(rmse_by(_type_results(spark, folder), *keys), 6, "rmse")


def mae_scores(spark, folder):
    return _rounded(mae_by(_type_results(spark, folder), "k", "d", "v"), 6, "mae")


def rmse_scores(spark, folder):
    return _rounded(scores(_type_results(spark, folder)).drop("mae", "n", "n_null"), 6, "rmse")


def grouping_sets(spark, folder):
    return _rounded(rmse_grouping_sets(_type_results(spark, folder)), 6, "rmse")


def describe(spark, folder):
    found = describe_by(pin(_type_results(spark, folder), "results"))
    exact = ("k", "d", "v")
    return _rounded(found, 6, *[c for c in found.columns if c not in exact
                                and not c.endswith(("_count", "_min", "_max"))])


def best(spark, folder):
    return _rounded(best_params(scores(_type_results(spark, folder))), 6, "rmse")


def best_result_rows(spark, folder):
    results = pin(_type_results(spark, folder), "results")
    return _rounded(best_rows(results, best_params(scores(results))), 9, "err", "imputed_prediction")


def results_union(spark, folder):
    paths = []
    for series in (ev_type_hour(spark, folder), ev_hour(spark, folder)):
        paths.append(scratch_path(spark, "results"))
        write_results(parameter_search(series, 24, GRID), paths[-1], 0.05)
    return _rounded(read_results(spark, *paths).select(
        "series_id", "train_index", "k", "d", "v", "prediction", "err"), 9, "prediction", "err")


def _imputed(spark, folder):
    return impute(ev_type_hour(spark, folder), 24, k=4, d=4, v=2)


def impute_series(spark, folder):
    return _rounded(_imputed(spark, folder).drop("ts"), 9, "value", "imputed")


def _written_back(spark, folder):
    before = pin(ev_type_hour(spark, folder, trim=False), "series")
    return before, write_back(before, _imputed(spark, folder))


def combined(spark, folder):
    return _rounded(_written_back(spark, folder)[1].drop("ts"), 9, "value")


def remaining(spark, folder):
    return remaining_missing(*_written_back(spark, folder))


def _robust(spark, folder):
    return robustness(ord_day(spark, folder), 7, [0.1, 0.5, 0.9], Grid([2, 8], [2, 4], [0, 2]))


def ratio_scores(spark, folder):
    return _rounded(rmse_by(_robust(spark, folder), "missing_ratio", "k", "d", "v"), 6, "rmse")


def csv_round_trip(spark, folder):
    path = scratch_path(spark, "csv")
    write_counts_csv(ev_type_hour(spark, folder), path, series_column="SERIES")
    rows = read_counts_csv(spark, path, series="SERIES")
    return _with_epoch(build_series(rows, TIME, HOUR_US, 24, F.max(observed(COUNT)), "SERIES"))


def csv_rejects(spark, folder):
    """Every line of count files with bad cells: read, or rejected for a reason."""
    path = scratch_path(spark, "lines")
    series, time = ev_type_hour(spark, folder, trim=False), utc_text(F.col("ts"))
    kind = F.col("idx") % 13
    cells = [F.col("series_id"), F.when(kind == 3, "yesterday").when(kind == 4, "").otherwise(time),
             F.when(kind.isin(5, 3), "n/a").when(kind == 6, "").otherwise(F.coalesce("value", F.lit(-1.0)).cast("string"))]
    line = F.concat(F.concat_ws(",", *cells), F.when(kind == 7, ",more").otherwise(""))
    series.select(F.when(kind == 8, F.col("series_id")).otherwise(line).alias("line")).write.text(path)
    rows, rejects = read_counts(spark, path, "AT", "N", "SERIES", columns=["SERIES", "AT", "N"])
    return rejects.select("reason", "line").unionByName(rows.select(
        F.lit("").alias("reason"), F.concat_ws("|", "SERIES", F.col("AT").cast("string"), F.coalesce(
            F.col("N").cast("decimal(20,1)").cast("string"), F.lit(""))).alias("line")))


def variant_source(spark, folder):
    path = scratch_path(spark, "variants")
    series = pin(li_day(spark, folder), "series")
    for share in (0.25, 0.5):
        write_variant(mask_to_ratio(series, share), path, share)
    return read_variant(spark, path, 0.25).select("series_id", "idx", "value")


def results_tagged(spark, folder):
    path = scratch_path(spark, "results")
    found = pin(_robust(spark, folder), "results")
    for share in (0.1, 0.5, 0.9):
        write_results(found.where(F.col("missing_ratio") == share), path, share)
    return read_results(spark, path).groupBy("ratio_tag", "missing_ratio", "distance").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sqrt(F.avg(F.col("err") ** 2)), 6).alias("rmse"))


def table_hand_over(spark, folder):
    written = write_table(_imputed(spark, folder), scratch_path(spark, "filled"))
    return _rounded(written.select("series_id", "idx", "value"), 9, "value")


def score_table(spark, folder):
    written = write_table(scores(_type_results(spark, folder)), scratch_path(spark, "scores"))
    return _rounded(written, 6, "rmse", "mae")


def ev_mean_hour(spark, folder):
    """Mean value of the events of an hour in tenths, by whole cents: fractions, where the others are counts."""
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    tenths = F.floor((cents * 2 + F.count("value") * 10) / (F.count("value") * 20))
    return build_series(_rows(spark, folder, "events"), "ts", HOUR_US, 24, tenths / 10, trim=True)


def predictions_fractional(spark, folder):
    series = pin(ev_mean_hour(spark, folder), "series")
    return _rounded(knn_predict(pin(holdout_sample(series, 24), "holdout"), series, 24, GRID), 6, "prediction")


def best_masked(spark, folder):
    """The best triple where much is missing, so that not every triple has a prediction."""
    series = mask_to_ratio(ord_day(spark, folder), 0.97)
    scored = scores(parameter_search(series, 7, Grid([2, 8], [1, 2], [0, 2]), width=2))
    return _rounded(best_params(scored), 6, "rmse")


def best_by_series(spark, folder):
    scored = scores(_type_results(spark, folder), "series_id")
    return _rounded(best_params(scored, "series_id"), 6, "rmse")


def imputed_by_best(spark, folder):
    """Each masked hourly series filled with its own best triple of a small grid."""
    series = pin(mask_to_ratio(ev_type_hour(spark, folder), 0.3), "series")
    found = parameter_search(series, 24, Grid([2, 8], [4], [0, 4]))
    best = best_params(scores(found, "series_id"), "series_id")
    return _rounded(impute_by_best(series, 24, best, width=16).select("series_id", "idx", "value", "is_imputed"), 6, "value")


def ev_50s(spark, folder):
    """288 slots of 50 seconds a season, 180 seasons: the size of the published runs."""
    return build_series(_rows(spark, folder, "events"), "ts", 50_000_000, 288, _n(), trim=True)


def impute_5min(spark, folder):
    """The chosen triple on five-minute counts, two fifths of them missing."""
    series = mask_to_ratio(ev_5min(spark, folder), 0.4)
    return _rounded(impute(series, 288).drop("ts"), 9, "value", "imputed")


def grid_5min(spark, folder):
    """RMSE per triple of the whole default grid on five-minute counts."""
    return _rounded(rmse_by(parameter_search(ev_5min(spark, folder), 288), "k", "d", "v"), 6, "rmse")


QUERIES = {
    "series_build": series_build,
    "trim_series": trimmed,
    "missing_slots": missing,
    "missing_ratio": ratio,
    "season_stats": stats,
    "exp_ranges": ranges,
    "param_grid": grid_rows,
    "holdout_sample": holdout,
    "mask_to_ratio": masked,
    "knn_candidates": candidates,
    "gap_distance": distance_arrays,
    "gap_distance_hof": distance_arrays,
    "gap_distance_joins": distance_joins,
    "l2_distance": distance_l2,
    "knn_predict": predictions,
    "knn_predict_reference": predictions_reference,
    "knn_errors": errors,
    "knn_grid": default_grid_search,
    "rmse_total": _score(),
    "rmse_by_k": _score("k"),
    "rmse_by_d": _score("d"),
    "rmse_by_v": _score("v"),
    "rmse_by_kdv": rmse_scores,
    "mae_by_kdv": mae_scores,
    "rmse_grouping_sets": grouping_sets,
    "describe_by_kdv": describe,
    "best_params": best,
    "best_param_rows": best_result_rows,
    "results_union": results_union,
    "impute_series": impute_series,
    "write_back": combined,
    "remaining_missing": remaining,
    "rmse_by_missing_ratio": ratio_scores,
    "csv_round_trip": csv_round_trip,
    "csv_rejects": csv_rejects,
    "variant_source": variant_source,
    "results_tagged": results_tagged,
    "table_hand_over": table_hand_over,
    "score_table": score_table,
    "knn_predict_fractional": predictions_fractional,
    "best_params_masked": best_masked,
    "best_params_by_series": best_by_series,
    "impute_by_best": imputed_by_best,
    "impute_5min": impute_5min,
    "grid_5min": grid_5min,
}
