"""What must hold for any series."""

import random

import pytest
from pyspark.sql import functions as F

from tidegap.operators.sampling import holdout_sample
from tidegap.plans.grid import Grid
from tidegap.plans.imputation import impute
from tidegap.plans.search import knn_predict, parameter_search

GRID = Grid([1, 4], [2, 4], [0, 2])


@pytest.fixture(scope="module")
def values():
    rng = random.Random(11)
    return [rng.randint(0, 20) for _ in range(8 * 20)]


def _results(df):
    return {(r.train_index, r.k, r.d, r.v): (r.prediction, r.err) for r in df.collect()}


def test_a_constant_moves_predictions_and_leaves_errors(make_series, values):
    plain = _results(parameter_search(make_series({"a": values}), 8, GRID))
    moved = _results(parameter_search(make_series({"a": [x + 7 for x in values]}), 8, GRID))
    assert plain and plain.keys() == moved.keys()
    for key, (prediction, err) in plain.items():
        assert moved[key][0] == pytest.approx(prediction + 7)
        assert moved[key][1] == pytest.approx(err)


def test_a_seasonal_series_has_no_error_without_shift(make_series):
    found = _results(parameter_search(make_series({"a": [3, 9, 1, 5, 5, 2, 8, 4] * 20}), 8,
                                      Grid([1, 4], [2], [0])))
    assert found and all(err == 0 for _, err in found.values())


def test_a_wider_window_changes_nothing_when_all_is_observed(make_series, values):
    series = make_series({"a": values})
    middle = holdout_sample(series, 8).where("q_idx BETWEEN 56 AND 100")
    # Only seasons far from the ends take part in both, so compare the same candidates.
    narrow = knn_predict(middle, series, 8, Grid([1], [2], [0]), width=5)
    wide = knn_predict(middle, series, 8, Grid([1], [2], [0]), width=7)
    assert middle.count() > 0 and sorted(narrow.collect()) == sorted(wide.collect())


def test_predictions_lie_within_the_values(make_series, values):
    found = _results(parameter_search(make_series({"a": values}), 8, GRID))
    assert all(min(values) <= p <= max(values) for p, _ in found.values())


def test_hold_out_points_do_not_hide_each_other(make_series, values):
    """Other queries keep their values while one is asked."""
    series = make_series({"a": values})
    queries = holdout_sample(series, 8)
    all_at_once = {r.q_idx: r.prediction for r in knn_predict(
        queries, series, 8, Grid([4], [2], [2])).collect()}
    first = min(all_at_once)
    (alone,) = knn_predict(queries.where(F.col("q_idx") == first), series, 8,
                           Grid([4], [2], [2])).collect()
    assert alone.prediction == all_at_once[first]


def test_no_gap(make_series, values):
    filled = impute(make_series({"a": values}), 8, 4, 2, 1)
    assert filled.count() == len(values) and filled.where("is_imputed").count() == 0


def test_all_missing(make_series):
    series = make_series({"a": [None] * 40})
    assert parameter_search(series, 8, GRID).count() == 0
    assert impute(series, 8, 4, 2, 1).where("value IS NOT NULL").count() == 0


def test_fewer_than_three_seasons(make_series, values):
    short = values[:20]
    short[9] = None
    (row,) = impute(make_series({"a": short}), 8, 4, 2, 1).where("idx = 9").collect()
    assert row.value is None and not row.is_imputed


def test_gap_longer_than_the_window(make_series, values):
    gap = list(values)
    gap[60:90] = [None] * 30
    filled = {r.idx: r for r in impute(make_series({"a": gap}), 8, 4, 2, 1, width=4).collect()}
    # Inside the gap nothing is near; at its rim one side is.
    assert filled[75].value is None and filled[60].value is not None and filled[89].is_imputed


def test_first_and_last_season(make_series, values):
    gap = list(values)
    gap[1] = gap[-2] = None
    filled = {r.idx: r for r in impute(make_series({"a": gap}), 8, 4, 2, 1).collect()}
    assert filled[1].is_imputed and filled[len(gap) - 2].is_imputed
