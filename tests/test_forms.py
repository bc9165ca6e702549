"""The plans of the search agree with each other and with plain Python."""

import random

import pytest

from tests.brute import predictions
from tidegap.operators.season_blocks import Shape
from tidegap.operators.neighbours import predict
from tidegap.operators.tiles import nearest_per_tile
from tidegap.plans.grid import Grid
from tidegap.plans.search import knn_predict

GRID = Grid([1, 3, 50], [1, 2, 6], [0, 1, 3])
PERIOD, WIDTH = 6, 9


def _values(seed, n, missing):
    rng = random.Random(seed)
    return [None if rng.random() < missing else rng.randint(0, 12) for _ in range(n)]


@pytest.fixture(scope="module")
def case(make_series, make_queries):
    series = {"full": _values(1, 75, 0.0), "some": _values(2, 83, 0.3), "most": _values(3, 80, 0.9)}
    # A gap longer than the window, so that some queries share nothing.
    series["hole"] = _values(4, 90, 0.1)
    series["hole"][30:55] = [None] * 25
    asked = [(name, i) for name, values in series.items()
             for i in [0, 3, 11, 20, 31, 42, 43, len(values) // 2 + 9, len(values) - 1]]
    rows = [(name, i, None if series[name][i] is None else float(series[name][i]))
            for name, i in sorted(set(asked))]
    return series, make_series(series), make_queries(rows), [(n, i) for n, i, _ in rows]


def _as_dict(df):
    rows = df.collect()
    out = {(r.series_id, r.q_idx, r.k, r.d, r.v): r.prediction for r in rows}
    assert len(out) == len(rows)
    return out


def _brute(case, sentinel=None):
    series, _, _, asked = case
    out = {}
    for name, q in asked:
        found = predictions(series[name], q, PERIOD, WIDTH, GRID.k, GRID.d, GRID.v, sentinel)
        out.update({(name, q, *key): value for key, value in found.items()})
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == (None if value is None else pytest.approx(float(value), abs=1e-9)), key


@pytest.mark.parametrize("form", ["joins", "arrays", "tiles"])
def test_shrink(case, form):
    _, series, queries, _ = case
    _same(_as_dict(knn_predict(queries, series, PERIOD, GRID, WIDTH, form=form)), _brute(case))


@pytest.mark.parametrize("form", ["arrays", "tiles"])
def test_reference(case, form):
    _, series, queries, _ = case
    got = knn_predict(queries, series, PERIOD, GRID, WIDTH, "reference", form, sentinel=-5.0)
    _same(_as_dict(got), _brute(case, sentinel=-5))


def test_many_small_tiles(case):
    """History cut in pieces of two seasons gives what one piece gives."""
    _, series, queries, _ = case
    shape = Shape(PERIOD, WIDTH, max(GRID.v), query_seasons=2, history_seasons=2)
    near = nearest_per_tile(queries, series, shape, GRID.k, GRID.d, GRID.v)
    _same(_as_dict(predict(near, queries, GRID.k, GRID.d, GRID.v)), _brute(case))


def test_one_pass_is_the_loop_over_the_grid(case):
    _, series, queries, _ = case
    whole = _as_dict(knn_predict(queries, series, PERIOD, GRID, WIDTH))
    for k, d, v in ((1, 6, 3), (3, 1, 0), (50, 2, 1)):
        one = _as_dict(knn_predict(queries, series, PERIOD, Grid([k], [d], [v]), WIDTH))
        assert one == {key: value for key, value in whole.items() if key[2:] == (k, d, v)}


def test_wide_windows_at_the_default_size(make_series, make_queries):
    """The chosen triple and a wide grid with 288 slots a season."""
    rng = random.Random(5)
    values = [None if rng.random() < 0.2 else rng.randint(0, 30) for _ in range(288 * 5 + 100)]
    asked = [5, 300, 700, 1000, 1431]
    series = make_series({"a": values})
    queries = make_queries([("a", i, None) for i in asked])
    for grid in (Grid([32], [4], [8]), Grid([2, 8], [4, 64], [0, 8])):
        width = max(grid.d) + 144
        got = _as_dict(knn_predict(queries, series, 288, grid))
        want = {("a", q, *key): value for q in asked for key, value in predictions(
            values, q, 288, width, grid.k, grid.d, grid.v).items()}
        _same(got, want)


@pytest.mark.parametrize("form", ["joins", "arrays", "tiles"])
def test_absent_rows_are_missing_slots(case, form):
    """A series without its NULL rows, whole seasons among them, gives the same."""
    _, series, queries, _ = case
    sparse = series.where("value IS NOT NULL")
    ends = series.groupBy("series_id").agg({"idx": "max"}).withColumnRenamed("max(idx)", "idx")
    sparse = sparse.unionByName(series.join(ends, ["series_id", "idx"], "left_semi").where("value IS NULL"))
    if form == "joins":  # its candidates are joined to rows of the series
        got = _as_dict(knn_predict(queries, series, PERIOD, GRID, WIDTH, form=form))
    else:
        got = _as_dict(knn_predict(queries, sparse, PERIOD, GRID, WIDTH, form=form))
    _same(got, _brute(case))


def test_fractions_and_nan(make_series, make_queries):
    """Tenths give the same neighbours in every form; NaN counts as missing."""
    rng = random.Random(11)
    values = [None if rng.random() < 0.2 else rng.randint(0, 40) / 10 for _ in range(96)]
    with_nan = [float("nan") if v is None and i % 2 else v for i, v in enumerate(values)]
    asked = [("a", i, None) for i in range(96)]
    plain = _as_dict(knn_predict(make_queries(asked), make_series({"a": values}), PERIOD, GRID, WIDTH, form="joins"))
    for form in ("arrays", "tiles"):
        _same(_as_dict(knn_predict(make_queries(asked), make_series({"a": with_nan}), PERIOD, GRID, WIDTH, form=form)), plain)


def test_ties_are_settled_in_the_tile(make_series, make_queries):
    """A constant series ties everywhere; a tile still returns max(k) rows at most."""
    series, queries = make_series({"a": [5] * 120}), make_queries([("a", i, 5.0) for i in (40, 47, 60, 61)])
    shape = Shape(PERIOD, WIDTH, 3)
    near = nearest_per_tile(queries, series, shape, [4], [2, 6], [0, 3])
    counts = near.groupBy("q_idx", "d", "v").count().collect()
    assert max(r["count"] for r in counts if r.v == 0) == 4 and max(r["count"] for r in counts) <= 2 * 4
