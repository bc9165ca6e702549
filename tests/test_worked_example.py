"""A series small enough to work through by hand."""

from fractions import Fraction

import pytest

from tidegap.operators.distances import gap_distance_arrays, gap_distance_joins
from tidegap.operators.season_blocks import Shape
from tidegap.plans.grid import Grid
from tidegap.plans.search import knn_predict

VALUES = [10, 12, 30, 8, 11, 14, 33, None, 9, 13, 29, 7, 12, 15, 31, 9, 10, None, 32, 8]
SHAPE = Shape(period=4, width=4, max_shift=1)
DISTANCES = {
    (5, 1): Fraction(6, 2), (13, 1): Fraction(5, 2), (4, 1): Fraction(16, 2),
    (8, 1): Fraction(101, 5), (12, 1): Fraction(16, 2), (6, 1): Fraction(9, 3),
    (10, 1): Fraction(98, 5), (14, 1): Fraction(26, 2),
    (5, 2): Fraction(24, 8), (13, 2): Fraction(19, 7), (4, 2): Fraction(80, 7),
    (8, 2): Fraction(161, 12), (12, 2): Fraction(65, 8), (6, 2): Fraction(76, 10),
    (10, 2): Fraction(125, 7), (14, 2): Fraction(87, 7),
}


@pytest.fixture(scope="module")
def tables(make_series, make_queries):
    return make_queries([("a", 9, 13.0)]), make_series({"a": VALUES})


@pytest.mark.parametrize("form", [gap_distance_joins, gap_distance_arrays])
def test_distances(tables, form):
    rows = form(*tables, SHAPE, [1, 2]).collect()
    assert {(r.h_idx, r.d): r.dist for r in rows} == {k: float(f) for k, f in DISTANCES.items()}


@pytest.mark.parametrize("form", ["joins", "arrays", "tiles"])
def test_predictions(tables, form):
    rows = knn_predict(*tables, 4, Grid([1, 2, 9], [1, 2], [0, 1]), width=4, form=form).collect()
    got = {(r.k, r.d, r.v): r.prediction for r in rows}
    # Slots 5 and 6 are equally far at d=1; the smaller shift comes first.
    assert got[1, 1, 1] == 15 and got[2, 1, 1] == 14.5
    assert got[1, 2, 0] == 15 and got[2, 2, 0] == 14.5
    assert got[9, 1, 1] == 19.25
    assert len(got) == 12


@pytest.mark.parametrize("form", ["arrays", "tiles"])
def test_unusable_candidates_fill_up(tables, form):
    grid = Grid([9], [1], [1])
    (row,) = knn_predict(*tables, 4, grid, width=4, short="reference", form=form).collect()
    assert row.prediction == pytest.approx(152 / 9, abs=1e-12)
