import pytest
from pyspark.sql import functions as F

from tidegap.functions.ranges import exp_range, exp_range_cover, exp_range_inc
from tidegap.operators.scoring import best_params, scores
from tidegap.plans.grid import default_grid, exp_ranges, param_grid
from tidegap.plans.imputation import impute_by_best
from tidegap.plans.search import parameter_search


@pytest.mark.parametrize("end, below, upto, cover", [
    (86, [4, 8, 16, 32, 64], [4, 8, 16, 32, 64], [4, 8, 16, 32, 64, 128]),
    (64, [4, 8, 16, 32], [4, 8, 16, 32, 64], [4, 8, 16, 32, 64]),
    (17.0, [4, 8, 16], [4, 8, 16], [4, 8, 16, 32]),
    (2, [], [], [4]),
])
def test_ranges(spark, end, below, upto, cover):
    row = spark.range(1).select(exp_range(4, end).alias("a"), exp_range_inc(4, end).alias("b"),
                                exp_range_cover(4, end).alias("c")).first()
    assert (row.a, row.b, row.c) == (below, upto, cover)


def test_default_grid():
    grid = default_grid(288, 173)
    assert grid.k == grid.d == [4, 8, 16, 32, 64, 128]
    assert grid.v == [0, 4, 8, 16, 32]
    assert grid.shape(288).width == 272


def test_grid_rows_per_series(spark):
    stats = spark.createDataFrame([("a", 173), ("b", 9)], "series_id string, n_seasons bigint")
    rows = param_grid(stats, 288).collect()
    want = default_grid(288, 173)
    got = {(r.k, r.d, r.v) for r in rows if r.series_id == "a"}
    assert got == {(k, d, v) for k in want.k for d in want.d for v in want.v}
    assert {r.k for r in rows if r.series_id == "b"} == {4}
    kinds = exp_ranges(stats).groupBy("series_id", "kind").agg(F.max("value").alias("m")).collect()
    assert {(r.series_id, r.kind): r.m for r in kinds}["a", "covering"] == 128


def test_a_series_keeps_its_own_grid(make_series):
    long, short = [i % 5 + i % 3 for i in range(4 * 40)], [i % 5 for i in range(4 * 12)]
    found = parameter_search(make_series({"long": long, "short": short}), 4, width=2, own_grid=True)
    ks = {(r.series_id, r.k) for r in found.select("series_id", "k").distinct().collect()}
    assert ks == {("long", 4), ("long", 8), ("long", 16), ("long", 32), ("short", 4), ("short", 8)}
    best = best_params(scores(found, "series_id"), "series_id")
    filled = impute_by_best(make_series({"long": long[:-1] + [None] + long[:3], "none": [None, 1]}), 4, best, width=2)
    rows = {(r.series_id, r.idx): (r.value, r.is_imputed) for r in filled.collect()}
    assert len(rows) == len(long) + 3 + 2 and rows["none", 0] == (None, False) and rows["long", len(long) - 1][1]
