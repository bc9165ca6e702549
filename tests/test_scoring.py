import random

import numpy as np
import pytest

from tidegap.operators.scoring import (best_params, best_rows, describe_by, exact_percentiles,
                                       knn_errors, mae_by, rmse_by, rmse_grouping_sets, scores)


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(4)
    rows = [("a", i, k, d, v, float(i % 13), rng.choice([-2.0, 0.0, 0.0, 1.5, rng.gauss(0, 3)]))
            for i in range(301) for k in (2, 4) for d in (1, 3) for v in (0, 5)]
    return spark.createDataFrame(
        rows, "series_id string, train_index bigint, k int, d int, v int, prediction double, err double")


@pytest.fixture(scope="module")
def frame(results):
    return results.toPandas()


def _rmse(x):
    return float(np.sqrt(np.mean(x ** 2)))


def test_measures(results, frame):
    (row,) = rmse_by(results).collect()
    assert row.rmse == pytest.approx(_rmse(frame.err))
    for r in mae_by(results, "k").collect():
        assert r.mae == pytest.approx(frame[frame.k == r.k].err.abs().mean())


def test_grouping_sets(results, frame):
    rows = rmse_grouping_sets(results).collect()
    assert len(rows) == 2 + 2 + 2 + 8 + 1
    for r in rows:
        part = frame
        for name in ("k", "d", "v"):
            if r[name] is not None:
                part = part[part[name] == r[name]]
        assert r.rmse == pytest.approx(_rmse(part.err))


def test_best(results, frame):
    want = frame.groupby(["k", "d", "v"]).err.apply(_rmse).sort_values(kind="stable")
    ordered = scores(results)
    assert [(r.k, r.d, r.v) for r in ordered.collect()] == list(want.index)
    (best,) = best_params(ordered).collect()
    assert (best.k, best.d, best.v) == want.index[0]
    rows = best_rows(results, best_params(ordered)).collect()
    assert len(rows) == 301
    assert all(r.ground_truth + r.err == pytest.approx(r.imputed_prediction) for r in rows)


def test_equal_scores_take_the_smallest_parameters(spark):
    table = spark.createDataFrame([(4, 1, 0, 1.0), (2, 3, 0, 1.0), (2, 1, 5, 1.0)],
                                  "k int, d int, v int, rmse double")
    (best,) = best_params(table).collect()
    assert (best.k, best.d, best.v) == (2, 1, 5)


def test_percentiles(spark, results, frame):
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for r in exact_percentiles(results, ["k", "v"], "err", shares).collect():
        part = frame[(frame.k == r.k) & (frame.v == r.v)].err
        assert r.err == pytest.approx(list(np.percentile(part, [100 * p for p in shares])))
    # One value that holds nearly all rows, and one far away.
    rows = [(1, 7.0)] * 500 + [(1, 1e9), (1, -3.0), (2, 5.0)]
    table = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: r.x for r in exact_percentiles(table, ["g"], "x", [0.0, 0.5, 1.0]).collect()}
    assert got == {1: [-3.0, 7.0, 1e9], 2: [5.0, 5.0, 5.0]}


def test_describe(results, frame):
    want = frame.groupby(["k", "d", "v"])[["train_index", "err"]].describe()
    for r in describe_by(results).collect():
        for column in ("train_index", "err"):
            row = want.loc[(r.k, r.d, r.v)][column]
            got = [r[f"{column}_{n}"] for n in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
            assert got == pytest.approx(list(row))


def test_errors(spark, make_queries):
    found = spark.createDataFrame([("a", 3, 2, 1, 0, 7.5), ("a", 4, 2, 1, 0, None)],
                                  "series_id string, q_idx bigint, k int, d int, v int, prediction double")
    rows = knn_errors(found, make_queries([("a", 3, 9.0), ("a", 4, 1.0)])).collect()
    assert {r.train_index: r.err for r in rows} == {3: -1.5, 4: None}


def test_a_triple_without_prediction_is_not_the_best(spark):
    rows = [("a", 1, 2, 2, 0, None, None), ("a", 2, 2, 2, 0, None, None), ("a", 1, 4, 2, 0, 3.0, 1.0), ("a", 2, 4, 2, 0, None, None),
            ("b", 1, 2, 2, 0, 3.0, 0.5)]
    table = spark.createDataFrame(
        rows, "series_id string, train_index bigint, k int, d int, v int, prediction double, err double")
    scored = {(r.k, r.d): (r.rmse, r.n, r.n_null) for r in scores(table.where("series_id = 'a'")).collect()}
    assert scored == {(4, 2): (1.0, 1, 1), (2, 2): (None, 0, 2)}
    assert best_params(scores(table.where("series_id = 'a'"))).first().k == 4
    best = {r.series_id: r.k for r in best_params(scores(table, "series_id"), "series_id").collect()}
    assert best == {"a": 4, "b": 2}
    assert {r.series_id for r in best_rows(table, best_params(scores(table, "series_id"), "series_id")).collect()} == {"a", "b"}
