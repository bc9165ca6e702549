"""Filling with a triple for each series: one search, and the same as a search for each."""

import random

import pytest

from tests.brute import predictions
from tidegap.plans.imputation import impute, impute_by_best

PERIOD = 6
TRIPLES = [(1, 1, 0), (3, 2, 1), (8, 5, 3), (2, 6, 0), (50, 1, 2)]


@pytest.fixture(scope="module")
def case(spark, make_series):
    rng = random.Random(12)
    values = {f"s{i}": [None if rng.random() < 0.25 else rng.randint(0, 15) for _ in range(50 + 7 * i)] for i in range(7)}
    values["short"] = [1, None, 2]
    values["untuned"] = [3, None] * 40
    best = [(name, *TRIPLES[i % 5]) for i, name in enumerate(values) if name != "untuned"]
    return values, make_series(values), spark.createDataFrame(best, "series_id string, k int, d int, v int"), best


def rows(df):
    return sorted((r.series_id, r.idx, None if r.value is None else round(r.value, 9), r.is_imputed) for r in df.collect())


@pytest.mark.parametrize("width", [None, 4])
def test_as_a_search_for_each(case, width):
    values, series, best, triples = case
    got = rows(impute_by_best(series, PERIOD, best, width))
    want = rows(series.where("series_id = 'untuned'").selectExpr("series_id", "idx", "value", "false AS is_imputed"))
    for name, k, d, v in triples:
        want += rows(impute(series.where(series.series_id == name), PERIOD, k, d, v, width))
    assert got == sorted(want)


def test_against_plain_python(case):
    values, series, best, triples = case
    got = {(r.series_id, r.idx): r.imputed for r in impute_by_best(series, PERIOD, best).collect() if not r.is_imputed or r.value}
    for name, k, d, v in triples[:5]:
        for i, x in enumerate(values[name]):
            if x is None:
                want = predictions(values[name], i, PERIOD, d + PERIOD // 2, [k], [d], [v])[k, d, v]
                assert got[name, i] == (None if want is None else pytest.approx(float(want)))


def test_one_search_whatever_the_triples(case):
    _, series, best, _ = case
    plan = impute_by_best(series, PERIOD, best)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_without_any_triple(case):
    values, series, best, _ = case
    got = impute_by_best(series, PERIOD, best.limit(0))
    assert got.where("is_imputed").count() == 0 and got.count() == sum(map(len, values.values()))
