import hashlib
import random

import pytest

from tidegap.operators import sampling
from tidegap.operators.sampling import holdout_sample, mask_to_ratio, mask_to_ratios


def _first(name, pool, wanted):
    order = sorted(pool, key=lambda i: hashlib.md5(f"2017:{name}:{i}".encode()).hexdigest())
    return set(order[:wanted])


@pytest.fixture(scope="module", params=[4096, 7])
def values(request):
    """Series of different length, with one and with many hash ranges."""
    before, sampling._BUCKET_ROWS = sampling._BUCKET_ROWS, request.param
    rng = random.Random(3)
    yield {name: [None if rng.random() < 0.2 else rng.randint(0, 9) for _ in range(n)]
           for name, n in (("a", 400), ("b", 77), ("c", 23))}
    sampling._BUCKET_ROWS = before


def test_holdout(values, make_series):
    got = {}
    for r in holdout_sample(make_series(values), 10).collect():
        got.setdefault(r.series_id, {})[r.q_idx] = r.truth
    for name in "ab":
        series = values[name]
        stop = 10 * (len(series) // 10 - 1)
        pool = [i for i in range(10, stop) if series[i] is not None]
        want = _first(name, pool, int(0.05 * len(series)))
        assert got[name] == {i: series[i] for i in want}
    assert "c" not in got  # two seasons: no training range


def test_sample_is_limited_by_the_pool(make_series):
    series = make_series({"a": [None] * 12 + [4] + [None] * 17})
    assert [r.q_idx for r in holdout_sample(series, 10, share=0.5).collect()] == [12]


def test_mask(values, make_series):
    series = make_series(values)
    got = {(r.series_id, r.idx): r.value for r in mask_to_ratio(series, 0.6).collect()}
    for name, plain in values.items():
        pool = [i for i, x in enumerate(plain) if x is not None]
        gone = _first(name, pool, int(0.6 * len(plain)) - (len(plain) - len(pool)))
        want = [None if i in gone else x for i, x in enumerate(plain)]
        assert [got[name, i] for i in range(len(plain))] == want


def test_mask_below_the_present_ratio_changes_nothing(values, make_series):
    series = make_series(values)
    assert sorted(mask_to_ratio(series, 0.05).collect(), key=str) == sorted(series.collect(), key=str)


def test_all_ratios_from_one_order(make_series, monkeypatch):
    """Several ranges, cuts inside and between them; the same as one ratio at a time."""
    monkeypatch.setattr("tidegap.operators.sampling._BUCKET_ROWS", 16)
    series = make_series({"a": [None if i % 7 == 0 else i for i in range(300)], "b": [1.0] * 40})
    ratios = [0.1, 0.145, 0.5, 0.93]
    got = {r: {} for r in ratios}
    for r in mask_to_ratios(series, ratios).collect():
        got[r.ratio][r.series_id, r.idx] = r.value
    for ratio in ratios:
        want = {(r.series_id, r.idx): r.value for r in mask_to_ratio(series, ratio).collect()}
        assert got[ratio] == want and len(want) == 340
        missing = sum(v is None for (s, _), v in want.items() if s == "a")
        assert missing == max(43, int(ratio * 300))
