"""Running sums in blocks, and percentiles in rounds."""

import random

import numpy as np
import pytest

from tidegap.operators import prefix, scoring
from tidegap.operators.prefix import with_before
from tidegap.operators.sampling import holdout_sample, mask_to_ratio


def running(rows):
    out = {}
    for key, place, n in rows:
        out[key, place] = sum(m for k, p, m in rows if k == key and p < place)
    return out


@pytest.mark.parametrize("together", [1, 2, 7, 4096])
def test_running_sums(spark, monkeypatch, together):
    monkeypatch.setattr(prefix, "TOGETHER", together)
    rng = random.Random(4)
    rows = [("a", p, rng.randint(0, 9)) for p in rng.sample(range(600), 150)]
    rows += [("b", p, 1) for p in range(33)] + [("c", 0, 5), ("d", 511, 2), ("d", 512, 3), ("d", 1023, 4)]
    table = spark.createDataFrame(rows, "name string, place bigint, n bigint")
    got = {(r.name, r.place): r.sum for r in with_before(table, ["name"], "place", "n", "sum").collect()}
    assert got == running(rows)
    assert with_before(table.limit(0), ["name"], "place", "n", "sum").count() == 0


def test_no_window_over_a_whole_series(spark, make_series):
    series = make_series({"a": [1, 2, None, 4] * 30})
    for df in (holdout_sample(series, 10), mask_to_ratio(series, 0.5)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all("_block" in line or "_range" in line.split("], [")[1] for line in windows)


def test_percentiles_in_rounds(spark, monkeypatch):
    """Cells of a few values: at least three rounds, and the same results."""
    monkeypatch.setattr(scoring, "_RANGE_VALUES", 4)
    monkeypatch.setattr(scoring, "_CUTS", 5)
    rounds = []
    refined = scoring._refined
    monkeypatch.setattr(scoring, "_refined", lambda *a: rounds.append(a[2]) or refined(*a))
    rng = random.Random(2)
    rows = [(g, float(rng.choice([rng.random(), rng.randint(0, 30), 7]))) for g in (1, 1, 1, 2) for _ in range(250)]
    rows += [(3, 1.5)] * 40 + [(4, None), (5, float("inf")), (5, 1.0), (None, 2.0)]
    table = spark.createDataFrame(rows, "g int, x double")
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.x for r in scoring.exact_percentiles(table.where("g is not null"), ["g"], "x", shares).collect()}
    assert len(rounds) >= 3 and max(rounds) <= 5
    for g in (1, 2, 3):
        assert got[g] == pytest.approx(list(np.percentile([x for k, x in rows if k == g], [100 * s for s in shares])))
    assert set(got) == {1, 2, 3, 5}
