"""Euclidean distances from running sums: the same as from array slices, and as counted out."""

import random
from math import sqrt

import pytest

from tests.brute import candidates
from tidegap.operators.distances import l2_distance, l2_distance_arrays
from tidegap.operators.season_blocks import Shape

PERIOD, WIDTH, SHIFT = 6, 9, 3


@pytest.fixture(scope="module", params=["whole", "tenths", "odd"])
def case(request, make_series, make_queries):
    rng = random.Random(6)
    one = {"whole": lambda: rng.randint(0, 12), "tenths": lambda: rng.randint(0, 99) / 10, "odd": lambda: 10 * rng.random()}[request.param]
    values = {name: [None if rng.random() < gone else one() for _ in range(n)]
              for name, n, gone in (("full", 75, 0), ("some", 83, 0.3), ("most", 80, 0.9), ("short", 13, 0))}
    asked = [(name, i, None) for name, own in values.items() for i in range(0, len(own), 4)]
    return values, make_series(values), make_queries(asked), asked


def by_key(df):
    rows = df.collect()
    found = {(r.series_id, r.q_idx, r.h_idx, r.shift, r.season, r.shift_rank, r.h_value): r.dist for r in rows}
    assert len(found) == len(rows)
    return found


def test_as_from_arrays(case):
    _, series, queries, _ = case
    shape = Shape(PERIOD, WIDTH, SHIFT, query_seasons=2, history_seasons=3)
    got, want = by_key(l2_distance(queries, series, shape)), by_key(l2_distance_arrays(queries, series, shape))
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_as_counted_out(case):
    values, series, queries, asked = case
    got = {k[:4]: d for k, d in by_key(l2_distance(queries, series, Shape(PERIOD, WIDTH, SHIFT))).items()}
    want = {}
    for name, q, _ in asked:
        own = values[name]
        at = lambda i: own[i] if 0 <= i < len(own) and i != q else None  # noqa: B023, E731
        for h, shift, _ in candidates(own, q, PERIOD, WIDTH, SHIFT):
            joint = [(at(q + j), at(h + j)) for j in range(-WIDTH, WIDTH + 1) if j]
            joint = [(a, b) for a, b in joint if a is not None and b is not None]
            if at(h) is not None and joint:
                want[name, q, h, shift] = sqrt(sum((a - b) ** 2 for a, b in joint))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
