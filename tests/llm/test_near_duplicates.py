"""SimHash groups, embedding groups and components against plain Python."""

import random

import numpy as np
import plain
import pytest

from tidegap.llm import cap_filters, golay
from tidegap.llm.components import components


def test_code_is_perfect():
    table = golay.near_errors()
    weight = np.bitwise_count(np.where(table < 0, 0, table).astype(np.uint32))
    assert ((weight <= 3) & (table >= 0)).sum(axis=1).tolist() == [1] * 2048


def test_close_segments_share_a_key():
    rng = np.random.default_rng(4)
    prints = rng.integers(-2**63, 2**63 - 1, 3000)
    for bits in range(5):
        other = prints.copy()
        for row in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[row] ^= np.int64(1) << np.int64(b)
        filed, asking = golay.codeword_keys(prints, False), golay.codeword_keys(other, True)
        assert all(set(f) & set(a) - {-1} for f, a in zip(filed.tolist(), asking.tolist()))


def test_two_close_segments_share_a_key():
    """Four errors in any places: some pair of segments is met; one bit more need not be."""
    rng = np.random.default_rng(5)
    prints = rng.integers(-2**63, 2**63 - 1, 1500)
    for bits in range(5):
        other = prints.copy()
        for row in range(len(other)):
            # All in one segment, or anywhere.
            places = rng.choice(23, bits, replace=False) + 23 * (row % 2) if row % 3 else rng.choice(64, bits, replace=False)
            for b in places:
                other[row] ^= np.int64(1) << np.int64(b)
        filed, asking = golay.pair_keys(prints, False), golay.pair_keys(other, True)
        assert filed.shape[1] == 3 and (filed >= 0).all()
        assert all(set(f) & set(a) - {-1} for f, a in zip(filed.tolist(), asking.tolist()))
    assert 150 < (asking >= 0).sum(axis=1).mean() < 220


@pytest.mark.parametrize("of", [golay.codeword_keys, golay.pair_keys])
def test_crowded_keys_are_dealt(spark, monkeypatch, of):
    """Blocks of bounded size, every pair that shares a key in one of them, and the links of all pairs."""
    monkeypatch.setattr(golay, "FILED", 16)
    monkeypatch.setattr(golay, "ASKING", 40)
    rng = np.random.default_rng(6)
    family = np.array([0] + [np.int64(1) << np.int64(a) | np.int64(1) << np.int64(b) for a in range(30) for b in range(a)], dtype=np.int64)
    prints = np.unique(np.concatenate([family, rng.integers(-2**63, 2**63 - 1, 100)]))
    table = spark.createDataFrame([(int(p),) for p in prints], "print bigint")
    rows = golay.dealt(table, of).persist()
    sizes = rows.groupBy("key", "f", "q", "asks").count().groupBy("asks").max("count").collect()
    most = {r.asks: r["max(count)"] for r in sizes}
    assert most[False] <= 3 * 16 and most[True] <= 3 * 40
    met = {}
    for r in rows.collect():
        met.setdefault((r.key, r.f, r.q, r.asks), set()).add(r.print)
    pairs = {(a, b) for (k, f, q, asks), found in met.items() if not asks for a in found for b in met.get((k, f, q, True), ())}
    near = {(int(a), int(b)) for a in prints for b in prints if int(a ^ b).bit_count() <= 4 or (int(a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert near <= pairs
    found = {r.v: r.component for r in components(golay.links(table, of)).collect()}
    want = plain.components(sorted(map(int, prints)), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {p: found.get(p, p) for p in map(int, prints)} == want


def expected_groups(docs):
    prints = [plain.fingerprint(t) for _, t in docs]
    group = plain.components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    smallest = {}
    for (d, _), p in zip(docs, prints):
        if d is not None:
            smallest[group[p]] = min(d, smallest.get(group[p], d))
    return sorted((str(d), f"{p:016x}", smallest.get(group[p])) for (d, _), p in zip(docs, prints))


@pytest.mark.parametrize("many", [golay.MANY, 0])
def test_simhash(frame, docs, monkeypatch, many):
    monkeypatch.setattr(golay, "MANY", many)
    rng = random.Random(8)
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(150))
    near = [(100 + i, base.replace(f"w{i} ", "other ", 1)) for i in range(60)]
    rows = docs + near
    got = golay.near_duplicates(frame(rows)).collect()
    assert sorted((str(r.doc_id), f"{r.print & (2**64 - 1):016x}", r.component_id) for r in got) == expected_groups(rows)
    kept = golay.representatives(frame(rows))
    assert len(kept.columns) > 10
    names = [r.doc_id for r in kept.collect()]
    prints = [plain.fingerprint(t) for _, t in rows]
    group = plain.components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    heads = {}  # an id given to several texts may head several groups
    for (d, _), p in zip(rows, prints):
        heads[group[p]] = min(d if d is not None else 10**9, heads.get(group[p], 10**9))
    assert sorted(n for n in names if n is not None) == sorted(h for h in heads.values() if h < 10**9)


def test_simhash_of_nothing(frame):
    assert golay.near_duplicates(frame([])).count() == 0
    assert golay.representatives(frame([])).count() == 0


def test_dense_block_is_a_forest():
    import pyarrow as pa
    prints = [1 << i for i in range(40)] + [0]
    block = pa.table({"print": pa.array(prints * 2, pa.int64()), "asks": [False] * 41 + [True] * 41})
    assert golay._block_links(block).num_rows == 40


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(300, 340)] + [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)]
    links += [(400, 400 + i) for i in range(60)] + [(7, 7), (None, 3)]
    rng.shuffle(links)
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    real = {frozenset(x) for x in links if None not in x}
    nodes = sorted({n for x in real for n in x})
    want = plain.components(nodes, lambda a, b: frozenset((a, b)) in real)
    found = {r.v: r.component for r in got.collect()}
    assert {n: found.get(n, n) for n in nodes} == want


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    rows, next_id = [], 0
    for label in (0, 1, None):
        for _ in range(60):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 5)):
                rows.append((next_id, (centre + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist(), label))
                next_id += 1
    crowd = rng.normal(size=16)
    rows += [(5000 + i, (crowd + rng.normal(size=16) * 0.03).tolist(), 1) for i in range(150)]
    rows += [(7000, rows[0][1], 0), (7000, rows[0][1], 0), (7001, [2 * x for x in rows[0][1]], 0), (None, rows[0][1], 0)]
    rows += [(8000 + i, v, 0) for i, v in enumerate(
        [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] * 16, [1.0, 2.0]])]
    table = spark.createDataFrame([(*r, "x", "x") for r in rows],
                                  "vec_id bigint, embedding array<float>, label int, cls string, vector string").repartition(4)
    got = cap_filters.near_duplicates(table).collect()

    def unit(v):
        v = None if v is None or None in v else np.array(v, dtype=np.float32).astype(np.float64)
        return None if v is None or not len(v) or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]

    def linked(a, b):
        return (rows[a][2] is not None and rows[a][2] == rows[b][2] and units[a] is not None and units[b] is not None
                and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.93)

    n = range(len(rows))
    group = plain.components(n, linked)
    smallest = {}
    for i in n:
        if rows[i][0] is not None:
            smallest[group[i]] = min(rows[i][0], smallest.get(group[i], rows[i][0]))
    want = sorted((str(rows[i][0]), sum(linked(i, j) for j in n if j != i), smallest.get(group[i])) for i in n)
    found = sorted((str(r.vec_id), r.n_links, r.component_id) for r in got)
    assert len(found) == len(want)
    # Found links are right; hardly any is missed.
    assert all(f[1] <= w[1] for f, w in zip(found, want) if f[0] == w[0])
    assert sum(f[1] for f in found) >= 0.999 * sum(w[1] for w in want)
    assert sum(f == w for f, w in zip(found, want)) >= 0.99 * len(want)


@pytest.mark.parametrize("directions", [128, 1024])
def test_embeddings_with_codes_of_large_tables(spark, directions, monkeypatch):
    """The code of a table with so many classes a label finds the pairs of a small one."""
    monkeypatch.setattr(cap_filters, "FEWEST", directions)
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(2, 600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.931 * x + (1 - 0.931**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(np.vstack([x, y]))],
                                  "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in cap_filters.near_duplicates(table).collect()}
    assert sum(got[i] != (1, i % 600) for i in range(1200)) <= 2


def test_codes_hold_their_bound():
    for dimensions, directions in ((64, 32), (64, 1024), (16, 512), (3, 32)):
        rng = np.random.default_rng(9)
        x, y = rng.normal(size=(2, 4000, dimensions))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y = 0.93 * x + (1 - 0.93**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        apart = np.ones(len(x), dtype=bool)
        for number in range(cap_filters.codes(dimensions, directions, 0.93)):
            a, b = cap_filters.caps(x, directions, number), cap_filters.caps(y, directions, number)
            apart &= ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        assert apart.sum() <= 3


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert cap_filters.near_duplicates(empty).count() == 0
