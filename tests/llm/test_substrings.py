"""Repeated passages and byte strings against plain Python."""

import random

import numpy as np
import plain
import pytest

from tidegap.llm import anchors, automata, bwt


def check(got, docs, size, words, id_of):
    want = plain.without_repeats(docs, size, words)
    expected = sorted((str(d), n, len(gone), plain.spans(gone), kept)
                      for d, t in docs for n, gone, kept in [want[d, t or ""]])
    assert sorted((str(r[0]), r[1], r[2], r[3], id_of(r[4])) for r in got) == expected


@pytest.mark.parametrize("size", [5, 20])
def test_passages(frame, docs, size):
    got = automata.remove_repeated_passages(frame(docs), size).collect()
    check(got, docs, size, True, str.encode)


@pytest.mark.parametrize("size", [30, 100])
def test_bytes(frame, docs, size):
    got = bwt.remove_repeated_bytes(frame(docs), size).collect()
    check(got, docs, size, False, bytes)


def test_many_chunks_and_common_anchors(frame, docs, monkeypatch):
    """Chunks so small that long documents are cut and repeats meet across chunks."""
    common = "a line that stands in every document of this table, word for word"
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(30)) + common
             + " ".join(f"v{rng.randint(0, 99)}" for _ in range(30))) for i in range(60)] + docs[3:10]
    monkeypatch.setattr(anchors, "CHUNK", 700)
    monkeypatch.setattr(anchors, "SHARD", 20)
    unit = anchors.Unit(size=40, gram=12, words=False)
    # In this process: what the tasks would do with so small a chunk.
    seen = {}
    for unit_docs in anchors.chunks(unit, _batches(rows)):
        for doc_id, _, start, hashed in unit_docs:
            seen.setdefault(doc_id, []).append((start, len(hashed)))
    assert all(b[0] == a[0] + 700 - 39 for parts in seen.values() for a, b in zip(parts, parts[1:]) if b[0])
    got = bwt.remove_repeated_bytes(frame(rows), 40).collect()
    check(got, rows, 40, False, bytes)


def _batches(rows):
    import pyarrow as pa
    yield pa.RecordBatch.from_pydict({
        "doc_id": [d for d, _ in rows], "text_hash": [plain.text_hash(t) for _, t in rows],
        "text": [t or "" for _, t in rows]})


def test_common_anchors_change_nothing():
    rng = np.random.default_rng(1)
    unit = anchors.Unit(size=12, gram=4, words=False)
    symbols = unit.hashes(bytes(rng.integers(97, 100, 3000, dtype=np.uint8)))
    part = np.repeat([0, 1], 1500)
    plainly = anchors.segments(unit, symbols, part, np.empty(0, np.uint64))
    common = np.sort(np.unique(plainly[2][:200]).view(np.uint64))
    for first, windows, _, _ in (plainly, anchors.segments(unit, symbols, part, common)):
        covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, windows)])
        assert covered.tolist() == [i for i in range(3000 - 11) if part[i] == part[i + 11]]


def test_empty_table(frame):
    assert automata.remove_repeated_passages(frame([])).count() == 0
    assert bwt.remove_repeated_bytes(frame([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_methods_on_random_sequences(seed):
    rng = random.Random(seed)
    for _ in range(40):
        size, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice([b"ab", b"abc", bytes(range(97, 110))])
        contents = [bytes(rng.choice(letters) for _ in range(rng.randint(size, 40))) for _ in range(rng.randint(1, 8))]
        seen = set()
        for content, got in zip(contents, bwt.comparing(size)(contents)):
            keys = [content[i:i + size] for i in range(len(content) - size + 1)]
            assert got.tolist() == [k in seen or k in keys[:i] for i, k in enumerate(keys)]
            seen.update(keys)
        words = [b" ".join(bytes([x]) for x in content) for content in contents]
        seen = set()
        for content, got in zip(contents, automata.comparing(size)(words)):
            keys = [content[i:i + size] for i in range(len(content) - size + 1)]
            assert got.tolist() == [k in seen for k in keys]
            seen.update(keys)
