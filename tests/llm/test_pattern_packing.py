"""Pattern packing against whole-text encoding, exact round trips and brute force on small sizes."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from tidegap.llm import pattern_packing as packing
from tidegap.llm.queries import QUERIES
from tidegap.llm.word_tokens import tokenizer_of

PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"


def whole(text):
    ids = tokenizer_of(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids
    return [*ids, packing.END]


def check(pieces, docs):
    """Every id in exactly one piece, cut only at ``WINDOW``, sequences gapless from 0."""
    want = sorted((d is not None, d or 0, tuple(whole(t))) for d, t in docs)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
    got = []
    for d, own in by_doc.items():
        # Pieces of rows with one id: follow each text by its pieces.
        expected = [ids for has, i, ids in want if has == (d is not None) and i == (d or 0)]
        cut = sorted((k, a, tuple(ids[a:a + packing.WINDOW])) for ids in expected
                     for k, a in enumerate(range(0, len(ids), packing.WINDOW)))
        assert sorted((p.piece, p.start, tuple(np.frombuffer(p.ids, "<u4").tolist())) for p in own) == cut
        got += own
    assert set(by_doc) == {d for d, _ in docs}
    sequences = {}
    for p in got:
        assert p.length == len(p.ids) // 4
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    return len(sequences)


def test_awkward_documents(frame, docs):
    many = docs + [(100 + i, "tea for two " * i) for i in range(60)] + [(7, "one"), (7, "one")]
    pieces = packing.pack(frame(many), PATH).collect()
    used = check(pieces, many)
    tokens = sum(p.length for p in pieces)
    assert used <= 1.02 * tokens / packing.WINDOW + 2


def test_empty_table(frame):
    assert packing.pack(frame([]), PATH).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op11_best_fit_packing"](spark, FOLDER).collect()
    want = sorted((d, k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes()))
                  for d, t in docs for ids in [whole(t)] for k, a in enumerate(range(0, len(ids), 4096)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


texts = st.text(alphabet=st.one_of(
    st.sampled_from(list("aAbBcsStTdD'.,!1 \t\n\r\x0b\x85\xa0 \x00\x1cΣσςßİıéÉ日🎉½²")), st.characters()), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_ids_are_those_of_whole_texts(some):
    some = [t.encode("utf-8", "ignore").decode() for t in some]  # no lone surrogates in a table
    tokenizer = tokenizer_of(PATH)
    assert tokenizer.encode(some) == [tokenizer.whole(t) for t in some]


@pytest.mark.parametrize("text", ["<|startoftext|>Hi <|endoftext|>there", "</w>", "don't WE'LL", "é ́x", "a‍b"])
def test_ids_of_odd_texts(text):
    tokenizer = tokenizer_of(PATH)
    assert tokenizer.encode([text, "plain text"]) == [tokenizer.whole(text), tokenizer.whole("plain text")]


def test_ids_of_given_texts(spark):
    rows = [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    tokenizer = tokenizer_of(PATH)
    assert tokenizer.encode(rows) == [tokenizer.whole(t) for t in rows]


def test_patterns_are_all_that_fill_a_window():
    got = sorted(tuple(sorted(x for x in p if x)) for p in packing.patterns(12).tolist())
    want = sorted({tuple(c) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 13), n)
                   if sum(c) == 12})
    assert got == want


def test_fit_is_least_squares():
    """Optimality: no pattern, used or not, would lower the error; used ones are balanced."""
    rng = np.random.default_rng(3)
    columns, target = packing.patterns(24), np.concatenate([[0], rng.integers(0, 50, 24)])
    x = packing.fit(columns, target)
    dense = np.stack([np.bincount(c[c > 0], minlength=25) for c in columns], axis=1)
    gain = dense.T @ (target - dense @ x)
    assert (x >= 0).all() and (np.abs(gain[x > 0]) < 1e-3).all()
    lacking = (dense[target == 0] > 0).any(axis=0)
    assert (gain[~lacking] < 1e-3).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, packing.WINDOW), st.integers(1, 5000), max_size=12))
def test_plan_holds_exactly_the_lengths(lengths):
    held, places = {}, {}
    for count, parts in packing.plan(lengths):
        assert sum(n * k for n, k in parts) <= packing.WINDOW and count > 0
        for n, k in parts:
            held[n] = held.get(n, 0) + count * k
    assert held == lengths
    for length, first, last, *_ in packing.places(packing.plan(lengths)):
        places.setdefault(length, []).append((first, last))
    for length, blocks in places.items():
        assert [a for a, _ in sorted(blocks)] == [0, *(b + 1 for _, b in sorted(blocks)[:-1])]
        assert max(b for _, b in blocks) == lengths[length] - 1


def test_many_lengths_come_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, np.maximum(1, rng.lognormal(6.3, 1.2, 20_000).astype(int)))
    lengths[::3] = 1  # a third of all documents are empty
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    used = sum(count for count, _ in packing.plan(histogram))
    assert used <= 1.003 * lengths.sum() / packing.WINDOW + 1
