"""Collocations against plain counting; the graph against phrases counted one by one."""

import re
from collections import Counter

import pytest

from tidegap.llm import collocations as mined


def phrases(rows):
    """By language: occurrences of all phrases of up to four words, by plain loops."""
    found = {}
    for lang, text in rows:
        counts = found.setdefault("und" if lang is None else lang, Counter())
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                counts.update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    return found


def plain(rows, least, top):
    out = []
    for lang, f in phrases(rows).items():
        total = sum(n for p, n in f.items() if len(p) == 1)
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        around = Counter()
        for q, n in candidates.items():
            for size in range(2, len(q)):
                for i in range(len(q) - size + 1):
                    around[q[i:i + size]] = max(around[q[i:i + size]], n)
        found = []
        for p, a in candidates.items():
            if 100 * around[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total, -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows(docs):
    refrain = "zu Ebb' und Flut, the tide-mark moves again on the long grey shore"
    own = [(["fr", "de", None, "und"][i % 4], text) for i, (_, text) in enumerate(docs)]
    own += [("en", f"{refrain}. {i} {refrain} a a a a a b; x\ty  z"[i % 7:]) for i in range(40)]
    own += [("en", refrain.upper()), ("en", "a a a a a a a a a"), (None, "\x0b\x0c"), ("", "no name, no name"), ("de", None)]
    return own


def table(spark, rows):
    from pyspark.sql import functions as F
    made = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return made.select("*", *[F.lit(1).alias(c) for c in ("phrase", "n", "word", "size", "node", "rank")])


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7), (1, 40)])
def test_against_plain_counting(spark, rows, least, top):
    some = rows if least > 1 else rows[-30:]
    got = mined.collocations(table(spark, some), least, top).collect()
    assert sorted(map(tuple, got)) == plain(some, least, top)


def test_flow_gives_shorter_counts(spark, rows):
    """Counts from edges and ends are those of phrases counted themselves."""
    docs = table(spark, rows)
    edges = mined.edge_counts(mined.coded(docs), 1)
    want = phrases(rows)
    for size, counts in mined.flows(edges).items():
        got = {(r.lang, r.phrase): r.n for r in counts.collect()}
        assert got == {(lang, " ".join(p)): n for lang, f in want.items() for p, n in f.items() if len(p) == size}


def test_paths_hold_each_edge_once(spark, rows):
    docs = table(spark, rows)
    often = {k: f.where("n >= 3") for k, f in mined.flows(mined.edge_counts(mined.coded(docs), 3)).items()}
    paths, inside = mined.unary_paths(often[4], often[3])
    held = Counter()
    longest = 0
    for r in paths.collect():
        w = r.phrase.split(" ")
        longest = max(longest, len(w))
        held.update((r.lang, " ".join(w[i:i + 4]), r.n) for i in range(len(w) - 3))
    assert held == Counter((r.lang, r.phrase, r.n) for r in often[4].collect())
    assert longest >= 10 and inside.count() > 0  # the refrain is compacted


def test_wrong_bits_change_nothing(spark, rows, monkeypatch):
    """A bit table far too small takes rare words for frequent ones; the results stay."""
    monkeypatch.setattr(mined, "_PIECE", 8)
    monkeypatch.setattr(mined, "MOST_BITS", 8)
    import pyspark.sql.functions as F
    monkeypatch.setattr(F, "bitmap_construct_agg", lambda c: F.lit(b"\xff"))
    got = mined.collocations(table(spark, rows), 5, 7).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, 7)


def test_empty_table(spark):
    assert mined.collocations(table(spark, [("en", "x")]).limit(0)).count() == 0
    assert mined.collocations(table(spark, [("en", None), (None, "")])).count() == 0
