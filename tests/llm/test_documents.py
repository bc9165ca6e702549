"""Line chunks, decontamination, classifiers and packing on awkward documents."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidegap.llm import decontamination, language, line_chunks, packing, quality
from tidegap.llm.rows import held_out

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_line_chunks(frame, docs):
    rng = random.Random(3)
    block = [f"line {rng.randint(0, 10**6)}" for _ in range(40)]
    rows = docs + [(200 + i, "\n".join([*(f"own {i} {j}" for j in range(rng.randint(0, 6))), *block[i:i + 25], "end"]))
                   for i in range(12)] + [(300, "\n\n\n\n"), (301, "\n\n\n\n\n")]
    table = line_chunks.remove_repeated_chunks(frame(rows))
    assert set(frame(rows).columns) <= set(table.columns)
    want = plain.without_chunks(rows)
    expected = sorted((str(d), *((0, 0, "None") if t is None else (*want[d, t][:2], want[d, t][2]))) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, str(r.text)) for r in table.collect()) == expected
    assert sum(r[2] for r in expected) > 50


def test_line_chunks_of_nothing(frame):
    assert line_chunks.remove_repeated_chunks(frame([])).count() == 0


def items(docs):
    passage = docs[4][1]
    words = passage.split()
    return [(1, " ".join(words[:20])), (2, " ".join(words[10:14])), (3, "one"), (4, None), (5, " .. "), (6, passage),
            (7, " ".join(words[30:43])), (8, "never seen anywhere"), (None, " ".join(words[2:16])), (9, "ab ab ab"),
            (10, " ".join(words[:20])), (11, "A" * 5000)]


@pytest.mark.parametrize("block_rows", [50_000, 9])
def test_contamination(spark, frame, docs, block_rows, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_ROWS", block_rows)
    table = spark.createDataFrame(items(docs), "item_id bigint, text string").withColumn("window", F.lit("x"))
    got = decontamination.contamination(frame(docs), table).collect()
    want = plain.contamination(docs, items(docs))
    expected = sorted((str(d), n, hit, ids, hit > 0 and 20 * hit >= n) for (d, _), (n, hit, ids) in zip(docs, want))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got) == expected
    kept = decontamination.clean(frame(docs), table)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(e[0] for e in expected if not e[4])


def test_contamination_runs_no_python(frame, docs, spark):
    table = spark.createDataFrame([(1, docs[4][1])], "item_id bigint, text string")
    plan = decontamination.contamination(frame(docs), table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_contamination_of_nothing(spark, frame, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(frame([]), none).count() == 0
    assert not any(r.n_hit for r in decontamination.contamination(frame(docs), none).collect())
    one = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert decontamination.contamination(frame([]), one).count() == 0


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_language(spark, frame, docs, corpus):
    known = language.learn(corpus.where(~held_out(F.col("doc_id"))))
    assert sorted(known) == ["de", "en", "es", "fr"]
    found = language.identify(corpus, known).where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.93 * len(found)
    rows = language.identify(frame(docs).withColumn("lang_pred", F.lit(1)), known).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r.lang_score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
        assert r.lang_rejected or r.lang_pred in known
    assert language.identify(frame([]), known).count() == 0
    assert {r.lang_pred for r in language.identify(frame(docs), {}).collect()} == {"und"}


def test_language_margin_means_the_same_at_every_length(corpus):
    """Random words are rejected however many they are, and short texts are not for being short."""
    known = language.learn(corpus.where(~held_out(F.col("doc_id"))))
    coder, rng = language.Coder(known), random.Random(12)
    for n in (1000, 4000, 16_000, 64_000):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(n // 6)]
        assert coder.predict(" ".join(words))[1] < language.MIN_SCORE
    rows = [r for r in corpus.where("text is not null").collect() if len(r.text.split()) >= 30]
    short = [(coder.predict(" ".join(r.text.split()[4:12])), r.lang) for r in rows]
    right = [score >= language.MIN_SCORE for (lang, score), own in short if lang == own]
    assert len(right) >= 0.8 * len(short) and sum(right) >= 0.97 * len(right)


def test_language_sample_is_bounded(spark):
    rows = [(i, "the same text again", "en") for i in range(300)] + [(i, f"ein text {i}", "de") for i in range(300)]
    rows += [(1, None, "en"), (2, "no language", None), (3, "", "de")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = {r.lang: r["count"] for r in language.excerpts(table, 20, 50).groupBy("lang").count().collect()}
    assert counts["en"] <= 1 and 10 <= counts["de"] <= 20
    assert language.learn(table.limit(0)) == {}


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = [(i, f"{lang} words number {i}", lang) for lang, n in zip("abcdefg", (90, 80, 70, 60, 50, 40, 2)) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    counts = {r.lang: r["count"] for r in language.excerpts(table, 14, 50).groupBy("lang").count().collect()}
    assert set(counts) == set("abcdefg") and max(counts.values()) <= 6
    assert sorted(language.learn(table, 14, 50)) == list("abcdefg")


def test_quality(spark, frame, docs, corpus):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    forest = quality.learn(quality.with_statistics(corpus), labels.where(~held_out(F.col("doc_id"))))
    rows = quality.scored(quality.with_statistics(frame(docs)), forest).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty
    none = quality.learn(quality.with_statistics(frame([])), labels.limit(0))
    assert {r.score for r in quality.scored(quality.with_statistics(frame(docs)), none).collect()} == {0.5}
    assert quality.scored(quality.with_statistics(frame([])), forest).count() == 0


def test_trees_find_a_rule():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(3000, len(quality.NAMES)))
    labels = ((values[:, 3] > 0.3) ^ (values[:, 7] > -0.2)).astype(float)
    forest = quality.grow(values[:2000], labels[:2000])
    assert ((forest.score(values[2000:]) > 0.5) == labels[2000:]).mean() > 0.97


def whole(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids


def test_packing(frame, docs):
    rows = docs + [(500, "x " * 9000), (501, "<|endoftext|> between <|endoftext|>"), (502, "two  spaces \n\n and   more 　 ")]
    got = packing.pack(frame(rows), TOKENIZER, 4).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    found = sorted((str(d), b"".join(i for _, i in sorted(parts, key=lambda p: p[0]))) for (d, _), parts in pieces.items()
                   if d not in (4, None))
    want = sorted((str(d), np.array([*whole(t or ""), 1], dtype="<u4").tobytes()) for d, t in rows if d not in (4, None))
    assert found == want
    tokens = sum(len(whole(t or "")) + 1 for _, t in rows)
    assert sum(r.length for r in got) == tokens
    assert len(sequences) <= tokens / packing.WINDOW + 3 * 4 + 1
    assert packing.pack(frame([]), TOKENIZER).count() == 0


def test_padding_is_little(corpus):
    got = packing.pack(corpus, TOKENIZER).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in got) > 0.97 * packing.WINDOW * len(got)


_TOKENIZER = packing.tokenizer_of(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sx1 　é"))))
def test_chunks_encode_as_the_whole(text):
    ids = np.array(_TOKENIZER.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert _TOKENIZER.encode([text]) == [ids]
