"""The learnt operators and the pipeline's ends against slow plain versions."""

import math
import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from tidegap.llm import language, packing, quality
from tidegap.llm.rows import held_out

FOLDER = "/root/testdata/sf0.001"
KINDS = [string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t\r\v\f\n", None, ",;:", ".", "?'\"()-", "|", "!",
         "#$%&*", "/\\<>=@_[]{}+~^`"]


def plain_statistics(text):
    """One statistic after the other, byte by byte."""
    data = text.encode()
    if not data:
        return [0.0] * len(quality.NAMES)
    words = [w for w in re.split(rb"[ \t\n\v\f\r]+", data) if w]
    lines, n = data.split(b"\n"), max(1, len([w for w in re.split(rb"[ \t\n\v\f\r]+", data) if w]))
    shares = [sum(b >= 128 if kind is None else b < 128 and chr(b) in kind for b in data) / len(data) for kind in KINDS]
    letters = lambda w: [chr(b) for b in w if b < 128 and chr(b) in string.ascii_letters]
    upper = sum(bool(letters(w)) and all(c.isupper() for c in letters(w)) for w in words)
    marked = sum(not all(b < 128 and chr(b) in string.ascii_letters + string.digits for b in w) for w in words)
    entropy = -sum(c / len(data) * math.log2(c / len(data)) for c in (data.count(bytes([b])) for b in set(data)))
    return [math.log(1 + len(data)), math.log(1 + len(words)), len(data) / n, math.log(1 + len(lines)),
            math.log(1 + len(data) / len(lines)), *shares, len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n, len(set(lines)) / len(lines), upper / n, marked / n if words else 1.0,
            sum(len(w) == 1 for w in words) / n, sum(len(w) > 14 for w in words) / n, len(set(data)), entropy,
            sum(w.istitle() for w in words) / n]


def plain_forest(values, labels, trees):
    """Boosted trees in loops: rows of ``(column, above)`` by node, leaves, and the prior."""
    n, d = len(values), len(values[0])
    rate = (sum(labels) + 1) / (n + 2)
    total = [math.log(rate / (1 - rate))] * n
    cuts = [np.unique(np.quantile([v[j] for v in values], np.linspace(0, 1, quality.BINS + 1)[1:-1])).tolist() for j in range(d)]
    out = []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-t)) for t in total]
        slope, bend = [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]
        members, splits = {0: list(range(n))}, {}
        for node in range(2**quality.DEPTH - 1):
            own, best = members.get(node, []), (1e-9, 0, math.inf)
            every_g, every_h = sum(slope[i] for i in own), sum(bend[i] for i in own)
            for j in range(d):
                for cut in cuts[j]:
                    left = [i for i in own if values[i][j] <= cut]
                    gl, hl = sum(slope[i] for i in left), sum(bend[i] for i in left)
                    gr, hr = every_g - gl, every_h - hl
                    if hl < quality.LEAST / 4 or hr < quality.LEAST / 4:
                        continue
                    score = lambda g, h: g * g / (h + quality.PENALTY)
                    gain = score(gl, hl) + score(gr, hr) - score(every_g, every_h)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut)
            splits[node] = best[1:]
            members[2 * node + 1] = [i for i in own if not values[i][best[1]] > best[2]]
            members[2 * node + 2] = [i for i in own if values[i][best[1]] > best[2]]
        leaves = []
        for node in range(2**quality.DEPTH - 1, 2**(quality.DEPTH + 1) - 1):
            own = members[node]
            leaves.append(quality.RATE * sum(slope[i] for i in own) / (sum(bend[i] for i in own) + quality.PENALTY))
            for i in own:
                total[i] += leaves[-1]
        out.append((splits, leaves))
    return out, math.log(rate / (1 - rate))


def plain_score(forest, row):
    trees, total = forest
    for splits, leaves in trees:
        node = 0
        while node in splits:
            column, above = splits[node]
            node = 2 * node + 1 + (row[column] > above)
        total += leaves[node - len(splits)]
    return 1 / (1 + math.exp(-total))


def test_statistics_are_as_counted(docs):
    odd = ["", " ", "\n\n", "A", "AB cd. E2 Éa", "x" * 20 + " X-Y Title Case", "a\tb\x0bc\x0cd\re", "|!$/\\ ~`", "😀 ß"]
    for text in odd + [t for _, t in docs if t is not None]:
        assert quality.statistics(text.encode()) == pytest.approx(plain_statistics(text), abs=1e-9), text[:60]


@pytest.mark.parametrize("seed", range(3))
def test_trees_are_as_grown_in_loops(monkeypatch, seed):
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "BINS", 8)
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=(260, 4)), 2)
    values[:, 3] = rng.integers(0, 3, 260)
    labels = ((values[:, 0] + 0.4 * rng.normal(size=260) > 0) ^ (values[:, 3] == 2)).astype(float)
    got, want = quality.grow(values, labels), plain_forest(values.tolist(), labels.tolist(), 4)
    fresh = np.vstack([values, rng.normal(size=(200, 4)), np.zeros((1, 4))])
    assert got.score(fresh) == pytest.approx([plain_score(want, row) for row in fresh.tolist()], abs=1e-9)


def test_scores_of_documents(spark, frame, docs):
    """Learnt on the given labels, on awkward documents: flat arrays and loops give the same scores."""
    corpus, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(quality.with_statistics(corpus), labels.where(~held_out(F.col("doc_id"))))
    trees = [({i: (int(c), float(a)) for i, (c, a) in enumerate(zip(column, above))}, leaf.tolist())
             for column, above, leaf in zip(forest.column, forest.above, forest.leaf)]
    got = quality.scored(quality.with_statistics(frame(docs)), forest).collect()
    want = [plain_score((trees, forest.base), quality.statistics((t or "").encode())) for _, t in docs]
    assert sorted(r.score for r in got) == pytest.approx(sorted(want), abs=1e-12)


def plain_language(known, text):
    """The smallest sum of compressed blocks, one dictionary after the other."""
    if not text or not known or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, sizes = text.lower().encode(), {}
    for lang in sorted(known):
        dictionary = zstandard.ZstdCompressionDict(known[lang].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = 0
        for i in range(0, len(data), language.BLOCK_BYTES):
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False)
            size += len(coder.compress(data[i:i + language.BLOCK_BYTES]))
        sizes[lang] = size
    if len(sizes) == 1:
        return next(iter(sizes)), 1.0
    ranked = sorted(sizes, key=lambda lang: (sizes[lang], lang))
    margin = (sizes[ranked[1]] - sizes[ranked[0]]) / sizes[ranked[0]]
    odds = (language.MIN_SCORE / (1 - language.MIN_SCORE)) ** (margin / known.floor) if margin / known.floor < 1000 else math.inf
    return ranked[0], 1.0 if odds == math.inf else odds / (1 + odds)


def test_language_is_as_compressed_in_a_loop(spark, frame, docs):
    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet")
    known = language.learn(corpus.where(~held_out(F.col("doc_id"))))
    rng = random.Random(1)
    letters = [c for c in "abcdefghi éüñ"]
    rows = docs + [(500 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 90)))) for i in range(30)]
    rows += [(r.doc_id, r.text) for r in corpus.limit(40).collect()]
    got = {(r.doc_id, r.text): (r.lang_pred, r.lang_score, r.lang_rejected) for r in language.identify(frame(rows), known).collect()}
    for key in got:
        lang, score = plain_language(known, key[1])
        assert got[key][0] == lang and got[key][1] == pytest.approx(score, abs=1e-9)
        assert got[key][2] == (lang == "und" or got[key][1] < language.MIN_SCORE)


def test_pipeline_ends(spark):
    """First stage: the documents whose plain prediction is not rejected. Last: every id in its piece."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    corpus = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(90).persist()
    known = language.learn(corpus.where(~held_out(F.col("doc_id"))))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, corpus, FOLDER).collect()}
    want = set()
    for r in corpus.collect():
        lang, score = plain_language(known, r.text)
        want |= {r.doc_id} if lang != "und" and score >= language.MIN_SCORE else set()
    assert kept == want
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.pack(spark, corpus, FOLDER).collect()
    for r in corpus.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [packing.END]
        own = sorted((p.start, np.frombuffer(p.ids, "<u4").tolist()) for p in pieces if p.doc_id == r.doc_id)
        assert [i for _, part in own for i in part] == ids
        assert [a for a, _ in own] == np.cumsum([0, *(len(part) for _, part in own)])[:-1].tolist()


def test_pipeline_of_nothing_and_of_clashing_columns(spark, frame, docs, tmp_path):
    """No documents give no pieces; columns named as inner ones stay as they are up to the last stage."""
    import corpus_pipeline

    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    given = frame(docs).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    now = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).persist()
        assert now.columns == given.columns, name
        assert now.where("anchor <> 'x' or stats <> 'x' or ids <> 'x'").count() == 0
    assert 0 < now.count() <= given.count()
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()
