"""The registered queries next to their SQL, or what can be said of them without."""

import sys

import pytest

from checks.compare import connect, difference
from tidegap.llm.oracles import ORACLES
from tidegap.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(ORACLES[name]).df()) is None


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert sorted(set(QUERIES) - set(ORACLES)) == [
        "op11_best_fit_packing", "op4_quality_classifier", "op5_packing", "op7_language_id", "op9_simhash_near_dedup"]


def test_quality_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = QUERIES["op4_quality_classifier"](spark, FOLDER).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.9 * len(good) * len(bad)


def test_pipeline_against_plain_python(spark):
    """Every stage's rows from the stage before, by the plain versions of the operators."""
    import corpus_pipeline
    import plain

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item_rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = stage(spark, docs, FOLDER).persist()
        if name != "packing":
            assert after.columns == docs.columns
            got = sorted((r.doc_id, r.text) for r in after.select("doc_id", "text").collect())
        if name == "language_id":
            assert set(got) <= set(before) and len(got) >= 0.95 * len(before)
        elif name == "line_dedup":
            want = plain.without_chunks(before)
            assert got == sorted((d, want[d, t][2]) for d, t in before)
            assert after.where("n_chars <> char_length(text)").count() == 0
        elif name == "simhash_near_dedup":
            prints = {d: plain.fingerprint(t) for d, t in before}
            group = plain.components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
            heads = {}
            for d, p in prints.items():
                heads[group[p]] = min(d, heads.get(group[p], d))
            assert [d for d, _ in got] == sorted(heads.values())
        elif name == "decontamination":
            found = plain.contamination(before, item_rows)
            assert got == sorted(r for r, (n, hit, _) in zip(before, found) if not (hit > 0 and 20 * hit >= n))
        else:
            assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {d for d, _ in before}
        docs = after


def test_entry_without_this_package(tmp_path):
    """The rest of the repository imports and registers its queries without these folders."""
    import os
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q[:2] == 'op'])"],
                          cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.strip().endswith("[]")


def test_plans_do_not_broadcast_or_cross(spark):
    """Substring operators: no cartesian product, and documents join on their keys."""
    from tidegap.llm import automata
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = automata.remove_repeated_passages(docs.limit(50))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
