import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

#: Names that operators use inside, as extra columns of the input.
CLASHES = ("text_hash", "h1", "h2", "anchor", "print", "key", "component", "copies", "n_words", "spans", "n_lines",
           "block", "ids", "stats", "_gone", "_doc_id", "lines", "window", "items", "cls", "token", "w")


def awkward_docs():
    """Nulls, empty and very long texts, repeats within and across documents, equal rows and ids."""
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Of", "naïve", "x1", "tea", "ruin,", "été", "…"]) + str(rng.randint(0, 60))
    passage = " ".join(word() for _ in range(60))
    long_text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(1500))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "no id at all " + passage), (4, passage), (4, passage),
            (4, "same id, other text " + passage[:200]), (5, "before " + passage + " after"), (6, long_text),
            (7, long_text[:3000] + "\nchanged\n" + long_text[3000:6000]), (8, "a" * 5000), (9, "ab " * 900),
            (10, passage.upper()), (11, "one"), (12, "."), (13, "12 34"), (14, passage + "\n" + passage)]
    for i in range(20, 40):
        start = rng.randint(0, 200)
        cut = passage.split()[start % 30:start % 30 + rng.randint(10, 40)]
        rows.append((i, " ".join([*(word() for _ in range(rng.randint(0, 30))), *cut, *(word() for _ in range(9))])))
    return rows


@pytest.fixture(scope="session")
def docs():
    return awkward_docs()


@pytest.fixture(scope="session")
def frame(spark):
    """Documents as a table, with columns whose names clash with inner ones."""

    def make(rows, clashes=True):
        table = spark.createDataFrame(rows, "doc_id bigint, text string")
        if clashes:
            from pyspark.sql import functions as F
            table = table.select("*", *[F.lit("x").alias(c) for c in CLASHES])
        return table.repartition(3)

    return make
