"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of the whole text are computed once per document. The trees are grown on a
bounded sample of labelled rows: values are replaced by their bin, and every level of a
tree takes one histogram of gradients per node and statistic. The finished forest is a
few flat arrays that numpy walks for a whole batch of documents at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidegap.cluster import pin

#: Labelled rows learnt from at most, about.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 120, 4, 64, 0.15, 8.0
PENALTY = 1.0
#: Score from which label 1 is predicted.
THRESHOLD = 0.7

NAMES = ("log_bytes", "log_words", "word_bytes", "lines", "line_bytes", "lower", "upper", "digit", "space",
         "high", "comma", "full_stop", "other_mark", "bar", "exclamation", "dollar_etc", "slash_etc",
         "distinct_words", "repeat_next", "distinct_lines", "upper_words", "marked_words", "one_letter_words",
         "long_words", "distinct_bytes", "entropy", "capital_starts")


def _classes() -> np.ndarray:
    """Byte value to share columns: which statistic a byte counts for."""
    kinds = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f\n",
             bytes(range(128, 256)), b",;:", b".", b"?'\"()-", b"|", b"!", b"#$%&*", b"/\\<>=@_[]{}+~^`"]
    table = np.zeros((256, len(kinds)))
    for column, kind in enumerate(kinds):
        table[list(kind), column] = 1
    return table


_CLASSES = _classes()


def statistics(text: bytes) -> list[float]:
    """The statistics in the order of ``NAMES``; all 0 for an empty text."""
    size = len(text)
    if not size:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    found, lines = text.split(), text.split(b"\n")
    n = max(1, len(found))
    p = counts[counts > 0] / size
    return [
        np.log1p(size), np.log1p(len(found)), size / n, np.log1p(len(lines)), np.log1p(size / len(lines)),
        *(counts @ _CLASSES / size).tolist(),
        len(set(found)) / n, sum(map(bytes.__eq__, found, found[1:])) / n, len(set(lines)) / len(lines),
        sum(map(bytes.isupper, found)) / n, 1 - sum(map(bytes.isalnum, found)) / n,
        sum(len(w) == 1 for w in found) / n, sum(len(w) > 14 for w in found) / n,
        len(p), float(-(p * np.log2(p)).sum()), sum(map(bytes.istitle, found)) / n,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    return pa.array([statistics(t.as_py() or b"") for t in texts], pa.list_(pa.float64()))


@dataclass
class Forest:
    """Nodes of all trees in breadth order: split column, threshold, value of leaves."""

    column: np.ndarray  # trees x inner nodes
    above: np.ndarray  # trees x inner nodes: go right where the value is above this
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, values: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(values)), np.full(len(values), self.base)
        for column, above, leaf in zip(self.column, self.above, self.leaf):
            node = np.zeros(len(values), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (values[rows, column[node]] > above[node])
            total += leaf[node - len(column)]
        return 1 / (1 + np.exp(-total))


def grow(values: np.ndarray, labels: np.ndarray) -> Forest:
    """Boost ``TREES`` trees on the logistic loss. Without labels of both kinds: a constant."""
    inner, n, d = 2**DEPTH - 1, *values.shape
    rate = (labels.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    column, above = np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, inner + 1))
    if n == 0 or labels.min() == labels.max():
        return Forest(column, above, leaf, base)
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], values[:, j]) for j in range(d)], axis=1)
    total = np.full(n, base)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, bend = labels - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-9)
            for j in range(d):
                place = at * BINS + binned[:, j]
                g = np.bincount(place, slope, width * BINS).reshape(width, BINS)
                h = np.bincount(place, bend, width * BINS).reshape(width, BINS)
                gl, hl = g.cumsum(axis=1), h.cumsum(axis=1)
                gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                gain = (gl**2 / (hl + PENALTY) + gr**2 / (hr + PENALTY)
                        - gl[:, -1:]**2 / (hl[:, -1:] + PENALTY))
                gain[(hl < LEAST / 4) | (hr < LEAST / 4)] = -1
                gain[:, len(cuts[j]):] = -1
                split = gain.argmax(axis=1)
                for k in np.flatnonzero(gain.max(axis=1) > best):
                    best[k] = gain[k, split[k]]
                    column[tree, first + k], above[tree, first + k] = j, cuts[j][split[k]]
            node = 2 * node + 1 + (values[np.arange(n), column[tree, node]] > above[tree, node])
        at = node - inner
        g, h = np.bincount(at, slope, inner + 1), np.bincount(at, bend, inner + 1)
        leaf[tree] = RATE * g / (h + PENALTY)
        total += leaf[tree, at]
    return Forest(column, above, leaf, base)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every row, written once."""
    return pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                           _statistics(F.coalesce("text", F.lit(""))).alias("stats")), "stats")


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grow a forest on at most about ``sample`` labelled rows, chosen by a hash of the id.

    Labels that are null, and labels or documents whose id is null, teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")
                          ).where("quality in (0, 1) and doc_id is not null")
    n = known.count()
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11).cast("double") / float(1 << 53)
    few = known.where(u < F.lit(sample / max(1, n))).dropDuplicates(["doc_id", "quality"])
    rows = (stats.dropna(subset=["doc_id"]).join(few, "doc_id").groupBy("doc_id", "stats", "quality").count()
            .select("stats", "quality").orderBy("doc_id", "quality").limit(2 * sample).collect())  # the bounded sample
    values = np.array([r[0] for r in rows]).reshape(len(rows), len(NAMES))
    return grow(values, np.array([r[1] for r in rows], dtype=np.float64))


def scored(stats: DataFrame, forest: Forest) -> DataFrame:
    """``stats`` with ``score`` (0 to 1, higher: label 1 likelier).

    Null and empty texts have statistics 0 and are scored like any other; equal texts get
    equal scores; without usable labels every score is the prior. Empty in, empty out.
    """
    sent = stats.sparkSession.sparkContext.broadcast(forest)  # fixed number of trees

    @F.arrow_udf("double")
    def score(found: pa.Array) -> pa.Array:
        values = np.asarray(found.flatten()).reshape(len(found), len(NAMES))
        return pa.array(sent.value.score(values), pa.float64())

    return stats.withColumn("score", score("stats"))
