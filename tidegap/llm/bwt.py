"""Removing repeated byte strings with a threshold-bounded Burrows-Wheeler transform.

Candidates come from ``anchors``. The segments of a shard, earliest first, are laid end
to end. Suffixes are sorted only as deep as the threshold, by doubling. Common prefixes
follow from the transform alone, in increasing order: the interval of a string is
extended backward by every byte before it, and the end of each new interval that has no
value yet gets the present length. The search goes in breadth, one length after the
other, and stops at the threshold; ends that have no value then share at least so many
bytes. All intervals of one length are handled at once in numpy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tidegap.llm.anchors import Unit, without_repeats
from tidegap.llm.rows import keyed

BYTES = 100
ANCHOR_BYTES = 24
#: Stands between segments; no UTF-8 text holds it.
_BETWEEN = b"\xff"


def bounded_suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by at least ``depth`` symbols; symbols are below 512, 0 ends the text."""
    n, reach = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(reach, np.int64)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(reach):
        key = (key << np.uint64(9)) | padded[j:n + j]
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if reach >= depth or new.all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = rank << np.uint64(32)
        key[:max(0, n - reach)] |= rank[reach:]
        reach *= 2


def new_prefix(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each row of the sorted suffixes: does it share under ``depth`` symbols with the row before?"""
    n = len(order)
    transform = symbols[order - 1]  # the end stands before the first symbol
    by_symbol = np.argsort(transform, kind="stable")
    mapping = np.empty(n, dtype=np.int64)  # row of the suffix that is one symbol longer
    mapping[by_symbol] = np.arange(n)
    before, behind = np.full(n, -1), np.full(n, n)  # nearest rows with the same symbol
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    behind[by_symbol[:-1][same]] = by_symbol[1:][same]
    valued = np.zeros(n + 1, dtype=bool)
    valued[[0, n]] = True
    low, high = np.array([0]), np.array([n])  # the interval of the empty string
    for _ in range(depth):
        size = high - low
        row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)
        first = row[before[row] < np.repeat(low, size)]
        last = row[behind[row] >= np.repeat(high, size)]
        # Strings of one length have disjoint intervals, so sorting pairs their ends.
        begin, end = np.sort(mapping[first]), np.sort(mapping[last]) + 1
        found = ~valued[end]
        low, high = begin[found], end[found]
        if not len(low):
            break
        valued[high] = True
    return valued[:n]


def comparing(size: int):
    def compare(contents: list[bytes]) -> list[np.ndarray]:
        text = np.frombuffer(_BETWEEN.join(contents), dtype=np.uint8).astype(np.int16) + 1
        symbols = np.concatenate([text, np.zeros(1, np.int16)])
        order = bounded_suffix_array(symbols, size)
        group = np.flatnonzero(new_prefix(symbols, order, size))
        earliest = np.empty(len(order), dtype=np.int64)
        earliest[order] = np.repeat(np.minimum.reduceat(order, group), np.diff(np.append(group, len(order))))
        again = earliest < np.arange(len(order))
        start, out = 0, []
        for content in contents:
            out.append(again[start:start + len(content) - size + 1])
            start += len(content) + 1
        return out

    return compare


def remove_repeated_bytes(docs: DataFrame, size: int = BYTES) -> DataFrame:
    """One row per document with the bytes left once repeated strings are gone.

    ``docs(doc_id, text)``; other columns are ignored. The text is its UTF-8 bytes. A
    string of ``size`` bytes is a repeat if it also starts earlier: in a document with a
    smaller id, or earlier in the same one; overlaps count. Every byte in a repeat goes.
    Result: ``doc_id, n_bytes, n_removed, n_spans`` (maximal runs) and ``kept`` (binary:
    a cut may fall inside a character).

    Null texts are empty. Null ids come before all others. Rows with equal id and text
    are one document given several times; with equal id and different text they are
    ordered by a hash of the text. An empty table gives no rows.
    """
    unit = Unit(size=size, gram=max(1, min(ANCHOR_BYTES, size)), words=False)
    found = without_repeats(keyed(docs), unit, comparing(size))
    return found.select("doc_id", found.n.alias("n_bytes"), "n_removed", "n_spans", "kept")
