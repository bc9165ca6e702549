"""Removing repeated word passages with suffix automata of reference shards.

Candidates come from ``anchors``. A shard's segments are streamed, earliest first,
through the suffix automaton of those before them. Its matching statistics give, at each
word, the length of the longest stretch ending there that an earlier segment holds; where
it reaches the threshold, the window ending there is a repeat. Then the segment is added.

Automata of the whole corpus would have to meet every document, which is quadratic and
too large to send. So a document meets only the shards that file one of its anchors, and
a shard has a bounded number of segments. Words, not hashes, label the transitions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidegap.llm.anchors import Unit, without_repeats
from tidegap.llm.rows import keyed

WORDS = 20
ANCHOR_WORDS = 8


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def _state(self, length: int, link: int, follow: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(follow)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state for ``p`` followed by ``symbol``, which so far is part of ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list) -> None:
        last = 0
        for symbol in sequence:
            if (q := self.next[last].get(symbol)) is not None:
                last = self._split(last, q, symbol)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, self.next[p][symbol], symbol)
            last = new

    def statistics(self, sequence: list) -> list[int]:
        """At each place the length of the longest known stretch that ends there."""
        state = size = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (to := self.next[state].get(symbol)) is not None:
                state, size = to, size + 1
            out.append(size)
        return out


def comparing(words: int):
    def compare(contents: list[bytes]) -> list[np.ndarray]:
        automaton, out = SuffixAutomaton(), []
        for content in contents:
            sequence = content.split(b" ")
            out.append(np.array(automaton.statistics(sequence)[words - 1:]) >= words)
            automaton.add(sequence)
        return out

    return compare


def remove_repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document with the words left once repeated passages are gone.

    ``docs(doc_id, text)``; other columns are ignored. Words are what stands between
    spaces, tabs and line ends. A window is ``words`` consecutive words of a document; it
    is a repeat if the same words also start earlier: in a document with a smaller id, or
    earlier in the same one. Every word in a repeat goes. Result: ``doc_id, n_words,
    n_removed, n_spans`` (maximal stretches) and ``kept`` (joined by one space).

    Null and empty texts have no words. Null ids come before all others. Rows with equal
    id and text are one document given several times; with equal id and different text
    they are ordered by a hash of the text. An empty table gives no rows.
    """
    unit = Unit(size=words, gram=max(1, min(ANCHOR_WORDS, words)), words=True)
    found = without_repeats(keyed(docs), unit, comparing(words))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", "n_spans", F.col("kept").cast("string").alias("kept"))
