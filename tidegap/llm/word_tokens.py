"""Token ids of a word-level BPE file with word ends, for many texts with rare words.

Such a tokenizer drops white space, so a text may be cut there, and parts met before are
taken from a bounded cache. New parts are merged by ``tiktoken`` from the ranks of the
same file: the word end becomes the byte 0 behind each word, and as the tokens of a single
byte with a word end rank below all merges, that byte joins its letter first, as in the
file's own rules. ``tokenizers`` itself encodes parts that hold a special token, texts with
control characters on which the two would cut differently, and texts with a letter for
which a probe of both gives different ids. The tests hold the ids against ``tokenizers``.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np

#: Parts kept by a worker.
CACHE = 250_000
# Fixed value: the published pre-tokenisation pattern; a line feed stands between parts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n"
#: Byte 0 is the word end here; the others are no white space to ``tokenizers``.
_ODD = re.compile("[\x00\x1c-\x1f]")


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = _byte_of_letter()
        ranks = {}
        for word, rank in self.tokenizer.get_vocab().items():
            if word not in special:
                ends = word.endswith("</w>") and word != "</w>"
                ranks[bytes(map(byte_of.__getitem__, word[:-4] if ends else word)) + b"\0" * ends] = rank
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.between = ranks[b"\n\0"]
        self.words = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, bool] = {chr(i): True for i in range(128)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(self, parts: list[str]) -> list[bytes]:
        words = self.words("\n".join(parts))
        ids = np.array(self.ranks.encode_ordinary("\0".join(words) + "\0" if words else ""), dtype="<u4")
        data, at = ids.tobytes(), [-1, *np.flatnonzero(ids == self.between).tolist(), len(ids)]
        return [data[4 * a + 4:4 * b] for a, b in zip(at, at[1:])]

    def same(self, letter: str) -> bool:
        """Whether both ways agree on a letter: no mark that joins others, same case, same kind."""
        probes = [letter, "a" + letter + "b", "1" + letter, "!" + letter + "!"]
        return (unicodedata.combining(letter) == 0 and letter != "Σ"
                and self.merged([p.lower() for p in probes]) == [self.whole(p) for p in probes])

    def plain(self, text: str) -> bool:
        """Whether a text may be cut at white space and merged part by part."""
        there = np.zeros(0x110000, dtype=bool)
        there[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")] = True
        letters = [chr(i) for i in np.flatnonzero(there)]
        for letter in letters:
            if letter not in self.letters:
                self.letters[letter] = self.same(letter)
        return (all(map(self.letters.__getitem__, letters)) and not _ODD.search(text)
                and not self.special.search(text) and unicodedata.is_normalized("NFC", text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.plain("\n".join(texts)):
            return [self.merge_texts([t])[0] if self.plain(t) else self.whole(t) for t in texts]
        return self.merge_texts(texts)

    def merge_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts: each different part is looked up or merged once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        # One string for all different parts: none of them holds a line feed.
        n = len(coded.dictionary)
        parts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), pa.scalar("\n", pa.large_string()))[0].as_py().split("\n")[:n]
        if len(self.known) > CACHE:
            self.known.clear()
        found = list(map(self.known.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            for i, ids in zip(new, self.merged([parts[i] for i in new])):
                found[i] = self.known[parts[i]] = ids
        # Copy the ids of each part to all places where it stands.
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(size[at])])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[
            np.repeat(start[at] - ends[:-1], size[at]) + np.arange(ends[-1])]
        data, bounds = ids.tobytes(), 4 * ends[cut.offsets.to_numpy()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each worker, which serves many tasks."""
    return WordTokenizer(path)
