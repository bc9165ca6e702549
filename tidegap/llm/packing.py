"""Packing of tokenised documents into training sequences, online and in bounded space.

Each partition is read once, in order, with a fixed number of open windows. A document
longer than a window gives full windows of its own; its rest goes into the open window
that it fills best. When it fits into none, the fullest window is emitted and a new one
opened. What is still open at the end of a partition is dealt to groups of a bounded
number of partitions and merged there: the rests are laid end to end and cut at window
ends, so that a group has at most one window that isn't full.

Token ids are those of the given byte-level BPE file. A text is cut before a space that a
non-space follows, where byte-level pre-tokenisation always cuts, and chunks met before
are taken from a bounded cache. New chunks are merged by ``tiktoken`` from the ranks of
the same file, several times faster than by ``tokenizers`` where words are rare; chunks
that may hold a special token go through ``tokenizers`` itself. The tests hold the result
against encoding texts whole.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin

WINDOW = 2048
#: Open windows of a partition.
OPEN = 64
#: Partitions whose rests are merged together.
MERGED = 32
#: Id behind every document.
END = 1
#: Chunks kept by a worker.
CACHE = 500_000
#: Bytes of ids in one batch handed to Spark.
BATCH = 4 << 20

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
# Fixed value: the published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE_AFTER_SPACE = re.compile(r" [\t\n\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A sequence id is the partition, shifted by this, plus a running number.
_SHIFT = 33
#: Sequences of merged rests carry this bit.
_REST = 1 << 62


def _byte_of_letter() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ChunkTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte_of = _byte_of_letter()
        ranks = {bytes(map(byte_of.__getitem__, word)): rank
                 for word, rank in self.tokenizer.get_vocab().items() if word not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.spaced[[rank for word, rank in ranks.items() if word.startswith(b" ")]] = True
        self.special = re.compile("|".join(map(re.escape, sorted(special))) or "(?!)")
        self.known: dict[str, bytes] = {}

    def ids(self, chunk: str) -> bytes:
        ids = (self.tokenizer.encode(chunk, add_special_tokens=False).ids if self.special.search(chunk)
               else self.ranks.encode_ordinary(chunk))
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, parts: list[str]) -> None:
        """Encode parts that stand behind a space, many at a time."""
        odd = [p for p in parts if " " in p or self.special.search(p)]
        self.known.update((p, self.ids(" " + p)) for p in odd)
        plain = list(set(parts).difference(odd)) if odd else parts
        if plain:
            # Each part begins at its space, and holds no other.
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(plain)), dtype="<u4")
            at = [*(4 * np.flatnonzero(self.spaced[ids])).tolist(), 4 * len(ids)]
            data = ids.tobytes()
            self.known.update(zip(plain, (data[a:b] for a, b in zip(at, at[1:]))))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Parts of a text; each but the first stood behind a space where cutting is right."""
        parts = text.split(" ")
        if "" in parts or _SPACE_AFTER_SPACE.search(text):
            parts = re.split(r" (?=\S)", text)
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        self.learn(list(set().union(*(parts[1:] for parts in cut)).difference(self.known)))
        known = self.known.__getitem__
        return [self.ids(parts[0]) + b"".join(map(known, parts[1:])) for parts in cut]


@cache
def tokenizer_of(path: str) -> ChunkTokenizer:
    """One for each worker, which serves many tasks."""
    return ChunkTokenizer(path)


class Windows:
    """The open windows of a partition."""

    def __init__(self, number: int, first_id: int) -> None:
        self.number, self.next_id = number, first_id
        self.free: list[tuple[int, int]] = []  # free places and id, sorted
        self.pieces: dict[int, list[tuple]] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, piece: tuple, length: int) -> list[tuple]:
        """Put a piece where it fits best; returns the pieces of a window closed for it."""
        done: list[tuple] = []
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, window = self.free.pop(at)
        else:
            if len(self.free) == self.number:
                done = self.pieces.pop(self.free.pop(0)[1])
            free, window = WINDOW, self.new_id()
            self.pieces[window] = []
        self.pieces[window].append((*piece, window, WINDOW - free))
        if free > length:
            insort(self.free, (free - length, window))
            return done
        return done + self.pieces.pop(window)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)


def _with_flag(rows: list[tuple], done: bool) -> pa.RecordBatch:
    return _batch(rows).append_column("done", pa.array([done] * len(rows), pa.bool_()))


def _pack(path: str, number: int):
    end = np.array([END], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        windows = Windows(number, TaskContext.get().partitionId() << _SHIFT)
        out, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part["text"].to_pylist()]
                for doc_id, ids in zip(part["doc_id"].to_pylist(), tokenizer.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % WINDOW
                    for start in range(0, whole, WINDOW):
                        out.append((doc_id, start, WINDOW, ids[4 * start:4 * (start + WINDOW)], n, windows.new_id(), 0))
                    if whole < n:
                        out += windows.place((doc_id, whole, n - whole, ids[4 * whole:], n), n - whole)
                    size += len(ids)
                    if size > BATCH:
                        yield _with_flag(out, True)
                        out, size = [], 0
        yield _with_flag(out, True)
        yield _with_flag([p for pieces in windows.pieces.values() for p in pieces], False)

    return pack


def _merge(group: pa.Table) -> pa.Table:
    """Lay pieces end to end and cut them at window ends."""
    rows = sorted(zip(*(group[n].to_pylist() for n in _ARROW.names)), key=lambda r: (r[5], r[6]))
    out, filled, windows = [], 0, 0
    base = _REST | ((rows[0][5] >> _SHIFT) // MERGED << _SHIFT)
    for doc_id, start, length, ids, n, _, _ in rows:
        at = 0
        while at < length:
            step = min(length - at, WINDOW - filled)
            out.append((doc_id, start + at, step, ids[4 * at:4 * (at + step)], n, base + windows, filled))
            at, filled = at + step, filled + step
            if filled == WINDOW:
                filled, windows = 0, windows + 1
    return pa.Table.from_batches([_batch(out)])


def pack(docs: DataFrame, tokenizer: str, number: int = OPEN) -> DataFrame:
    """The pieces of ``docs(doc_id, text)`` with their ids, sequence and place in it.

    Every id of every document (its tokens, then ``END``) lies in exactly one piece; the
    pieces of a sequence follow each other from offset 0 and have at most ``WINDOW`` ids.
    Null and empty texts are the single id ``END``. Repeated rows and null ids are packed
    like any others. Other columns are ignored; an empty table gives no rows. The order of
    documents is that of the table's partitions. ``tokenizer`` is a file that every
    executor can read under the same path.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Written once: the tokens are wanted twice, by what is done and by what is merged.
    pieces = pin(rows.mapInArrow(_pack(tokenizer, number), SCHEMA + ", done boolean"), "pieces")
    group = F.shiftright("sequence_id", _SHIFT) / MERGED
    merged = (pieces.where("not done").drop("done").groupBy(F.floor(group).alias("g"))
              .applyInArrow(_merge, SCHEMA))
    return pieces.where("done").drop("done").unionByName(merged)
