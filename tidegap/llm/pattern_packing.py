"""Packing of whole documents by patterns of lengths, fitted by non-negative least squares.

Only lengths matter for which documents may share a sequence, and there are at most
``WINDOW`` of them whatever the size of the corpus. So the driver gets a histogram of the
lengths, and plans on it:

1. Lengths are rounded up to whole grains. Patterns are all multisets of up to ``FEW``
   grain counts that fill a window.
2. How often each pattern is used is the non-negative least-squares fit of the patterns to
   the histogram, by an active set; rounded down, it is a whole number of sequences.
3. A pattern takes documents of its real lengths, the longest of a bin first. What is left
   of the histogram goes, longest first, into the smallest hole that takes it, or into new
   sequences; equal sequences are one row with a count.

The plan has some ten thousand rows at most. It deals out places: the n-th document of a
length gets the n-th place of that length. Tasks number their pieces by length while
tokenising; a sum over tasks makes that a number in the corpus. So no document is moved
for being packed, and a length that a third of all documents have is like any other.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegap.cluster import pin, scratch_path
from tidegap.llm.word_tokens import tokenizer_of

WINDOW = 4096
#: Tokens of a grain, most documents of an enumerated pattern.
GRAIN, FEW = 8, 3
#: Id behind every document.
END = 1
#: Characters encoded together, bytes of ids in one batch handed to Spark.
TOGETHER, BATCH = 1_000_000, 2 << 20
#: More than any number of pieces of one length.
_STRIDE = 1 << 50

_PIECE = [("doc_id", pa.int64(), "bigint"), ("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"),
          ("length", pa.int64(), "bigint"), ("ids", pa.binary(), "binary"),
          ("part", pa.int32(), "int"), ("nth", pa.int64(), "bigint")]
_SCHEMA = ", ".join(f"{name} {kind}" for name, _, kind in _PIECE)


def _pieces(path: str):
    """The function that tokenises, cuts at ``WINDOW`` and numbers pieces of equal length."""
    end = np.array([END], dtype="<u4").tobytes()

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(_PIECE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, _PIECE)],
                                          names=[name for name, _, _ in _PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = tokenizer_of(path), TaskContext.get().partitionId()
        met = [0] * (WINDOW + 1)
        rows: list[tuple] = []

        def cut(docs: list[tuple]) -> Iterator[pa.RecordBatch]:
            size = 0
            for (doc_id, _), ids in zip(docs, tokenizer.encode([t for _, t in docs])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * WINDOW)):
                    own = ids[at:at + 4 * WINDOW]
                    n = len(own) // 4
                    rows.append((doc_id, piece, at // 4, n, own, part, met[n]))
                    met[n] += 1
                size += len(ids)
                if size > BATCH:
                    yield batch_of(rows)
                    rows.clear()
                    size = 0
            yield batch_of(rows)
            rows.clear()

        docs, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):  # one text at a time in Python
                docs.append((doc_id.as_py(), text.as_py() or ""))
                size += len(docs[-1][1])
                if size >= TOGETHER:
                    yield from cut(docs)
                    docs, size = [], 0
        yield from cut(docs)

    return run


def patterns(grains: int, few: int = FEW) -> np.ndarray:
    """All multisets of at most ``few`` grain counts that sum to ``grains``; 0 fills up."""
    found = [(a, *rest) for rest in combinations_with_replacement(range(grains + 1), few - 1)
             if (a := grains - sum(rest)) >= max(rest, default=0)]
    return np.array(found, dtype=np.int64).reshape(-1, few)


def fit(columns: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often to use each pattern: least squares over patterns, none negative.

    Row ``g`` of the implied matrix counts how often grain count ``g`` is in a pattern.
    The classical active set: the pattern that lowers the error fastest enters, and one
    that would turn negative leaves.
    """
    target = wanted.astype(float)

    @cache
    def column(c: int) -> np.ndarray:
        return np.bincount(columns[c][columns[c] > 0], minlength=len(target)).astype(float)

    def matrix(chosen: list[int]) -> np.ndarray:
        return np.stack([column(c) for c in chosen], axis=1)

    x, chosen = np.zeros(len(columns)), []
    tolerance = 1e-6 * max(1.0, target.max(initial=0))
    barred = ((target[columns] <= 0) & (columns > 0)).any(axis=1)  # hold a length that no document has
    for _ in range(4 * len(target)):
        rest = target - (matrix(chosen) @ x[chosen] if chosen else 0)
        rest[0] = 0
        gain = rest[columns].sum(axis=1)
        gain[chosen] = 0
        gain[barred] = 0
        enter = int(gain.argmax())
        if gain[enter] <= tolerance:
            break
        chosen.append(enter)
        while True:
            a = matrix(chosen)
            own = a.T @ a
            own[np.diag_indices_from(own)] += 1e-9
            best = np.linalg.solve(own, a.T @ target)
            if (best > 0).all():
                x[chosen] = best
                break
            if best[-1] <= 0 and chosen[-1] == enter and x[enter] == 0:
                barred[enter] = True  # rounding only: it would leave at once
            now = x[chosen]
            low = best <= 0
            step = np.min(now[low] / np.maximum(now[low] - best[low], 1e-300))
            x[chosen] = now + step * (best - now)
            leave = [c for c, b, v in zip(chosen, best, x[chosen]) if b <= 0 and v <= 1e-9]
            x[leave] = 0
            chosen = [c for c in chosen if c not in leave]
            if not chosen:
                break
    return x


class Holes:
    """Sequences under way: kinds ``[count, lengths]`` by the room they have left."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.kinds: dict[int, list[tuple[int, list]]] = {}
        self.full: list[tuple[int, list]] = []

    def add(self, count: int, lengths: list[tuple[int, int]]) -> None:
        room = WINDOW - sum(n * times for n, times in lengths)
        if room == 0:
            self.full.append((count, lengths))
            return
        if room not in self.kinds:
            insort(self.rooms, room)
        self.kinds.setdefault(room, []).append((count, lengths))

    def place(self, length: int, number: int) -> None:
        """``number`` pieces of a length, each where the least room is left after it."""
        while number:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = WINDOW // length
                if number >= each:
                    self.add(number // each, [(length, each)])
                if number % each:
                    self.add(1, [(length, number % each)])
                return
            room = self.rooms[at]
            count, lengths = self.kinds[room].pop()
            if not self.kinds[room]:
                del self.kinds[room]
                self.rooms.pop(at)
            each = min(room // length, number)
            used = min(count, number // each)
            if used < count:
                self.add(count - used, lengths)
            self.add(used, [*lengths, (length, each)])
            number -= used * each

    def all(self) -> list[tuple[int, list]]:
        return self.full + [kind for kinds in self.kinds.values() for kind in kinds]


def plan(lengths: dict[int, int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of sequences, ``(how many, [(length, times), ...])``, that hold exactly these lengths."""
    left = np.zeros(WINDOW + 1, dtype=np.int64)
    for length, number in lengths.items():
        left[length] = number
    grains = WINDOW // GRAIN
    up = -(-np.arange(WINDOW + 1) // GRAIN)
    bins = np.bincount(up, weights=left, minlength=grains + 1).astype(np.int64)
    holes, columns = Holes(), patterns(grains)
    often = fit(columns, bins) if bins.any() else np.zeros(len(columns))
    longest = np.arange(grains + 1) * GRAIN  # where a bin has documents left, from above
    for chosen in np.argsort(-often, kind="stable"):
        times = int(often[chosen] + 1e-6)
        if times == 0:
            break
        parts = columns[chosen][columns[chosen] > 0]
        kinds, each = np.unique(parts, return_counts=True)
        times = min(times, int((bins[kinds] // each).min()))
        bins[kinds] -= times * each
        while times:
            taken = []
            for part in parts:
                while left[longest[part]] == 0:
                    longest[part] -= 1
                taken.append(int(longest[part]))
            own, each_own = np.unique(taken, return_counts=True)
            # At the end of a length one sequence mixes it with the next one of the bin.
            some = int(min(times, (left[own] // each_own).min()))
            if some == 0:
                taken, some = [], 1
                for part in parts:
                    while left[longest[part]] == 0:
                        longest[part] -= 1
                    left[longest[part]] -= 1
                    taken.append(int(longest[part]))
                own, each_own = np.unique(taken, return_counts=True)
            else:
                left[own] -= some * each_own
            holes.add(some, [(int(n), int(k)) for n, k in zip(own, each_own)])
            times -= some
    for length in np.flatnonzero(left)[::-1].tolist():
        holes.place(length, int(left[length]))
    return holes.all()


def places(kinds: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple]:
    """``(length, first, last, sequence, offset, times)`` of each block of places.

    The pieces numbered ``first`` to ``last`` of a length go, ``times`` to a sequence, to
    the sequences from ``sequence`` on, from ``offset`` on.
    """
    met: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in kinds:
        offset = 0
        for length, times in lengths:
            first = met.get(length, 0)
            met[length] = first + count * times
            rows.append((length, first, met[length] - 1, sequence, offset, times))
            offset += length * times
        sequence += count
    return rows


@lru_cache(256)
def _before(numbers: str, part: int) -> np.ndarray:
    """By length, how many pieces the tasks before ``part`` have."""
    from pyarrow import dataset, fs

    store, folder = fs.FileSystem.from_uri(numbers)
    table = dataset.dataset(f"{folder}/part={part}", filesystem=store, format="parquet").to_table()
    found = np.zeros(WINDOW + 1, dtype=np.int64)
    found[table["length"].to_numpy()] = table["before"].to_numpy()
    return found


def _seats(numbers: str, blocks: list[tuple]):
    """The function from task, length and number in the task to sequence and offset.

    ``blocks`` are those of :func:`places`. How many pieces of a length the tasks before
    had is read from ``numbers``, one small file for each task.
    """
    length, first, last, sequence, at, times = np.array(sorted(blocks, key=lambda b: (b[0], b[2])), np.int64).reshape(-1, 6).T
    ends = length * _STRIDE + last

    def seat(part: pa.Array, size: pa.Array, nth: pa.Array) -> pa.Array:
        part, size, nth = (a.to_numpy(zero_copy_only=False) for a in (part, size, nth))
        for one in np.unique(part):
            own = part == one
            nth = np.where(own, nth + _before(numbers, int(one))[np.where(own, size, 0)], nth)
        block = np.searchsorted(ends, size * _STRIDE + nth)
        nth = nth - first[block]
        return pa.StructArray.from_arrays([pa.array(sequence[block] + nth // times[block]),
                                           pa.array(at[block] + nth % times[block] * size)], ["sequence_id", "offset"])

    return seat


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece of ``docs(doc_id, text)``.

    A document is its ids, then ``END``; one of more than ``WINDOW`` ids is cut into pieces
    of that length and a last one, any other is one piece. The pieces of a sequence follow
    each other from offset 0 and have at most ``WINDOW`` ids. Null and empty texts are the
    single id ``END``. Repeated rows and null ids are packed like any others. Other columns
    are ignored; an empty table gives no rows. ``tokenizer`` is a file that every executor
    can read under the same path.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Written once: numbers given by a task must not change when it is asked again.
    pieces = pin(rows.mapInArrow(_pieces(tokenizer), _SCHEMA), "pieces")
    per_task = pin(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most 4,096 rows come to the driver.
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not histogram:
        return pieces.select("doc_id", "piece", "start", "length", "ids",
                             F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    numbers = scratch_path(spark, "numbers")
    (per_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
     .repartition("part").write.partitionBy("part").parquet(numbers))
    seat = F.arrow_udf(_seats(numbers, places(plan(histogram))), "sequence_id long, offset long")
    return (pieces.withColumn("seat", seat("part", "length", "nth"))
            .select("doc_id", "piece", "start", "length", "ids", "seat.sequence_id", "seat.offset"))
