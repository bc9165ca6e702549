"""Where texts repeat: the shared plan of the two substring operators.

A window is ``size`` symbols (words or bytes) of one document. Its anchor is the k-gram
in it with the smallest hash, so equal windows have equal anchors wherever they stand,
and consecutive windows mostly share one: they form a segment. Only one small row for
each segment is shuffled, by anchor. Anchors met once cannot hold a repeated window. Of
equal segments all but the first are repeats as a whole; equal ones are merged within a
task already. Where different segments share an anchor, their symbols are fetched, dealt
to shards by anchor and compared there exactly by the method of the operator.

Anchors common to many different segments (a line that many documents hold) would fill
one shard. Each task reports the anchors that several different segments share; these
k-grams rank behind all others in a second pass, so windows that also hold something
rarer are filed under that. Any list gives the same result; it decides balance only. What
is broadcast are the anchors with more than a fixed share of all reports, so their number
has a bound whatever the input.

Rows are told apart by id and the hash of their text. Segment equality is judged by 128
hash bits, of which 64 are those of the anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegap.cluster import pin
from tidegap.llm.rows import same_row

#: Symbols hashed at a time; a longer document is taken in overlapping parts.
CHUNK = 1 << 18
#: Common anchors sent to every task are fewer than this (8 bytes each).
COMMON = 1 << 18
#: Different segments of a chunk from which their anchor is reported.
SHARED = 3
#: Segments of one shard, about.
SHARD = 2000

_U = np.uint64
_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd bases of the two rolling hashes


@dataclass(frozen=True)
class Unit:
    """What a symbol is: how a text is cut, hashed and put together again."""

    size: int  # symbols of a window
    gram: int  # symbols of an anchor
    words: bool

    def cut(self, text: bytes):
        return text.split() if self.words else text

    def hashes(self, symbols) -> np.ndarray:
        if self.words:
            digest = xxhash.xxh64_intdigest
            return np.array([digest(w) for w in symbols], dtype=_U)
        return _BYTES[np.frombuffer(symbols, dtype=np.uint8)]

    def join(self, symbols) -> bytes:
        return b" ".join(symbols) if self.words else bytes(symbols)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(_MULTIPLY[1]))


class Rolling:
    """Hashes of any stretch of a chunk, modulo 2**64, from running sums."""

    def __init__(self, base: int) -> None:
        n = CHUNK + 4096
        self.power = np.multiply.accumulate(np.full(n, base, dtype=_U))
        self.inverse = np.multiply.accumulate(np.full(n, pow(base, -1, 1 << 64), dtype=_U))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, _U), np.cumsum(symbols * self.power[:len(symbols)], dtype=_U)])

    def stretch(self, sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[first]) * self.inverse[first])


_ROLLING: list[Rolling] = []


def segments(unit: Unit, symbols: np.ndarray, part: np.ndarray, common: np.ndarray):
    """``first, windows, anchor, seal`` of each segment of a chunk.

    ``part`` numbers the documents of the chunk's symbols; windows do not cross them.
    """
    if not _ROLLING:
        _ROLLING.extend(map(Rolling, _MULTIPLY))
    n, width = len(symbols) - unit.size + 1, unit.size - unit.gram + 1
    if n <= 0:
        return [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int64)] * 2
    sums = [r.sums(symbols) for r in _ROLLING]
    at = np.arange(len(symbols) - unit.gram + 1)
    grams = _ROLLING[0].stretch(sums[0], at, at + unit.gram)
    order = grams >> _U(1)
    if len(common):
        found = np.searchsorted(common, grams)
        order |= (common[np.minimum(found, len(common) - 1)] == grams).astype(_U) << _U(63)
    order = (order & ~_U((1 << 20) - 1)) | at.astype(_U)
    step = 1
    while 2 * step <= width:
        order = np.minimum(order[:-step], order[step:])
        step *= 2
    if width > step:
        order = np.minimum(order[:-(width - step)], order[width - step:])
    place = (order[:n] & _U((1 << 20) - 1)).astype(np.int64)
    whole = part[:n] == part[unit.size - 1:]
    change = np.flatnonzero((np.diff(place) != 0) | (np.diff(part[:n]) != 0) | (np.diff(whole.astype(np.int8)) != 0)) + 1
    first = np.concatenate([[0], change])
    windows = np.diff(np.concatenate([first, [n]]))
    first, windows = first[whole[first]], windows[whole[first]]
    seal = _ROLLING[1].stretch(sums[1], first, first + windows + unit.size - 1)
    return first, windows, grams[place[first]].view(np.int64), seal.view(np.int64)


def chunks(unit: Unit, batches: Iterator[pa.RecordBatch]):
    """Chunks of documents: ``doc_id``, ``text_hash``, offset in the document, symbols, part."""
    docs, size, seen = [], 0, set()
    for batch in batches:
        for doc_id, text_hash, text in zip(batch["doc_id"].to_pylist(), batch["text_hash"].to_pylist(),
                                           batch["text"].cast(pa.large_binary())):
            cut = unit.cut(text.as_py() or b"")
            start = 0
            while len(cut) - start >= unit.size:
                piece = cut[start:start + CHUNK]
                if docs and size + len(piece) > CHUNK:
                    yield docs
                    docs, size, seen = [], 0, set()
                if (doc_id, text_hash, start) not in seen:  # else the same row again
                    seen.add((doc_id, text_hash, start))
                    docs.append((doc_id, text_hash, start, unit.hashes(piece)))
                    size += len(piece)
                if start + len(piece) == len(cut):
                    break
                start += CHUNK - unit.size + 1
    if docs:
        yield docs


def _of_chunk(unit: Unit, docs: list[tuple], common: np.ndarray):
    part = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    first, windows, anchor, seal = segments(unit, np.concatenate([d[3] for d in docs]), part, common)
    which = part[first]
    begin = np.concatenate([[0], np.cumsum([len(d[3]) for d in docs])])[which]
    start = first - begin + np.array([d[2] for d in docs], dtype=np.int64)[which]
    return which, start, windows, anchor, seal


def _report(unit: Unit):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in chunks(unit, batches):
            _, _, _, anchor, seal = _of_chunk(unit, docs, np.empty(0, _U))
            different = np.unique(np.stack([anchor, seal]), axis=1)[0]
            value, count = np.unique(different, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value[count >= SHARED]), pa.array(count[count >= SHARED])], names=["anchor", "n"])

    return report


def _file(unit: Unit, sent):
    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in chunks(unit, batches):
            which, start, windows, anchor, seal = _of_chunk(unit, docs, sent.value)
            # Order of documents: null ids first, then by id and text.
            rank = np.empty(len(docs), dtype=np.int64)
            rank[sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, docs[i][1], docs[i][2]))] = (
                np.arange(len(docs)))
            order = np.lexsort((start, rank[which], seal, anchor))
            which, start, windows, anchor, seal = (x[order] for x in (which, start, windows, anchor, seal))
            # Equal segments of a chunk travel in one row.
            head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seal[1:] != seal[:-1])]))
            more = np.ones(len(order), dtype=bool)
            more[head] = False
            ids, hashes = pa.array([d[0] for d in docs], pa.int64()), np.array([d[1] for d in docs], dtype=np.int64)
            places = pa.StructArray.from_arrays(
                [ids.take(pa.array(which[more])), pa.array(hashes[which[more]]), pa.array(start[more].astype(np.int32))],
                names=["doc_id", "text_hash", "at"])
            ends = np.append(head, len(order)) - np.arange(len(head) + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[head]), pa.array(seal[head]), ids.take(pa.array(which[head])),
                 pa.array(hashes[which[head]]), pa.array(start[head].astype(np.int32)),
                 pa.array(windows[head].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places,
                                          mask=pa.array(np.diff(ends) == 0))],  # mostly none
                names=["anchor", "seal", "doc_id", "text_hash", "at", "windows", "more"])

    return file


def _fetch(unit: Unit):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                cut = unit.cut(batch["text"][i].cast(pa.binary()).as_py())
                doc_id, text_hash = batch["doc_id"][i].as_py(), batch["text_hash"][i].as_py()
                for s in batch["asked"][i].as_py():
                    rows.append((s["shard"], doc_id, text_hash, s["at"],
                                 unit.join(cut[s["at"]:s["at"] + s["windows"] + unit.size - 1])))
                if len(rows) > 20_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (
                            pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                        names=["shard", "doc_id", "text_hash", "at", "content"])
                    rows = []

    return fetch


#: From the segments of a shard, earliest first, to one array for each: is the window a repeat?
Compare = Callable[[list[bytes]], list[np.ndarray]]


def _compared(unit: Unit, compare: Compare):
    def compared(shard: pa.Table) -> pa.Table:
        # A row that came twice is one place.
        rows = sorted(set(zip(*(shard[c].to_pylist() for c in ("doc_id", "text_hash", "at", "content")))),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out = []
        for (doc_id, text_hash, at, _), again in zip(rows, compare([r[3] for r in rows])):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], again.astype(np.int8), [0]])))
            out += [(doc_id, text_hash, at + a, at + b - 1 + unit.size) for a, b in edge.reshape(-1, 2).tolist()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (
            pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "text_hash", "at", "until"])

    return compared


def repeats(docs: DataFrame, unit: Unit, compare: Compare) -> DataFrame:
    """``doc_id, text_hash, at, until``: stretches covered by windows that also start earlier.

    ``docs`` as from ``keyed``. Stretches of a document may overlap.
    """
    spark = docs.sparkSession
    counts = pin(docs.mapInArrow(_report(unit), "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")),
                 "reported")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # Fewer than COMMON anchors can have more than this share of all reports.
    reported = counts.where(F.col("n") * COMMON > total).select("anchor").toPandas()["anchor"]
    common = spark.sparkContext.broadcast(np.sort(reported.to_numpy(dtype=np.int64).view(_U)))
    filed = docs.mapInArrow(_file(unit, common), (
        "anchor bigint, seal bigint, doc_id bigint, text_hash bigint, at int, windows int, "
        "more array<struct<doc_id: bigint, text_hash: bigint, at: int>>"))
    met = (filed.withColumn("different", F.expr(
               "min(seal) over (partition by anchor) <> max(seal) over (partition by anchor)"))
           .withColumn("rank", F.expr(
               "dense_rank() over (partition by anchor, seal order by doc_id, text_hash, at)"))
           .where("rank > 1 or different or size(more) > 0")
           .select("anchor", "doc_id", "text_hash", "at", "windows", "more", "different", (F.col("rank") > 1).alias("again")))
    met = pin(met, "segments")
    asked = met.where("different and not again")
    shards = max(1, -(-asked.count() // SHARD))
    wanted = (asked.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(
        F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "at", "windows")).alias("asked")))
    wanted = wanted.hint("shuffle_hash")
    fetched = (docs.join(wanted, same_row(docs, wanted))
               .select(docs.doc_id, docs.text_hash, "text", "asked")
               .mapInArrow(_fetch(unit), "shard bigint, doc_id bigint, text_hash bigint, at int, content binary"))
    found = fetched.groupBy("shard").applyInArrow(
        _compared(unit, compare), "doc_id bigint, text_hash bigint, at int, until int")
    none = F.array().cast("array<struct<doc_id: bigint, text_hash: bigint, at: int>>")
    own = F.when(F.col("again"), F.array(F.struct("doc_id", "text_hash", "at"))).otherwise(none)
    whole = (met.select("windows", F.explode(F.concat(own, F.coalesce("more", none))).alias("p"))
             .select("p.doc_id", "p.text_hash", "p.at", (F.col("p.at") + F.col("windows") + unit.size - 1).alias("until")))
    return whole.unionByName(found)


def _without(unit: Unit):
    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for text, spans in zip(part["text"].cast(pa.large_binary()), part["spans"].to_pylist()):
                    cut = unit.cut(text.as_py())
                    edges = np.zeros(len(cut) + 1, dtype=np.int32)
                    for s in spans or ():
                        edges[s["at"]] += 1
                        edges[s["until"]] -= 1
                    gone = np.cumsum(edges[:-1]) > 0
                    ends = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept = [cut[a:b] for a, b in zip([0, *ends[1::2].tolist()], [*ends[::2].tolist(), len(cut)])]
                    kept = b" ".join(w for k in kept for w in k) if unit.words else b"".join(kept)
                    rows.append((len(cut), int(gone.sum()), len(ends) // 2, kept))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["text_hash"], *[pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                    names=["doc_id", "text_hash", "n", "n_removed", "n_spans", "kept"])

    return without


def without_repeats(docs: DataFrame, unit: Unit, compare: Compare) -> DataFrame:
    """``doc_id, text_hash, n, n_removed, n_spans, kept`` for each row of ``docs``."""
    spans = repeats(docs, unit, compare).groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("at", "until")).alias("spans")).hint("shuffle_hash")
    return (docs.join(spans, same_row(docs, spans), "left").select(docs.doc_id, docs.text_hash, "text", "spans")
            .mapInArrow(_without(unit), (
                "doc_id bigint, text_hash bigint, n bigint, n_removed bigint, n_spans bigint, kept binary")))
