"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of two fingerprints
that differ in at most 4 bits, one of the three segments differs in at most 1 bit. The
Golay code is perfect: every 23-bit word lies within 3 bits of exactly one codeword. So
one side is filed under the index of its nearest codeword, the other asks under all
codewords within 3 + 1 = 4 bits (5.3 on average); a pair with at most 1 differing bit in
that segment always meets. Pairs that meet are compared in all 64 bits.

With many fingerprints the 4,096 codewords are crowded. Then two segments make a key: of
4 errors, some two of the three segments hold at most 2 together. A fingerprint is filed
under the two nearest codewords of each pair of segments, and asks under all pairs of
codewords within 3 + e and 3 + f bits, e + f at most 2: some 180 askings for 2^24
codeword pairs. Both forms meet every link; the number of fingerprints decides which has
less to do.

Equal fingerprints are one class before anything is joined. Filings and askings of each
key are counted, and a crowded key is dealt to blocks of bounded size, filed times asking,
so no task holds a whole bucket. A block returns a spanning forest of its links, not its
pairs; components do not need more.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidegap.cluster import pin
from tidegap.llm.components import components
from tidegap.llm.rows import keyed, same_row, wrapped

SHINGLE = 4
SEED = 42
BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Rows of one block of a bucket on the filed and on the asking side.
FILED, ASKING = 2048, 8192
#: Different fingerprints from which two segments make a key: a comparison takes a
#: nanosecond, a shuffled row a microsecond.
MANY = 50_000_000
#: The generator polynomial of the code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder by the generator, 0 exactly for codewords; its first 12 bits name a codeword."""
    rest = np.asarray(word, dtype=np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


@cache
def near_errors(radius: int = 4) -> np.ndarray:
    """By syndrome, the error patterns of at most ``radius`` bits, lightest first, then -1."""
    lists: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(radius + 1):
        patterns = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(23), weight)])
        for s, p in zip(syndrome(patterns), patterns):
            lists[s].append(int(p))
    table = np.full((2048, max(map(len, lists))), -1, dtype=np.int64)
    for s, found in enumerate(lists):
        table[s, :len(found)] = found
    return table


def _words(prints: np.ndarray) -> list[np.ndarray]:
    prints = prints.view(np.uint64)
    return [((prints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]


def codeword_keys(prints: np.ndarray, asking: bool) -> np.ndarray:
    """Per fingerprint its keys, or -1: segment number times 4,096 plus codeword index."""
    columns = []
    for number, word in enumerate(_words(prints)):
        errors = near_errors()[syndrome(word)]
        errors = errors if asking else errors[:, :1]
        columns.append(np.where(errors < 0, -1, number * 4096 + ((word[:, None] ^ errors) >> 11)))
    return np.concatenate(columns, axis=1)


def pair_keys(prints: np.ndarray, asking: bool) -> np.ndarray:
    """Per fingerprint its keys of two segments, or -1: number of the pair, then both codeword indices."""
    codes, over = [], []
    for word in _words(prints):
        errors = near_errors(5)[syndrome(word)]
        errors = errors if asking else errors[:, :1]
        codes.append((word[:, None] ^ errors) >> 11)
        # Bits beyond the three of the code itself; a pattern that isn't there is out of reach.
        bits = np.bitwise_count(np.maximum(errors, 0)).astype(np.int64)
        over.append(np.where(errors < 0, 3, np.maximum(bits - 3, 0)))
    columns = []
    for number, (a, b) in enumerate(itertools.combinations(range(len(SEGMENTS)), 2)):
        key = (number << 24) + codes[a][:, :, None] * 4096 + codes[b][:, None, :]
        near = over[a][:, :, None] + over[b][:, None, :] <= BITS * 2 // len(SEGMENTS)
        columns.append(np.where(near, key, -1).reshape(len(prints), -1))
    return np.concatenate(columns, axis=1)


def fingerprint(text: bytes) -> int:
    """64 majority bits over the XXH64 of all 4-word shingles, as a signed number."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    n = max(1, len(found) - SHINGLE + 1)
    starts = [0, *(gaps[:n - 1] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1:].tolist(), len(joined)] if len(found) > SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 4096):  # a very long text stays small in memory
        block = np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += block.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_binary())
    return pa.array([fingerprint(t.as_py() or b"") for t in texts], pa.int64())


def _keys(of, asking: bool):
    """The column function from fingerprints to their lists of keys."""
    def keys(prints: pa.Array) -> pa.Array:
        prints = prints.to_numpy(zero_copy_only=False)
        parts = [_lists(of(prints[i:i + 512], asking)) for i in range(0, len(prints), 512)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(keys, T.ArrayType(T.IntegerType()))


def _lists(keys: np.ndarray) -> pa.Array:
    there = keys >= 0
    ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[there], pa.int32()))


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something not yet joined."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _block_links(block: pa.Table) -> pa.Table:
    """A forest of the links between filed and asking fingerprints of one block."""
    prints = block["print"].to_numpy().view(np.uint64)  # bits of signed numbers are counted without sign
    asks = block["asks"].to_numpy()
    filed, asking = np.unique(prints[~asks]), np.unique(prints[asks])
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for i in range(0, len(asking) if len(filed) else 0, 512):
        part = asking[i:i + 512]
        near = np.bitwise_count(part[:, None] ^ filed[None, :]) <= BITS
        q, f = np.nonzero(near)
        first = filed[near.argmax(axis=1)[q]]
        pairs = np.unique(np.concatenate([np.stack([part[q], first]), np.stack([first, filed[f]])], axis=1), axis=1)
        pairs = pairs[:, pairs[0] != pairs[1]]
        a.append(pairs[0])
        b.append(pairs[1])
    kept = forest(np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64))
    return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})


def dealt(prints: DataFrame, of=codeword_keys) -> DataFrame:
    """``key, f, q, print, asks``: every meeting of a filed and an asking fingerprint is in one block ``key, f, q``."""
    filed = prints.select("print", F.explode(_keys(of, False)("print")).alias("key"))
    asking = prints.select("print", F.explode(_keys(of, True)("print")).alias("key"))
    met = (filed.groupBy("key").agg(F.count(F.lit(1)).alias("filed"))
           .join(asking.groupBy("key").agg(F.count(F.lit(1)).alias("asking")), "key"))
    crowded = pin(met.where((F.col("filed") > FILED) | (F.col("asking") > ASKING)).select(
        "key", F.ceil(F.col("filed") / FILED).cast("int").alias("filed_blocks"),
        F.ceil(F.col("asking") / ASKING).cast("int").alias("asking_blocks")), "crowded")
    n = lambda c: F.coalesce(F.col(c), F.lit(1))
    own = lambda c: F.pmod(F.xxhash64("print", "key"), n(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), n(c) - 1))
    return (filed.join(crowded, "key", "left")
            .select("key", "print", F.lit(False).alias("asks"), own("filed_blocks").alias("f"), every("asking_blocks").alias("q"))
            .unionByName(asking.join(crowded, "key", "left").select(
                "key", "print", F.lit(True).alias("asks"), own("asking_blocks").alias("q"), every("filed_blocks").alias("f"))))


def links(prints: DataFrame, of=None) -> DataFrame:
    """``a, b``: links between different ``print`` values, enough of them for components.

    ``of`` is :func:`codeword_keys` or :func:`pair_keys`; by default the number of
    fingerprints decides.
    """
    of = of or (pair_keys if prints.count() >= MANY else codeword_keys)
    return dealt(prints, of).groupBy("key", "f", "q").applyInArrow(_block_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, print, component, component_id`` for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest id reachable over links of at most 4 bits, itself
    included; ``component`` names the group by one of its fingerprints. Null and empty
    texts have fingerprint 0 and link like any other. Equal rows stay apart in the result
    and share a component; null ids never name a component that has another id. An empty
    table gives no rows.
    """
    rows = pin(keyed(docs).select("doc_id", "text_hash", _fingerprints("text").alias("print")), "prints")
    classes = pin(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = components(pin(links(classes.select("print")), "links"))
    named = (classes.join(found.withColumnRenamed("v", "print"), "print", "left")
             .select("print", F.coalesce("component", "print").alias("component"), "doc_id"))
    heads = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_print = named.join(heads, "component").select("print", "component", "component_id")
    return rows.join(by_print, "print").select("doc_id", "text_hash", "print", "component", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component.

    The smallest id stays; of rows that share it, the one with the smallest text hash,
    and one of equal rows.
    """
    found = near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).select("head.*").distinct()
    rows = wrapped(docs)
    kept = rows.join(heads, same_row(rows, heads), "left_semi")
    return (kept.withColumn("copy", F.expr("row_number() over (partition by doc_id, text_hash order by text_hash)"))
            .where("copy = 1").select("row.*"))
