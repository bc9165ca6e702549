"""Embedding near-duplicates with spherical-cap filters from a structured random code.

A filter is the cap of unit vectors around a direction. Directions are a product code:
the space is rotated at random and cut in two halves, each half has its own random unit
vectors, and every pair of them is a direction. The code can be list-decoded: with the
scores of both halves sorted, the best directions of a vector are read off without trying
the others. A vector is in the caps of its ``CAPS`` best directions. With one threshold for
all vectors instead, many would be in hardly any cap, since the directions' scores share
the few scores of the halves. Vectors at random hardly share a cap, so links are looked
for among the members of a cap and verified there.

The rotation is uniform, so how likely a pair shares no cap depends on its cosine and on
the number of dimensions, not on the data. This is measured on drawn pairs for the code
at hand, and independent codes are added until all of them miss a pair at the threshold
with a probability of ``MISS`` at most.

Caps that share their first half travel together: a vector is sent once for each first
half, not for each cap. A crowded one is cut into blocks that meet in pairs. Within a
block only members of one cap are compared; a pair that meets in several caps counts in
the first. A block returns how many links
each vector has in it and a spanning forest, never the pairs. Equal vectors are one class
before all this.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidegap.cluster import pin
from tidegap.llm.components import components

COSINE = 0.93
#: Members of a cap aimed at, and caps of a vector in a code; the code's size follows from these.
MEMBERS, CAPS = 64, 40
#: Directions of each half at least and at most.
FEWEST, MOST = 32, 4096
#: Vectors of one block.
BLOCK = 1024
#: Probability that a pair at the threshold shares no cap, at most.
MISS = 1e-4
#: Pairs drawn to measure a code, misses after which fewer are enough, and codes at most.
DRAWN, ENOUGH, CODES = 40_000, 200, 256
SEED = 20240117


@cache
def code(dimensions: int, directions: int, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and the unit vectors of both halves, the same in every task."""
    rng = np.random.default_rng([SEED, dimensions, directions, number])
    rotation = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))[0]
    half = max(1, dimensions // 2)
    sides = [rng.normal(size=(directions, n)) for n in (half, dimensions - half)]
    sides = [s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-30) for s in sides]
    return rotation, *sides


def _best(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``n`` largest scores of each row, largest first."""
    place = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    value = np.take_along_axis(scores, place, axis=1)
    order = np.argsort(-value, axis=1)
    return np.take_along_axis(place, order, axis=1), np.take_along_axis(value, order, axis=1)


def caps(vectors: np.ndarray, directions: int, number: int = 0) -> np.ndarray:
    """The ``CAPS`` best directions of each unit vector, list-decoded.

    They are numbers in which ``MOST`` values of the second half follow on one of the
    first, and ``MOST`` values of that on one of ``number``.
    """
    rotation, left, right = code(vectors.shape[1], directions, number)
    turned, half = vectors @ rotation, left.shape[1]
    n = min(CAPS, directions)
    (first, a), (second, b) = _best(turned[:, :half] @ left.T, n), _best(turned[:, half:] @ right.T, n)
    # A pair of ranks has as many pairs before it as their product, so further ones are not among the best.
    i, j = np.nonzero(np.outer(np.arange(1, n + 1), np.arange(1, n + 1)) <= CAPS)
    best = np.argpartition(-(a[:, i] + b[:, j]), CAPS - 1, axis=1)[:, :CAPS]
    found = (number * MOST + first[:, i]) * MOST + second[:, j]
    return np.take_along_axis(found, best, axis=1)


def missed(dimensions: int, directions: int, cosine: float, number: int) -> float:
    """Upper limit (95 %) of the share of pairs at ``cosine`` that share no cap of a code."""
    rng = np.random.default_rng([SEED, dimensions, directions, number, 1])
    drawn = misses = 0
    while drawn < DRAWN and misses < ENOUGH:
        x, y = (_rows_of_length_1(rng.normal(size=(500, dimensions))) for _ in range(2))
        if dimensions == 1:
            y = x
        else:
            y = _rows_of_length_1(y - (y * x).sum(axis=1, keepdims=True) * x)
            y = cosine * x + max(0.0, 1 - cosine**2) ** 0.5 * y
        both = np.sort(np.hstack([caps(x, directions, number), caps(y, directions, number)]), axis=1)
        misses += int((np.diff(both, axis=1) != 0).all(axis=1).sum())
        drawn += len(x)
    # Above the 95 % limit of a Poisson number, which is 3.0 where none was missed.
    return min(1.0, (misses + 3 + 2 * misses**0.5) / drawn)


@cache
def codes(dimensions: int, directions: int, cosine: float) -> int | None:
    """So many codes miss a pair at ``cosine`` with ``MISS`` at most; none if ``CODES`` do not do."""
    chance = 1.0
    for number in range(CODES):
        chance *= missed(dimensions, directions, cosine, number)
        if chance <= MISS:
            return number + 1
        if number == 3 and chance > 0.9:
            return None
    return None


def plan(dimensions: int, largest: int, cosine: float) -> tuple[int, int]:
    """Directions of each half, and codes, for labels of up to ``largest`` classes.

    Fewer directions than a cap's members ask for where those would take more than four
    times the codes, as in few dimensions: comparisons go with codes by square of directions.
    """
    wanted = np.log2(max(1, CAPS * largest / MEMBERS)) / 2  # members = largest * CAPS / directions ** 2
    directions = int(min(MOST, max(FEWEST, 2 ** np.ceil(wanted))))
    n = codes(dimensions, directions, cosine)
    while directions > FEWEST and (n is None or n > 4):
        fewer = codes(dimensions, directions // 2, cosine)
        if n is not None and (fewer is None or 4 * fewer >= n):
            break
        directions, n = directions // 2, fewer
    if n is None:
        raise ValueError(f"no {CODES} codes find pairs of cosine {cosine} in {dimensions} dimensions")
    return directions, n


def _rows_of_length_1(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, in double precision, of length 1."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    values /= np.abs(values).max(axis=1, keepdims=True)
    return _rows_of_length_1(values)


def _caps(plans: dict[int, tuple[int, int]]):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def found(vectors: pa.Array) -> pa.Array:
        """The caps of each vector in order, of all its codes."""
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        out: list = [None] * len(vectors)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for i in range(0, len(rows), 512):
                part = rows[i:i + 512]
                units, (directions, n) = _unit(vectors.take(pa.array(part))), plans[int(size)]
                for at, own in zip(part, np.sort(np.hstack([caps(units, directions, c) for c in range(n)]), axis=1)):
                    out[at] = own
        return pa.array(out, pa.list_(pa.int64()))

    return found


def _meetings(lists: pa.Array, lo: np.ndarray, hi: np.ndarray, least: int, end: int):
    """For each cap from ``least`` to ``end`` the places in ``lo`` and in ``hi`` that it holds."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    cap = lists.flatten().to_numpy(zero_copy_only=False)
    row, cap = row[(cap >= least) & (cap < end)], cap[(cap >= least) & (cap < end)]
    order = np.argsort(cap, kind="stable")
    row, cap = row[order], cap[order]
    place = np.full((2, len(lists)), -1)
    place[0, lo], place[1, hi] = np.arange(len(lo)), np.arange(len(hi))
    for own in np.split(row, np.flatnonzero(np.diff(cap)) + 1) if len(row) else ():
        a, b = (p[p >= 0] for p in place[:, own])
        if len(a) and len(b):
            yield a, b


def _block(cosine: float):
    def block(rows: pa.Table) -> pa.Table:
        first = rows["first"][0].as_py()
        vectors = _unit(rows["vector"].combine_chunks())
        sides, lists = rows["side"].to_numpy(), rows["caps"].combine_chunks()
        cls, copies = rows["cls"].to_numpy(), rows["copies"].to_numpy()
        lo, hi = np.flatnonzero(sides <= 0), np.flatnonzero(sides >= 0)  # 0: both, a block with itself
        near = np.zeros((len(lo), len(hi)), dtype=bool)
        for a, b in _meetings(lists, lo, hi, first * MOST, (first + 1) * MOST):
            near[np.ix_(a, b)] |= vectors[lo[a]] @ vectors[hi[b]].T >= cosine
        near &= cls[lo][:, None] != cls[hi][None, :]
        # What met under an earlier first half has been counted there.
        x, y = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        for a, b in _meetings(lists, lo[x], hi[y], 0, first * MOST):
            near[np.ix_(x[a], y[b])] = False
        links = np.zeros(len(cls), dtype=np.int64)
        links[lo] += near @ copies[hi]
        if (sides != 0).any():
            links[hi] += copies[lo] @ near
        # Smallest class reachable within the block, over the rows that have links.
        label, some = cls.copy(), np.flatnonzero(links)
        near = near[np.ix_(x, y)]
        x, y = lo[x], hi[y]
        while len(some):
            old = label[some]
            label[x] = np.minimum(label[x], np.where(near, label[y][None, :], np.iinfo(np.int64).max).min(axis=1))
            label[y] = np.minimum(label[y], np.where(near, label[x][:, None], np.iinfo(np.int64).max).min(axis=0))
            if (old == label[some]).all():
                break
        return pa.table({"a": cls[some], "b": label[some], "links": links[some]})

    return block


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and not null and the cosine of their embeddings,
    in double precision, is at least ``cosine``. An embedding that is null, empty, all
    zero, or holds a null or non-finite number links with nothing, nor do embeddings of
    different length. ``n_links`` counts other rows, also rows equal in everything;
    ``component_id`` is the smallest id reachable, itself included. A null id never names
    a component that has another id. An empty table gives no rows.

    A link at the threshold itself is missed with a probability of at most ``MISS``, a
    closer one with less, whatever the size of the table; vectors that are equal are never
    missed.
    """
    spark = vectors.sparkSession
    single = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    sound = F.coalesce(
        F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(F.col("vector"), lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector")).select(
        "vec_id", "label", "vector", sound.alias("sound"),
        F.xxhash64("vector", "label").alias("h1"), F.xxhash64(F.lit(1), "label", "vector").alias("h2"))
    classes = pin(rows.where("sound").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", F.size("vector").alias("d")).count().groupBy("d").agg(F.max("count").alias("n"))
    plans = {d: plan(d, n, cosine) for d, n in largest.collect()}  # one row for each number of dimensions
    filed = pin(classes.select("cls", "label", "copies", "vector", _caps(plans)("vector").alias("caps")), "caps")
    # One number for the code and its first half.
    firsts = F.array_distinct(F.transform("caps", lambda c: F.floor(c / MOST)))
    at = filed.withColumn("first", F.explode(firsts)).withColumn("d", F.size("vector"))
    key = ["label", "d", "first"]
    counts = at.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    # Every row goes to each pair of blocks that its own belongs to.
    dealt = (at.join(counts, key).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*key, "cls", "copies", "vector", "caps", F.least("own", "other").alias("lo"),
                     F.greatest("own", "other").alias("hi"),
                     F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1)
                     .otherwise(1).alias("side")))
    found = pin(dealt.groupBy(*key, "lo", "hi").applyInArrow(
        _block(cosine), "a bigint, b bigint, links bigint"), "links")
    reached = components(found.select("a", "b"))
    named = (classes.select("cls", "label", "h1", "h2", "vec_id", "copies")
             .join(reached.withColumnRenamed("v", "cls"), "cls", "left")
             .join(found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cls"), "cls", "left")
             .withColumn("component", F.coalesce("component", "cls")))
    heads = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    known = named.join(heads, "component").select(
        "label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    narrow = rows.select("vec_id", F.when(F.col("sound"), F.col("label")).alias("label"), "h1", "h2")
    return narrow.join(known, ["label", "h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
