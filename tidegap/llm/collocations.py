"""Collocations mined from a weighted de Bruijn graph of phrases.

Nodes are phrases of three words, edges phrases of four: an edge leads from its first
three words to its last three, and its weight is its number of occurrences. The texts give
edges, and where a piece ends the shorter phrases there. The occurrences of a shorter
phrase are the flow out of it, that is the edges that begin with it, plus those at ends.
So the phrases of three words are summed from the edges, those of two from them, and
single words from those of two.

A phrase with fewer occurrences than a candidate needs is in no candidate and in no part
of one, so it ends a piece for all longer ones. Three passes over the coded words find the
frequent words, then the frequent pairs of these, then the frequent triples of these, each
as a bit table of a bounded size, from hashes. A wrong bit keeps a phrase, which costs time
and changes nothing. What is left to count by its text is little more than the candidates.

Among the edges that can be candidates, a node that one edge enters and one leaves, both
with all its occurrences, is inside a unary path. Paths are compacted into one long phrase
each. A node inside a path is no result, as an edge of the path holds it and is as
frequent; only the nodes between paths are compared with the edges around them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegap.cluster import pin, scratch_path
from tidegap.llm.components import components

#: Most words of a phrase, fewest occurrences of a candidate, results for each language.
WORDS, LEAST, TOP = 4, 30, 2000
#: A candidate inside a longer one with so many hundredths of its occurrences is no result.
INSIDE = 80
#: Scores are parts of this.
SCALE = 2_000_000
#: Bits for each frequent phrase, and the most bits of a table (16 MB).
BITS_OF_PHRASE, MOST_BITS = 16, 1 << 27
#: Bytes of text coded together, counts merged together, rows of one batch handed to Spark.
TOGETHER, MERGED, BATCH = 2 << 20, 400_000, 50_000
#: Language of rows without one.
UNKNOWN = "und"
#: Bits in one piece of the table: the size that Spark's bitmap functions build.
_PIECE = 32_768


def _byte_table() -> np.ndarray:
    """What becomes of each byte: small letters, one mark between pieces, one between words."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
    table[9] = 32
    return table


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of some texts in order, coded, and the number of the piece each is in."""
    ended = pc.binary_join_element_wise(
        texts.cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    ends = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
    data = _byte_table()[np.frombuffer(ended.buffers()[2], np.uint8)[ends[0]:ends[-1]]] if len(ended) else np.empty(0, np.uint8)
    mark = data == 10
    gap = mark | (data == 32)
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[~gap]))
    return words.dictionary_encode(), np.cumsum(mark, dtype=np.int32)[start]


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Texts of one language each, about ``TOGETHER`` bytes at a time, four times that in all."""
    held: dict[str, list[pa.Array]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        ends = pc.cumulative_sum(pc.binary_length(batch["text"]).cast(pa.int64())).to_numpy()
        cuts = np.searchsorted(ends, np.arange(TOGETHER, ends[-1], TOGETHER)).tolist() if len(ends) else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            part = batch.slice(lo, hi - lo)
            for lang in pc.unique(part["lang"]).to_pylist():
                own = part["text"].filter(pc.equal(part["lang"], lang))
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + own.nbytes
            full = sum(size.values()) >= 4 * TOGETHER
            for lang in [x for x, n in size.items() if full or n >= TOGETHER]:
                yield lang, pa.concat_arrays(held.pop(lang))
                del size[lang]
    for lang, parts in held.items():
        yield lang, pa.concat_arrays(parts)


_CODED = [("lang", "string", pa.string()), ("words", "string", pa.large_string()), ("n", "bigint", pa.int64()),
          ("hashes", "binary", pa.binary()), ("codes", "binary", pa.binary()), ("follows", "binary", pa.binary())]


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts of a language as one row: their different words, and all words in order by number."""
    import xxhash

    for lang, texts in _by_language(batches):
        words, piece = _words(texts)
        there = words.dictionary
        # One string for all words: none of them holds a line feed.
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(there)], pa.int32()), there),
                                pa.scalar("\n", there.type))
        seed, digest = xxhash.xxh64_intdigest(lang.encode(), 42), xxhash.xxh64_intdigest
        own = joined[0].as_py().encode().split(b"\n")[:len(there)]
        hashes = np.array([digest(w, seed) for w in own], dtype="<u8")
        values = [lang, joined[0].as_py(), len(words), hashes.tobytes(), words.indices.to_numpy().astype("<i4").tobytes(),
                  np.packbits(np.diff(piece) == 0).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, _, t) in zip(values, _CODED)],
                                         names=[name for name, _, _ in _CODED])


def _set(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = h & np.uint64(8 * len(table) - 1)
    return (table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of all but its last word, and of that word."""
    x = h * np.uint64(0x9E3779B97F4A7C15) + word
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _phrases(codes: bytes, hashes: bytes, follows: bytes, tables: list[np.ndarray]):
    """Codes, and for each size up to one more than ``tables`` the places where a phrase begins, and hashes.

    Phrases of a size that has a table are those with their bit set; longer ones are those
    whose first and last words but one are such phrases.
    """
    at = np.frombuffer(codes, "<i4").astype(np.int64)
    word = np.frombuffer(hashes, "<u8")[at]
    same = np.unpackbits(np.frombuffer(follows, np.uint8), count=max(0, len(at) - 1)).astype(bool)
    place, h = np.arange(len(at)), word
    found = []
    for size, table in enumerate(tables, 1):
        ok = _set(table, h)
        place, h = place[ok], h[ok]
        found.append((place, h))
        near = np.flatnonzero(np.diff(place) == 1)
        near = near[same[place[near]]] if size == 1 else near
        place = place[near]
        h = _longer(h[near], word[place + size])
    return at, [*found, (place, h)]


def _tables(given) -> list[np.ndarray]:
    return [np.frombuffer(t.value, np.uint8) for t in given]


def _count_hashes(given):
    """The function that counts the hashes of the phrases one word longer than the last table's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(given)
        h, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def batch() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(h[i:i + BATCH].view(np.int64)), pa.array(n[i:i + BATCH])], names=["h", "n"])

        for part in batches:
            for codes, hashes, follows in zip(part["codes"], part["hashes"], part["follows"]):
                _, found = _phrases(codes.as_py(), hashes.as_py(), follows.as_py(), tables)
                # No table has more bits than these: shorter numbers are shorter rows.
                new, times = np.unique(found[-1][1] & np.uint64(0xFFFFFFFF), return_counts=True)
                every, where = np.unique(np.concatenate([h, new]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, times]), len(every)).astype(np.int64)
                h = every
                if len(h) > MERGED:
                    yield from batch()
                    h, n = h[:0], n[:0]
        yield from batch()

    return run


def _count_edges(given):
    """The function that counts edges, and at every other place the longest frequent phrase there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(given)
        for part in batches:
            for i in range(part.num_rows):
                row = {c: part[c][i].as_py() for c in ("lang", "words", "codes", "hashes", "follows")}
                at, found = _phrases(row["codes"], row["hashes"], row["follows"], tables)
                words = pa.array(row["words"].split("\n"), pa.string())
                longest = np.zeros(len(at), dtype=np.int8)
                for size, (place, _) in enumerate(found, 1):
                    longest[place] = size
                for size in range(1, len(found) + 1):
                    place = np.flatnonzero(longest == size)
                    # Equal phrases, one word more at a time.
                    key, kinds = at[place], []
                    for more in range(1, size):
                        kind, key = np.unique(key, return_inverse=True)
                        kinds.append(kind)
                        key = key * len(words) + at[place + more]
                    kind, n = np.unique(key, return_counts=True)
                    columns = []
                    for before in reversed(kinds):
                        kind, last = np.divmod(kind, len(words))
                        columns.append(last)
                        kind = before[kind]
                    columns = [kind, *reversed(columns)]
                    for j in range(0, len(n), BATCH):
                        own = [words.take(pa.array(c[j:j + BATCH])) for c in columns]
                        joined = pc.binary_join_element_wise(*own, " ") if size > 1 else own[0]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["lang"]] * len(joined), pa.string()), pa.array(np.full(len(joined), size, np.int32)),
                             joined, pa.array(n[j:j + BATCH])], names=["lang", "size", "phrase", "n"])

    return run


def _paths(edges: pa.Table) -> pa.Table:
    """Unary paths: edges that follow each other, as one phrase with the weight of each."""
    rows = list(zip(*(edges[c].to_pylist() for c in ("lang", "phrase", "n", "entered", "left"))))
    onward = {(lang, phrase.rsplit(" ", 1)[0]): (phrase, left) for lang, phrase, _, entered, left in rows if entered}
    found = []
    for lang, phrase, n, entered, left in rows:
        if not entered:
            last, words = phrase, [phrase]
            while left:
                last, left = onward[lang, last.split(" ", 1)[1]]
                words.append(last.rsplit(" ", 1)[1])
            found.append((lang, " ".join(words), n))
    columns = zip(*found) if found else [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                    names=["lang", "phrase", "n"])


def _first(words: int, phrase: str = "phrase") -> Column:
    return F.substring_index(phrase, " ", words)


def _last(words: int, phrase: str = "phrase") -> Column:
    return F.substring_index(phrase, " ", -words)


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows are texts by the megabyte: hand few of them to Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2 * TOGETHER))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def coded(docs: DataFrame) -> DataFrame:
    """Texts of ``docs(lang, text)`` cut into words, some megabytes of a language to a row."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), "text").where("text is not null")
    rows = texts.mapInArrow(_code, ", ".join(f"{name} {kind}" for name, kind, _ in _CODED))
    path = scratch_path(docs.sparkSession, "coded")
    # Cells of a megabyte: without a look after each row, a page of the file would hold a hundred.
    rows.write.options(**{"parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
                          "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1,
                          "parquet.enable.dictionary": False}).parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def bit_table(counts: DataFrame, least: int) -> bytes:
    """Bits of the hashes ``h`` with at least ``least`` occurrences; 16 MB at most come to the driver."""
    # Tasks have merged their counts: dealt out first, they fill no second table in memory there.
    often = pin(counts.repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "often")
    bits = _PIECE
    while bits < min(MOST_BITS, BITS_OF_PHRASE * often.count()):
        bits *= 2
    bit = F.col("h").bitwiseAND(F.lit(bits - 1))
    pieces = often.select(bit.alias("bit")).groupBy(F.expr(f"bit div {_PIECE}").alias("piece")).agg(
        F.bitmap_construct_agg(F.col("bit") % _PIECE).alias("bits")).collect()
    table = np.zeros((bits // _PIECE, _PIECE // 8), dtype=np.uint8)
    for row in pieces:
        table[row.piece] = np.frombuffer(row.bits, np.uint8)
    return table.tobytes()


def edge_counts(words: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, size, phrase, n`` of ``coded`` texts: edges (``size`` 4) and shorter phrases at ends."""
    context, tables = words.sparkSession.sparkContext, []
    parts = words.select("codes", "hashes", "follows")
    for _ in range(WORDS - 1):
        counts = parts.mapInArrow(_count_hashes(list(tables)), "h bigint, n bigint")
        tables.append(context.broadcast(bit_table(counts, least)))
    found = (words.select("lang", "words", "codes", "hashes", "follows")
             .mapInArrow(_count_edges(tables), "lang string, size int, phrase string, n bigint"))
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def flows(edges: DataFrame) -> dict[int, DataFrame]:
    """By number of words ``lang, phrase, n``: flow out of each phrase plus its ends."""
    found = {WORDS: edges.where(F.col("size") == WORDS).select("lang", "phrase", "n")}
    for size in range(WORDS - 1, 0, -1):
        ends = edges.where(F.col("size") == size).select("lang", "phrase", "n")
        found[size] = pin(found[size + 1].select("lang", _first(size).alias("phrase"), "n").unionByName(ends)
                          .groupBy("lang", "phrase").agg(F.sum("n").alias("n")), f"phrases-{size}")
    return found


def unary_paths(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compacted paths ``lang, phrase, n`` of all ``edges``, and ``lang, phrase`` of the nodes inside."""
    weight = nodes.select("lang", F.col("phrase").alias("node"), "n")
    within = weight.join(edges.select("lang", _last(WORDS - 1).alias("node"), "n", F.col("phrase").alias("before")),
                         ["lang", "node", "n"])
    links = pin(within.join(edges.select("lang", _first(WORDS - 1).alias("node"), "n", F.col("phrase").alias("after")),
                            ["lang", "node", "n"]), "links")
    found = components(links.select(F.xxhash64("lang", "before").alias("a"), F.xxhash64("lang", "after").alias("b")))
    entered = links.select("lang", F.col("after").alias("phrase"), F.lit(True).alias("entered"))
    left = links.select("lang", F.col("before").alias("phrase"), F.lit(True).alias("left"))
    marked = pin(edges.join(entered, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
                 .select("lang", "phrase", "n", F.coalesce("entered", F.lit(False)).alias("entered"),
                         F.coalesce("left", F.lit(False)).alias("left"), F.xxhash64("lang", "phrase").alias("v")), "edges")
    linked = marked.where("entered or left").join(found, "v", "left").withColumn("path", F.coalesce("component", "v"))
    # A path lies within one text, so a group is no longer than a text.
    long = (linked.select("path", "lang", "phrase", "n", "entered", "left").groupBy("path")
            .applyInArrow(_paths, "lang string, phrase string, n bigint"))
    alone = marked.where("not entered and not left").select("lang", "phrase", "n")
    return pin(alone.unionByName(long), "paths"), links.select("lang", F.col("node").alias("phrase"))


def _not_inside(candidates: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Candidates of ``size`` words that no phrase of one more word nearly always holds."""
    around = (longer.select("lang", "n", F.explode(F.array(_first(size), _last(size))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("n").alias("around")))
    share = lambda f, c: F.lit(f).cast("decimal(3)") * F.col(c).cast("decimal(20)")
    return (candidates.join(around, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (share(100, "around") < share(INSIDE, "n")))
            .select("lang", "phrase", "n"))


def scored(candidates: DataFrame, size: int, counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the lowest-scoring cut of each candidate of ``size`` words."""
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), _first(k).alias("head"), _last(size - k).alias("tail"))
        for k in range(1, size)])).alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda side, n: counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    score = F.expr(f"cast({SCALE} * cast(a as decimal(19)) div (cast(l as decimal(19)) + cast(r as decimal(19))) as bigint)")
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
            .withColumn("score", score).groupBy("lang", "phrase", "a").agg(lowest)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``lang`` and ``text``; other columns are ignored. Rows without a language
    are those of ``und``. Null and empty texts have no words; repeated rows count as often
    as they come. Ties in score and occurrences are settled by the phrase's bytes. A
    language without candidates has no row, an empty table none at all. Counts are exact
    at every size; ``least`` must be 1 or more.
    """
    docs = docs.select("lang", "text")
    with _small_batches(docs.sparkSession):
        words = coded(docs)
        edges = pin(edge_counts(words, least), "edges")
    often = {size: f.where(F.col("n") >= least) for size, f in flows(edges).items()}
    paths, inside = unary_paths(pin(often[WORDS], "often"), often[WORDS - 1])
    tokens = F.split("phrase", " ")
    stretched = paths.select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (WORDS - 1)),
        lambda i: F.array_join(F.slice(F.split("phrase", " "), i, WORDS), " "))).alias("phrase"))
    between = often[3].join(inside, ["lang", "phrase"], "left_anti")
    results = {4: stretched, 3: _not_inside(between, often[4], 3), 2: _not_inside(often[2], often[3], 2)}
    counts = often[1].unionByName(often[2]).unionByName(often[3])
    found = None
    for size, candidates in results.items():
        own = scored(candidates, size, counts)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
