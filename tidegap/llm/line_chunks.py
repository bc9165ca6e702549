"""Line dedup by content-defined chunks of lines, in built-in expressions.

Lines are hashed, and a rolling hash over the last few line hashes decides after which
lines a chunk ends. So boundaries depend on nearby lines only: a passage that stands
elsewhere in another document is cut in the same way but for its ends. Chunks of several
lines are first counted by 128 hash bits, which moves one narrow row for each. Only where
a hash comes again is the text fetched, and only chunks equal byte for byte are removed,
all but the first.

Counting combines map-side, so copies of a hot document are few rows; joins on a hash are
plain joins, which adaptive execution splits where one hash is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegap.cluster import pin
from tidegap.llm.rows import keyed, same_row, wrapped

#: Lines under the rolling hash, one in so many of its values ends a chunk, fewest lines of a chunk removed.
ROLLING, DIVISOR, LINES = 2, 3, 2
_FACTOR, _MODULUS = 31, 2_147_483_647


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunk_bounds(text_lines: Column) -> Column:
    """Array of ``start`` (from 0) and ``n`` lines of each chunk, in order."""
    hashed = F.transform(text_lines, lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("bigint"))

    def ends(h: Column) -> Column:
        def value(x: Column, i: Column) -> Column:
            for back in range(1, ROLLING):
                x = (x * _FACTOR + F.when(i >= back, F.get(h, i - back)).otherwise(0)) % _MODULUS
            return x

        last = F.size(h) - 1
        cut = F.transform(h, lambda x, i: F.when((value(x, i) % DIVISOR == 0) | (i == last), i))
        return F.array_compact(cut)

    # A one-element array makes each step one value for the next.
    step = lambda column, f: F.get(F.transform(F.array(column), f), F.lit(0))
    found = step(step(hashed, lambda h: h), ends)
    return step(found, lambda e: F.transform(e, lambda end, k: F.struct(
        F.when(k == 0, 0).otherwise(F.get(e, k - 1) + 1).cast("int").alias("start"),
        (end - F.when(k == 0, -1).otherwise(F.get(e, k - 1))).cast("int").alias("n"))))


def removed_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, start, n`` of the chunks that go; ``docs`` as from ``keyed``."""
    split = docs.select("doc_id", "text_hash", lines(F.col("text")).alias("lines"))
    chunk = F.array_join(F.slice("lines", F.col("c.start") + 1, F.col("c.n")), "\n")
    rows = (split.select("doc_id", "text_hash", "lines", F.explode(chunk_bounds(F.col("lines"))).alias("c"))
            .where(F.col("c.n") >= LINES)
            .select("doc_id", "text_hash", "c.start", "c.n", F.xxhash64(chunk).alias("h1"),
                    F.xxhash64(F.lit(1), chunk).alias("h2")))
    rows = pin(rows, "chunks")
    # A row that came twice is one place.
    again = (rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"),
                                          F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2"))
    wanted = (rows.join(again, ["h1", "h2"]).groupBy("doc_id", "text_hash")
              .agg(F.collect_set(F.struct("start", "n", "h1", "h2")).alias("chunks")).hint("shuffle_hash"))
    texts = pin(docs.join(wanted, same_row(docs, wanted))
                .select(docs.doc_id, docs.text_hash, lines(F.col("text")).alias("lines"), F.explode("chunks").alias("c"))
                .select("doc_id", "text_hash", "c.*", chunk.alias("chunk")), "repeated-chunks")
    first = texts.groupBy("h1", "h2", "chunk").agg(F.min(F.struct("doc_id", "text_hash", "start")).alias("first"))
    return (texts.join(first, ["h1", "h2", "chunk"])
            .where(~F.struct("doc_id", "text_hash", "start").eqNullSafe(F.col("first")))
            .select("doc_id", "text_hash", "start", "n"))


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` replaced, plus ``n_lines`` and ``n_removed`` (lines).

    All columns of ``docs`` stay; ones named ``n_lines`` or ``n_removed`` are replaced.
    The first chunk of equal ones stays: that in the smallest id, null before all, then
    the smallest hash of the text, then the earliest in it. Rows with equal id and text
    are one document given several times and get the same text. A null text has no line
    and stays null, an empty one is one empty line; a text that loses all lines is empty.
    An empty table gives no rows.
    """
    gone = removed_chunks(keyed(docs)).groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_set(
        F.sequence("start", F.col("start") + F.col("n") - 1)))).alias("gone")).hint("shuffle_hash")
    rows = wrapped(docs)
    split = rows.join(gone, same_row(rows, gone), "left").select(
        "row", "gone", lines(F.col("row.text")).alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n"))
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return split.select(*[kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names],
                        size("lines").alias("n_lines"), size("gone").alias("n_removed"))
