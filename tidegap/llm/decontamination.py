"""Benchmark decontamination by a prefix-filtered set join, in built-in expressions only.

A window is 13 consecutive words of an item, or all words of a shorter item. It is
contained in a document only if its rarest word is, so the order by rarity lets a prefix
of one word per window do: document words meet these words alone. Two bounds then need
no text: the window must start at or after the first word (position) and end at or
before the last (length). What is left is compared word by word with a slice of the
document of the window's size, which makes the result exact.

Word counts come from all documents. A window with a word that no document holds cannot
occur and is dropped. The windows are broadcast, in blocks whose rows and bytes are
counted first; a benchmark beyond one block is joined block after block, each against
all documents. No text is shuffled: only occurrences and word counts of documents are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidegap.cluster import pin
from tidegap.llm.rows import keyed, lower_ascii, same_row, wrapped

WINDOW = 13
#: Everything below "0", between "9" and "a" after lower-casing, and above "z" in ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A block of windows that is broadcast has at most about so many rows and bytes.
BLOCK_ROWS, BLOCK_BYTES = 50_000, 16 << 20


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, ASCII other than letters and digits between them."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``window`` (array of words) and ``items`` (distinct ids) of every different window."""
    listed = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (listed.select("item_id", "w", F.explode(starts).alias("at"))
            .groupBy(F.slice("w", F.col("at"), size).alias("window"))
            .agg(F.collect_set("item_id").alias("items")))


def with_prefix(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``token``, the rarest word over all documents, and ``lead``, its place (from 0)."""
    tokens = found.select("block", "window", "items", F.posexplode("window").alias("lead", "token"))
    vocabulary = tokens.select("token").distinct()
    counts = (docs.select(F.explode(words(F.col("text"))).alias("token"))
              .join(F.broadcast(vocabulary), "token").groupBy("token").count())
    return (tokens.join(counts, "token", "left")
            .groupBy("window", "items")
            .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "lead")).alias("p"))
            .where("p.n > 0")
            .select("window", "items", "p.token", "p.lead"))


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, text_hash, at, until, items`` of each place where a window stands in a document."""
    placed = docs.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    return (placed.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "token"))
            .join(F.broadcast(found), "token")
            .withColumn("at", F.col("pos") - F.col("lead"))
            .withColumn("until", F.col("at") + F.size("window"))
            .where((F.col("at") >= 0) & (F.col("until") <= F.size("w")))
            .where(F.slice("w", F.col("at") + 1, F.size("window")) == F.col("window"))
            .select("doc_id", "text_hash", "at", "until", "items"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW,
                  share: int = 20) -> DataFrame:
    """One row per document: how many of its words stand in windows of which items.

    ``docs(doc_id, text)``, ``items(item_id, text)``; other columns are ignored. Result:
    ``doc_id, text_hash, n_words, n_hit, item_ids`` (distinct, as strings, sorted) and
    ``contaminated`` (``n_hit > 0 and share * n_hit >= n_words``). Null and empty texts
    have no words and no hits. An item without words has no window; a null item id marks
    words but is not listed. Repeated documents come back as often as they came. Empty
    tables give no rows or no hits.
    """
    docs = keyed(docs)
    found = pin(windows(items, size), "windows")
    rows, size_of = found.agg(
        F.count(F.lit(1)), F.sum(F.octet_length(F.array_join("window", " ")) + 8 * F.size("items") + 64)).first()
    blocks = max(1, -(-2 * rows // BLOCK_ROWS) if rows > BLOCK_ROWS else 1,
                 -(-2 * (size_of or 0) // BLOCK_BYTES) if (size_of or 0) > BLOCK_BYTES else 1)
    found = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    hits = None
    for block in range(blocks if rows else 0):
        prefixed = pin(with_prefix(found.where(F.col("block") == block), docs), "prefixes")
        part = occurrences(docs, prefixed)
        hits = part if hits is None else hits.unionByName(part)
    text = F.col("text")
    counted = docs.select("doc_id", "text_hash", F.size(F.array_remove(F.split(text, _NOT_WORD), "")).cast("long").alias("n_words"))
    if hits is not None:
        counted = counted.unionByName(hits, allowMissingColumns=True)
    else:
        counted = counted.withColumns({"at": F.lit(None).cast("int"), "until": F.lit(None).cast("int"),
                                       "items": F.lit(None).cast("array<bigint>")})
    spans = F.array_sort(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "until"))))
    n_hit = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["until"]).alias("end"),
            (acc["n"] + F.greatest(s["until"] - F.greatest(acc["end"], s["at"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"])
    ids = F.array_sort(F.array_distinct(F.transform(F.flatten("lists"), lambda i: i.cast("string"))))
    return (counted.groupBy("doc_id", "text_hash")
            .agg(F.max("n_words").alias("n_words"), F.count("n_words").cast("int").alias("copies"),
                 spans.alias("spans"), F.collect_set("items").alias("lists"))
            .select("doc_id", "text_hash", "n_words", "copies", n_hit.alias("n_hit"), ids.alias("item_ids"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
            .withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns that are not contaminated by ``items``."""
    bad = contamination(docs, items).where("contaminated").select("doc_id", "text_hash").distinct()
    rows = wrapped(docs)
    return rows.join(bad, same_row(rows, bad), "left_anti").select("row.*")
