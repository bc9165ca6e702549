"""Small shared pieces: row identity, word bytes, hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: ASCII capitals and what they become; other letters keep their case.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is right, and quicker, where all is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, CAPITALS, SMALL))


def held_out(doc_id: Column) -> Column:
    """True for rows that nothing may be learnt from. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text`` with null text as empty.

    The two first columns tell rows apart. Rows equal in both are one document given
    several times: operators decide once and return the decision for each of them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))


def wrapped(docs: DataFrame) -> DataFrame:
    """``row`` with all columns of ``docs``, beside ``doc_id, text_hash`` as from ``keyed``.

    So that no column of the caller's meets one of an operator's.
    """
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on row identity that also holds for null ids."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)
