"""Language identification by compression.

Per language a raw-content dictionary is laid out from excerpts of labelled texts. A
text is compressed with each dictionary; the language whose dictionary makes it smallest
wins, because that dictionary has most of the text's words. Texts are compressed in
blocks, so that a long text keeps being measured against the dictionary and not against
itself. When the best two lengths are too close the prediction is rejected: their
difference is taken relative to the shorter one, so it means the same at ten words and at
twenty thousand. How close is too close is learnt with the dictionaries, from excerpts
compressed with dictionaries that were laid out without them.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegap.cluster import pin

#: Excerpts per language and characters of each: the bounded sample that is learnt from.
EXCERPTS, EXCERPT_CHARS = 96, 768
#: Languages that have all their excerpts; where there are more, each has fewer.
LANGUAGES = 256
LEVEL = 5
BLOCK_BYTES = 4096
#: A score below this is a rejection: the best two differ by less than the floor.
MIN_SCORE = 0.6
#: The floor is half the relative difference that all but one in so many excerpts exceed, at least so much.
EXCEEDED, LEAST_FLOOR = 100, 0.01
#: Excerpts that the floor is learnt from at most.
JUDGED = 2000


def excerpts(docs: DataFrame, per_language: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> DataFrame:
    """``lang, excerpt``: a bounded sample of different texts of every language.

    Texts are chosen by their hash. The threshold follows from the number of different
    texts of the language, so about twice the wanted number is met whatever the size;
    copies are merged map-side before the final cut. With more than ``LANGUAGES`` languages
    each has fewer excerpts, one at least, so that all together stay bounded.
    """
    text = F.trim(F.col("text"))
    rows = docs.select("lang", F.xxhash64(text).alias("h"), text.alias("text")).where(
        "lang is not null and length(text) > 0")
    # One small row per language.
    sizes = pin(rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    per_language = max(1, per_language * LANGUAGES // max(LANGUAGES, sizes.count()))
    share = F.lit(3.0 * per_language) / F.col("n")
    u = (F.shiftrightunsigned(F.xxhash64("h"), 11)).cast("double") / float(1 << 53)
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    few = (rows.join(F.broadcast(sizes), "lang").where(u < share)
           .select("lang", "h", F.substring("text", start, F.lit(chars)).alias("excerpt"))
           .groupBy("lang", "h").agg(F.min("excerpt").alias("excerpt")))
    # About 3 * per_language rows per language are left.
    ranked = few.withColumn("rank", F.expr("row_number() over (partition by lang order by xxhash64(h), h)"))
    return ranked.where(F.col("rank") <= per_language).select("lang", "excerpt")


class Dictionaries(dict):
    """Language to dictionary, and the relative difference of lengths that tells languages apart."""

    floor = LEAST_FLOOR


def _laid_out(parts: dict[str, list[str]]) -> dict[str, bytes]:
    return {lang: "\n".join(sorted(found)).encode() for lang, found in sorted(parts.items())}


def floor_of(parts: dict[str, list[str]]) -> float:
    """The floor by ``parts``, language to excerpts: each half is judged by dictionaries of the other."""
    parts = {lang: sorted(found) for lang, found in sorted(parts.items()) if len(found) > 1}
    step = -(-sum(map(len, parts.values())) // JUDGED)
    margins = []
    for half in (0, 1) if len(parts) > 1 else ():
        coder = Coder(_laid_out({lang: found[1 - half::2] for lang, found in parts.items()}))
        for lang, found in parts.items():
            for text in found[half::2 * step]:
                sizes = coder.sizes(text)
                best = min(sizes)
                if coder.languages[sizes.index(best)] == lang:
                    margins.append(sorted(sizes)[1] / best - 1)
    return max(LEAST_FLOOR, sorted(margins)[len(margins) // EXCEEDED] / 2) if margins else LEAST_FLOOR


def learn(docs: DataFrame, per_language: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> Dictionaries:
    """Language to dictionary; the most frequent excerpts' order is fixed by their text."""
    parts: dict[str, list[str]] = {}
    for lang, excerpt in excerpts(docs, per_language, chars).collect():  # a bounded sample
        parts.setdefault(lang, []).append(excerpt.lower())
    known = Dictionaries(_laid_out(parts))
    known.floor = floor_of(parts)
    return known


class Coder:
    """Compressed length of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = list(dictionaries)
        self.floor = getattr(dictionaries, "floor", LEAST_FLOOR)
        self.coders = []
        for content in dictionaries.values():
            known = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(coder.compress(block)) for block in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 without a letter or without any language."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        if len(sizes) == 1:
            return self.languages[0], 1.0
        # Of the best two languages the better one has MIN_SCORE where they differ by the floor.
        scale = math.log(MIN_SCORE / (1 - MIN_SCORE)) / self.floor
        score = 1 / (1 + math.exp(max(-700.0, (best - sorted(sizes)[1]) / best * scale)))
        return self.languages[sizes.index(best)], score


def predicted(spark: SparkSession, dictionaries: dict[str, bytes]):
    """A column function: text to ``struct<lang, score>``."""
    sent = spark.sparkContext.broadcast(dictionaries)  # bounded: languages times excerpts
    kept: list[Coder] = []

    @F.arrow_udf("lang string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Coder(sent.value))
        found = [kept[0].predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
            names=["lang", "score"])

    return predict


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``lang_pred, lang_score, lang_rejected`` from the whole text alone.

    Null texts, empty ones and those without a letter are ``und``, score 0, rejected. On
    a tie the first language by name is named and, the score being at most 0.5, rejected.
    Equal texts get equal answers; an empty table gives no rows. Columns of these three
    names in ``docs`` are replaced.
    """
    found = docs.drop("lang_pred", "lang_score", "lang_rejected").withColumn(
        "lang_pred", predicted(docs.sparkSession, dictionaries)(F.col("text")))
    return (found.withColumn("lang_score", F.col("lang_pred.score"))
            .withColumn("lang_pred", F.col("lang_pred.lang"))
            .withColumn("lang_rejected", (F.col("lang_pred") == "und") | (F.col("lang_score") < min_score)))
