"""The registered queries: thin uses of the operators on the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegap.cluster import scratch_path
from tidegap.llm import automata, bwt, cap_filters, collocations, decontamination, golay, language, line_chunks, packing, pattern_packing, quality, structure_repair, warc
from tidegap.llm.rows import held_out


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_chunks.remove_repeated_chunks(_read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = automata.remove_repeated_passages(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = cap_filters.near_duplicates(_read(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    stats = quality.with_statistics(docs)
    forest = quality.learn(stats, labels.where(~held_out(F.col("doc_id"))))
    return quality.scored(stats, forest).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(_read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = scratch_path(spark, "archives")
    arcs = warc.write_arc(_read(spark, folder, "pages"), f"{place}/arc")
    found = warc.read_warc(warc.convert_arc(arcs, f"{place}/warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    known = language.learn(docs.where(~held_out(F.col("doc_id"))))
    return language.identify(docs, known).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
        F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op8_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = bwt.remove_repeated_bytes(_read(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = golay.near_duplicates(_read(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pattern_packing.pack(_read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_read(spark, folder, "documents"))


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = _read(spark, folder, "conversations")
    repaired = structure_repair.repair(structure_repair.damage(conversations))
    return structure_repair.all_conversations(conversations, structure_repair.summaries(repaired))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_substring_dedup, op3_embedding_near_dedup, op4_quality_classifier, op5_packing, op6_warc, op7_language_id, op8_suffix_array_dedup,
    op9_simhash_near_dedup, op10_decontamination, op11_best_fit_packing, op12_phrase_collocations, op13_conversation_repair)}
