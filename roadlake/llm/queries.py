"""Registered queries of the training-data operators: name -> (function, DuckDB text or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm import (
    contamination, fingerprints, language_crf, line_dedup, merkle, mixing, neighbours, simhash, substrings, suffixes, token_counts, token_files, whitening,
)
from roadlake.llm.base import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_files.default_path())


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.documents_of(token_files.write(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_crf.label(docs, language_crf.fit(language_crf.training_rows(docs)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("length")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))
    spelled = {"fingerprint": fingerprints.spelled("sketch"), "edited_fingerprint": fingerprints.spelled("edited_sketch"), "edited_sha256": F.sha2("edited", 256)}
    return out.withColumns(spelled).drop("text", "edited", "sketch", "edited_sketch")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"), merkle.contract_tampering()).drop("path")


QUERIES = {
    "op1_source_mixing": (op1_source_mixing, mixing.SQL),
    "op2_nearest_neighbours": (op2_nearest_neighbours, None),
    "op3_substring_dedup": (op3_substring_dedup, None),
    "op4_token_counts": (op4_token_counts, None),
    "op5_token_files": (op5_token_files, None),
    "op6_simhash": (op6_simhash, None),
    "op7_line_dedup": (op7_line_dedup, line_dedup.SQL),
    "op8_language": (op8_language, None),
    "op9_decontamination": (op9_decontamination, contamination.SQL),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_whitening": (op11_whitening, None),
    "op12_fingerprints": (op12_fingerprints, None),
    "op13_merkle": (op13_merkle, merkle.SQL),
}
