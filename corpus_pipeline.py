"""A training-data pipeline over ``documents``: label, dedup, decontaminate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.llm import contamination, language_crf, mixing, simhash, token_files
from roadlake.llm.base import fresh, materialize, prepare, table

#: Documents whose words are labelled with less certainty than this go, as do those without a letter.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the labeller can tell the language of; a null text has no letter and goes."""
    prepare(spark)
    model = language_crf.fit(language_crf.training_rows(docs))
    return language_crf.recognised(docs, model, MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies, and of rows that share that
    doc_id one (of the smallest text hash). Near copies have a Jaccard similarity of 0.8 or more by their sets of
    five-word shingles. Null and wordless texts are one group; of a group without any doc_id one row stays. Repeated
    rows are copies; other columns are not looked at; an empty table stays empty."""
    prepare(spark)
    groups = simhash.near_copies(docs)
    first = groups.filter(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    keep = first.groupBy("component_id", "doc_id").agg(F.min("row_key").alias("row_key")).filter(F.col("doc_id").isNotNull())
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    named = keyed.dropDuplicates(["doc_id", key]).alias("d").join(keep.alias("k"), (F.col("d.doc_id") == F.col("k.doc_id")) & (F.col(f"d.{key}") == F.col("k.row_key")), "left_semi")
    nameless = first.filter("component_id is null").groupBy("component").agg(F.min("row_key").alias("row_key"))
    rest = keyed.filter("doc_id is null").dropDuplicates([key]).alias("d").join(nameless.alias("k"), F.col(f"d.{key}") == F.col("k.row_key"), "left_semi")
    return named.unionByName(rest).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    prepare(spark)
    hits = contamination.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "row_key").distinct()
    key = fresh("row_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64("text")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col(f"d.{key}") == F.col("h.row_key"))
    return keyed.join(hits.alias("h"), same, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources take their target shares."""
    prepare(spark)
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what reading them back gives for each document."""
    prepare(spark)
    return token_files.documents_of(token_files.write(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("encode", encode)]
#: No SQL can express the labeller, the tokenizer or the coder; tests hold the stages against plain walks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
