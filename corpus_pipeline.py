"""From raw documents to training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from orbweave.llm import chosenpath, langid, linetemplates, packing, toxicity
from orbweave.llm.common import fold, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]


def _learn(key):
    return F.coalesce(fold(key) != 0, F.lit(False))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity(docs, labels, _learn, "toxic", "doc_id", "text", keep=REST)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a learned language stay; texts without a letter or far from all languages go."""
    found = langid.languages(docs, _learn(F.col("doc_id")), "lang", "doc_id", "text", keep=REST)
    return found.where(~F.col("rejected")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, without lines whose template an earlier document has; n_chars follows the text."""
    kept = linetemplates.drop_recurring_lines(docs, "doc_id", "text")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(
        F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near copies the one with the smallest id stays, also of those without words."""
    classes = chosenpath.similarity_classes(docs, "doc_id", "text").select(
        F.col("doc_id").alias("__id"), (F.col("doc_id") != F.col("class_id")).alias("__copy"))
    copies = classes.where("__copy").select("__id")
    return docs.join(copies, F.col("doc_id") == F.col("__id"), "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document that is left goes: pieces with sequence and offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "text", 4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace("_", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
