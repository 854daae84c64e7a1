"""The corpus pipeline: five stages over ``documents``, each written and read by the next.

Every stage works on all its predecessor kept and returns the columns of documents; the last
returns token ids and the decoded text. Null and empty texts leave at the first stage, as they have
no language; texts of any length are worked on whole; repeated rows get equal results; an empty
table gives an empty table.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.llm import bpe, decontamination, language, minhash, substring
from pulsegate.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the predicted language; rows without one (null, no letter) go."""
    rows = language.identify(docs).withColumn("lang", F.col("language.lang_pred"))
    return rows.filter(F.col("lang") != language.UNKNOWN).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id.

    Rows that agree in id and text stay or go together; texts without words stay.
    """
    gone = minhash.near_duplicates(docs).filter("not kept").select(
        F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    return docs.join(gone.distinct(), docs["doc_id"].eqNullSafe(gone["gone_id"])
                     & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti").select(
        *COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that occur elsewhere; other texts stay as they are."""
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("cut.n_removed") > 0, F.length("text").cast("long"))
        .otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_leaks(docs, benchmark).filter(F.size("leaks") == 0).select(
        *COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text and what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("decontamination", decontaminate),
          ("bpe", encode)]
#: Language ID is a trained model, so SQL has no twin; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of ``sf_dir``.

    Other columns than those of documents are dropped by the first stage, so they can't clash.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
