"""Corpus pipeline: toxic texts out, one of each group of near copies, repeated
passages cut, contaminated documents out, the rest encoded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``. A row without doc_id
goes through every stage on its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize
from simloom.llm import bpe, decontaminate, langid, nearcopies, repeats, toxicity
from simloom.llm.queries import RANKS


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that score 0.5 or more, learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(langid.remainder("doc_id", 5) != 0)
    model = toxicity.language_model(docs)
    return toxicity.keep_clean(docs, model, toxicity.fit(docs, labels, model))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each class of near copies."""
    return nearcopies.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of over 50 words that occur elsewhere out of the texts; n_chars follows."""
    kept = repeats.without_repeats(docs, length=repeats.PASSAGE, gram=repeats.PASSAGE_GRAM, unit=repeats.WORDS)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of ten words of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents left."""
    return bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic_out),
    ("near_copies", near_copies_out),
    ("repeats", repeats_out),
    ("decontamination", contaminated_out),
    ("tokens", encoded),
]

#: SQL cannot express the learned and the hashed stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
