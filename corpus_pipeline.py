"""From raw documents to packed sequences: language, toxicity, near-duplicates, personal data, packing.

Each stage reads what its predecessor kept, as a Parquet table in the shared folder, and its decisions take effect there. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerstone.llm import language, near_copies, packing, pii, toxicity
from ledgerstone.llm.common import Stage, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    return language.known_language(docs, declared="lang", host="source", suffix=language.host_suffix(F.col("source")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity that the labels call toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more."""
    return near_copies.keep_one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced by the names of its kinds."""
    redacted = docs.withColumn("text", pii.redact_column(F.col("text")))
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models, trees and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage.write(step(spark, docs, sf_dir))
    return docs
