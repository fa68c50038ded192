"""A training corpus in five stages, each on all that the stage before it kept.

Every stage judges a row by its text, so rows with null or repeated doc_id are rows like all others. Null text counts as
empty; what becomes of it, of repeated rows and of empty tables is said at each stage. All stages but the last keep all
columns of documents, whatever further ones there are. The result holds the ids themselves, so nothing depends on the
tables written on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontam, jaccard, packing, quality, scratch, secrets


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go. Empty and null texts are scored by their length; rows that repeat
    share one fate; without labels, or with one grade alone, all stay."""
    return quality.select(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays (a null one only if there is no other). All
    empty and null texts are copies of one another; different texts under one doc_id are different documents."""
    return jaccard.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, whatever its letter case and marks. Empty items are in no document."""
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"), folded=True)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret values are masked in text, n_chars then counted anew; all documents stay, null text too."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids, in sequences of 2048 tokens. An empty or null text is its end id."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's result is written to the shared folder and read again."""
    scratch.ship(spark)
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs


#: Tokenizers, trained models and signatures have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None
