"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import default_path, pack_documents
from tessera.llm.pii import redact_documents
from tessera.llm.quality import fit_quality, keep_good


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on the labelled part of these documents, rejects."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _chosen(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of docs whose id is marked `kept`; rows that repeat an id stay or go together."""
    kept = marked.filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest row stays."""
    return _chosen(docs, exact_dedup(docs))


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the row of the smallest id stays."""
    return _chosen(docs, near_duplicates(docs))


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows."""
    return redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their ids and places."""
    return pack_documents(docs, default_path())


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", dissimilar), ("pii", anonymous), ("packing", packed)]

#: No stage but the second can be put in SQL; the others are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`; what each kept is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
