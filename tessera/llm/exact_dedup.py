"""Exact deduplication: 128-bit content hash, byte comparison inside a group, one stable survivor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, whole_text

#: The characters that do not count when texts are compared.
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """text without any character of [\\x20\\x09-\\x0D]."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), IGNORED, text)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows group by the MD5 of their normalised text together with that text's bytes, so Spark's hash aggregate
    compares the bytes of whatever meets under one hash: a collision forms two groups. Map-side combine leaves
    one row of a group per task before the shuffle, however large the group is. The way back joins digests
    only (16 + 32 bytes a row), as a sort-merge join whose large partitions AQE may split.

    The survivor has the most code points in its original text, then the smallest id. Null texts count as
    empty, and all empty texts are one group. A null id is larger than any other (kept only if alone among the
    longest); rows that repeat an id and text each count and get the same `kept`. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    rows = rows.select("doc_id", F.length("t").alias("n"), normalised(F.col("t")).alias("norm"))
    rows = rows.withColumn("key", F.unhex(F.md5("norm")))
    # longest first, then smallest id, as one number, for which the hash aggregate has a mutable buffer
    big = F.lit(str(2**65)).cast("decimal(20,0)")
    shifted = F.lit(str(2**63)).cast("decimal(20,0)")
    order = (F.col("n").cast("decimal(10,0)") * big).cast("decimal(38,0)") + F.coalesce(
        shifted - F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")
    )
    groups = rows.groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.max(order).alias("best"))
    rest = F.col("best") % big
    groups = groups.select(
        F.col("key").alias("g_key"),
        F.sha2("norm", 256).alias("g_sha"),
        "group_size",
        F.when(rest != 0, (shifted - rest).cast("long")).alias("keep_id"),
        F.floor(F.col("best") / big).cast("int").alias("keep_n"),
    )
    members = rows.select("doc_id", "n", "key", F.sha2("norm", 256).alias("text_sha256"))
    on = (F.col("key") == F.col("g_key")) & (F.col("text_sha256") == F.col("g_sha"))
    return members.join(groups, on).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept"),
        "text_sha256",
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
