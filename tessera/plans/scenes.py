"""Synthetic sensor scenes as DataFrames, generated where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Half the room's side and the spacing of the points on its walls.
SIDE, STEP_MS, SAMPLE_NS, SWEEP_NS = 5.0, 5, 5_000_000, 99_000_000


def still_samples(spark: SparkSession, sequences: int, seconds: float, gravity: float = 9.81) -> DataFrame:
    """200 Hz samples of a unit at rest for each sequence."""
    n = int(seconds * 1e9 / SAMPLE_NS)
    rows = spark.range(sequences * n).select(F.concat(F.lit("s"), F.floor(F.col("id") / n).cast("string")).alias("seq"), ((F.col("id") % n) * SAMPLE_NS).alias("stamp_ns"))
    zero = F.lit(0.0)
    return rows.select("*", *(zero.alias(a) for a in ("wx", "wy", "wz", "ax", "ay")), F.lit(gravity).alias("az"))


def room_scans(spark: SparkSession, sequences: int, scans: int, first_ns: int = 1_100_000_000, period_ns: int = 100_000_000) -> DataFrame:
    """Scans of a cubic room from its middle: a grid on six walls, the points' times spread over the sweep."""
    side, wall = 9, 81
    n = 6 * wall
    ids = spark.range(sequences * scans * n)
    k, scan = F.col("id") % n, F.floor(F.col("id") / n)
    face, a, b = F.floor(k / wall), (k % side) - 4.0, F.floor(k % wall / side) - 4.0
    far = F.when(face % 2 == 0, -SIDE).otherwise(SIDE)
    axis = F.floor(face / 2)
    return ids.select(
        F.concat(F.lit("s"), F.floor(scan / scans).cast("string")).alias("seq"),
        (scan % scans).cast("long").alias("scan_id"),
        (first_ns + (scan % scans) * period_ns).cast("long").alias("stamp_ns"),
        k.cast("int").alias("pt_idx"),
        F.when(axis == 0, far).otherwise(a).cast("float").alias("x"),
        F.when(axis == 1, far).when(axis == 0, a).otherwise(b).cast("float").alias("y"),
        F.when(axis == 2, far).otherwise(b).cast("float").alias("z"),
        F.floor(k * SWEEP_NS / n).cast("long").alias("t_offset_ns"),
    )
