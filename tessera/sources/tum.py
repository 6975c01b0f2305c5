"""Trajectories as text: `seconds x y z qx qy qz qw` per line, nine decimals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions import columns as c
from tessera.operators.evaluation import lever_arm

FIELDS = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")


def lines(poses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """`line` of each pose (t_ns, px, py, pz, qw, qx, qy, qz); null if one of them is. Numbers are rounded from their exact
    value, halves to even, as C's printf does; Java's formatter rounds the shortest decimal that names them, halves up."""
    values = {f"_{i}": v.cast("double") for i, v in enumerate((c.seconds_of(F.col("t_ns")), *(F.col(n) for n in POSE)))}
    rows = poses.select(*keep, *(v.alias(n) for n, v in values.items()))
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("line", StringType())])
    line = " ".join(["%.9f"] * len(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = zip(*(x.to_pylist() for x in b.columns[len(keep) :]), strict=True)
            text = pa.array([None if None in row else line % row for row in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], text], schema.names)

    return rows.mapInArrow(run, schema)


def write(poses: DataFrame, path: str, by_time: bool = True) -> None:
    """poses as a folder of text parts, in time order over all parts (a range-partitioned sort, no single task)."""
    ordered = poses.orderBy("t_ns") if by_time else poses
    lines(ordered).write.mode("overwrite").text(path)


def write_run(poses: DataFrame, folder: str, arm: Sequence[float] | None = None, truth: DataFrame | None = None) -> list[str]:
    """A run's files: the body's trajectory and, if there is a ground truth, it and the estimate of the point it follows
    (identity orientation), at `arm` from the body."""
    write(poses, f"{folder}/trajectory.tum")
    made = ["trajectory.tum"]
    if truth is not None:
        level = {"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}
        write(lever_arm(poses, arm or (0.0, 0.0, 0.0)).withColumns(level), f"{folder}/estimate_gt.tum")
        write(truth.withColumns(level), f"{folder}/gt.tum")
        made += ["estimate_gt.tum", "gt.tum"]
    return made


def read(spark: SparkSession, path: str) -> DataFrame:
    """t_sec, tx.., qw of a trajectory file or folder; blank lines and comments (#) are left out."""
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).filter(~F.ltrim("value").startswith("#"))
    parts = F.split(F.trim("value"), r"\s+")
    return rows.select(*(F.get(parts, F.lit(i)).cast("double").alias(n) for i, n in enumerate(("t_sec", *FIELDS))))


def project(spark: SparkSession, path: str, arm: Sequence[float], out: str) -> None:
    """A trajectory file moved to a point at `arm` from the body, its orientations kept."""
    rows = read(spark, path).select(F.round(F.col("t_sec") * 1e9).cast("long").alias("t_ns"), *(F.col(a).alias(b) for a, b in zip(FIELDS, POSE, strict=True)))
    write(lever_arm(rows, arm), out)
