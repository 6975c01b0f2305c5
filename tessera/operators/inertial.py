"""Inertial samples: windows, stationarity, integration."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators.timejoin import BUCKET, POSE, pose_interpolate, running_sums

GYRO, ACCEL = ("wx", "wy", "wz"), ("ax", "ay", "az")


def scan_windows(points: DataFrame, by: Sequence[str], stamp: str = "stamp_ns", offset: str = "t_offset_ns") -> DataFrame:
    """Per scan t_start and t_end: its stamp plus the least and greatest point offset; scans without offsets are dropped."""
    made = points.groupBy(*by, stamp).agg(F.min(offset).alias("_low"), F.max(offset).alias("_high")).filter("_low is not null")
    return made.select(*by, stamp, (F.col(stamp) + F.col("_low")).alias("t_start"), (F.col(stamp) + F.col("_high")).alias("t_end"))


def shift_clock(rows: DataFrame, offset_ns: int, stamp: str = "stamp_ns") -> DataFrame:
    return rows.withColumn(stamp, F.col(stamp) + F.lit(offset_ns))


def scale_acceleration(samples: DataFrame, factor: float) -> DataFrame:
    """samples with their acceleration in other units, e.g. by 9.80665 from g."""
    return samples.withColumns({a: F.col(a) * factor for a in ACCEL})


def static_windows(samples: DataFrame, by: Sequence[str], on: str, axes: Sequence[str], n: int) -> DataFrame:
    """samples with `n_window`, mean_<axis> and var_<axis> (population) over each sample and the n - 1 before it."""
    w = W.partitionBy(*by).orderBy(on).rowsBetween(-(n - 1), W.currentRow)
    stats = [f(a).over(w).alias(f"{name}_{a}") for a in axes for name, f in (("mean", F.avg), ("var", F.var_pop))]
    return samples.select("*", F.count("*").over(w).alias("n_window"), *stats)


def first_static(samples: DataFrame, by: Sequence[str], on: str, n: int, most_accel: float, most_gyro: float, accel: Sequence[str] = ACCEL, gyro: Sequence[str] = GYRO) -> DataFrame:
    """Per key the first full window whose axis variances do not exceed the bounds: its last time and its means."""
    axes = [*accel, *gyro]
    found = static_windows(samples, by, on, axes, n).filter(F.col("n_window") == n)
    still = F.greatest(*(F.col(f"var_{a}") for a in accel)) <= most_accel if len(accel) > 1 else F.col(f"var_{accel[0]}") <= most_accel
    if gyro:
        still = still & (F.greatest(*(F.col(f"var_{a}") for a in gyro)) <= most_gyro if len(gyro) > 1 else F.col(f"var_{gyro[0]}") <= most_gyro)
    held = F.min(F.struct(on, *(f"mean_{a}" for a in axes), *(f"var_{a}" for a in axes))).alias("w")
    return found.filter(still).groupBy(*by).agg(held).select(*by, "w.*")


def _with_earlier(rows: DataFrame, by: Sequence[str], on: str, bucket: int, summary: Column, earlier: Callable[[WindowSpec], Column]) -> DataFrame:
    """rows with `_bucket` and `_carried`: `earlier` over the summaries (`_sum`, one row per key and bucket) of their
    key in order of buckets. Null keys are one key, null times the first bucket."""
    here = rows.withColumn("_bucket", F.floor(F.col(on) / bucket).cast("long"))
    keys = [*by, "_bucket"]
    sums = here.groupBy(*keys).agg(summary.alias("_sum"))
    found = earlier(W.partitionBy(*by).orderBy("_bucket")).alias("_carried")
    carried = sums.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), found)
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return here.join(carried, same).select(*here.columns, "_carried")


def consecutive(samples: DataFrame, by: Sequence[str], on: str, values: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """samples with `dt` seconds since the one before (null for a key's first) and prev_<value>. Dealt out by key and
    time bucket; a bucket's first row takes the last row of the bucket before. Of equal times either comes first."""
    row = F.struct(F.col(on).alias("_at"), *(F.col(v) for v in values))
    carried = _with_earlier(samples, by, on, bucket, F.max(row), lambda w: F.lag("_sum").over(w))
    within = F.lag(row).over(W.partitionBy(*by, "_bucket").orderBy(on))
    paired = carried.select(*samples.columns, F.coalesce(within, F.col("_carried")).alias("_prev"))
    before = [F.col("_prev")[v].alias(f"prev_{v}") for v in values]
    return paired.select(*samples.columns, ((F.col(on) - F.col("_prev")["_at"]) / float(c.NANOS)).alias("dt"), *before)


def trapezoid(samples: DataFrame, by: Sequence[str], on: str, value: str, bias: float = 0.0, bucket: int = BUCKET) -> DataFrame:
    """samples with `step`, the integral of value - bias over the interval before each, and its running sum `integral`."""
    pairs = consecutive(samples, by, on, [value], bucket)
    mid = (F.col(value) + F.col(f"prev_{value}")) / 2.0 - bias
    steps = pairs.withColumn("step", F.coalesce(mid * F.col("dt"), F.lit(0.0)))
    return running_sums(steps, by, on, ["step"], bucket).withColumnRenamed("sum_step", "integral")


def double_integral(samples: DataFrame, by: Sequence[str], on: str, value: str, bucket: int = BUCKET) -> DataFrame:
    """samples with `velocity` and `position`: p += v dt + a dt^2 / 2, v += a dt, a the mean of neighbours, from rest."""
    v = trapezoid(samples, by, on, value, bucket=bucket)
    a = (F.col(value) + F.col(f"prev_{value}")) / 2.0
    move = (F.col("integral") - F.col("step")) * F.col("dt") + 0.5 * a * F.col("dt") * F.col("dt")
    moved = v.withColumn("move", F.coalesce(move, F.lit(0.0)))
    out = running_sums(moved, by, on, ["move"], bucket)
    return out.withColumnRenamed("integral", "velocity").withColumnRenamed("sum_move", "position")


def fold_1d(samples: DataFrame, by: Sequence[str], on: str, value: str) -> DataFrame:
    """The end state of double_integral per key as one ordered fold over a collected array (sequences of bounded length)."""
    ordered = samples.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(on).alias("t"), F.col(value).alias("a")))).alias("s"))
    start = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("p"), F.get("s", F.lit(0))["t"].alias("t"), F.get("s", F.lit(0))["a"].alias("a"))

    def step(s, x):
        dt = (x["t"] - s["t"]) / float(c.NANOS)
        a = (s["a"] + x["a"]) / 2.0
        return F.struct((s["v"] + a * dt).alias("v"), (s["p"] + s["v"] * dt + 0.5 * a * dt * dt).alias("p"), x["t"].alias("t"), x["a"].alias("a"))

    return ordered.select(*by, F.aggregate("s", start, step).alias("e")).select(*by, F.col("e.v").alias("velocity"), F.col("e.p").alias("position"))


def advancing(scans: DataFrame, by: Sequence[str], arrival: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """The scans that end later than every scan of their key that arrived before. Dealt out by key and bucket of
    arrival, with the greatest end of all earlier buckets carried over."""
    carried = _with_earlier(scans, by, arrival, bucket, F.max(end), lambda w: F.max("_sum").over(w.rowsBetween(W.unboundedPreceding, -1)))
    w = W.partitionBy(*by, "_bucket").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1)
    found = carried.withColumn("_before", F.greatest(F.max(end).over(w), F.col("_carried")))
    return found.filter(F.col("_before").isNull() | (F.col(end) > F.col("_before"))).select(*scans.columns)


def after_start(scans: DataFrame, starts: DataFrame, by: Sequence[str], stamp: str = "stamp_ns", start: str = "init_ns") -> DataFrame:
    """The scans later than their sequence's initialisation; sequences without one have none."""
    return scans.join(starts.select(*by, start), list(by)).filter(F.col(stamp) > F.col(start)).drop(start)


def every_nth(rows: DataFrame, index: str, n: int) -> DataFrame:
    return rows.filter(F.col(index) % n == 0)


def topics(messages: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return messages.filter(F.col("topic").isin(list(wanted)))


def multiplex(streams: dict[str, DataFrame], columns: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The streams' common columns under one another, each row tagged with its stream; sorted by `order` (a log's
    chunk and offset, say) if given."""
    out = None
    for tag, df in streams.items():
        rows = df.select(F.lit(tag).alias("stream"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(*order) if order else out


def deskew(points: DataFrame, poses: DataFrame, by: Sequence[str], scan: Sequence[str], extrinsic: tuple | None = None, bucket: int = BUCKET) -> DataFrame:
    """Points (by, scan, stamp_ns, t_offset_ns, x, y, z in the lidar frame) moved to where the lidar was at their scan's end,
    by the poses of the body (by, t_ns, px.., qw..) interpolated on SE(3) at each point's time and at the scan's end.

    extrinsic: (rotation, shift) from the lidar to the body. Poses are looked up once per distinct time of a scan.
    """
    matrix, shift = extrinsic or (((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (0.0, 0.0, 0.0))
    timed = points.withColumn("t_ns", F.col("stamp_ns") + F.col("t_offset_ns"))
    ends = timed.groupBy(*by, *scan).agg(F.max("t_ns").alias("t_ns"))
    pose = {f"r_{n}": n for n in POSE}
    at_end = pose_interpolate(ends, poses, by, "t_ns", bucket).select(*by, *scan, *(F.col(n).alias(r) for r, n in pose.items()))
    times = timed.select(*by, "t_ns").distinct()
    at_time = pose_interpolate(times, poses, by, "t_ns", bucket)
    rows = timed.join(at_time, [*by, "t_ns"]).join(at_end, [*by, *scan])
    body = c.rigid(c.rotation(matrix), c.vector("x", "y", "z"), c.literal(shift))
    q, p = c.vector("qw", "qx", "qy", "qz"), c.vector("px", "py", "pz")
    rq, rp = c.vector("r_qw", "r_qx", "r_qy", "r_qz"), c.vector("r_px", "r_py", "r_pz")
    world = [a + b for a, b in zip(c.quat_rotate(q, body), p, strict=True)]
    back = c.quat_rotate(c.quat_conjugate(rq), [a - b for a, b in zip(world, rp, strict=True)])
    transposed = [[matrix[j][i] for j in range(3)] for i in range(3)]
    moved = c.rigid(c.rotation(transposed), [a - s for a, s in zip(back, c.literal(shift), strict=True)], c.literal((0, 0, 0)))
    return rows.select(*points.columns, *(m.alias(f"d{a}") for m, a in zip(moved, "xyz", strict=True)))


#: Columns of a propagated state.
STATE = "px double, py double, pz double, qw double, qx double, qy double, qz double, vx double, vy double, vz double"


def propagate(samples: DataFrame, by: str, on: str = "stamp_ns", gravity: float = 9.81) -> DataFrame:
    """The pose and velocity at every sample, from rest at the origin with gravity down: the ordered, non-commutative fold.

    One shuffle by the sequence; tasks stream their sequences' samples in order and hold one state.
    """
    from tessera.functions.manifold import State, quat_of
    from tessera.streaming.filter import propagate as step

    schema = f"{by} {dict(samples.dtypes)[by]}, {on} bigint, {STATE}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, stamp, last = None, None, 0, None
        for batch in batches:
            rows = []
            for k, t, *m in batch[[by, on, *GYRO, *ACCEL]].itertuples(index=False):
                m = np.array(m, float)
                if k != key:
                    key, state = k, State(g=np.array([0.0, 0.0, -gravity]))
                else:
                    state = step(state, last, m, (t - stamp) * 1e-9)
                stamp, last = t, m
                rows.append((k, t, *state.p, *quat_of(state.R), *state.v))
            yield pd.DataFrame(rows, columns=names)

    return samples.repartition(by).sortWithinPartitions(by, on).mapInPandas(run, schema)
