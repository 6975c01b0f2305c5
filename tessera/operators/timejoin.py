"""Joins in time: as-of, interpolation, nearest, interval slices.

Every join deals its rows out by key and time bucket, so a key with a third of all rows spreads over as many tasks as
it has buckets. What must cross a bucket's border is carried by one summary row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as c

#: Default width of a time bucket: one hour of nanoseconds.
BUCKET = 3_600 * c.NANOS


def _neighbours(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, payload: Sequence[str], bucket: int, sides: Sequence[str]) -> DataFrame:
    """left with, for each side in `sides` ("before", "after"), a struct of the nearest right row (on, *payload) at or
    before, at or after the row's time. Right rows of one key and time are expected to be one. Null where there is none."""
    by = list(by)
    row = F.struct(F.col(on).alias("t"), *(F.col(p) for p in payload))
    here = F.floor(F.col(on) / bucket).cast("long").alias("_bucket")
    l_ = left.select("*", here, F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("_r"), F.lit(1).alias("_side"))
    r_ = right.select(*by, on, here, row.alias("_r"), F.lit(0).alias("_side"))
    ends = r_.groupBy(*by, "_bucket").agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    keys = [*by, "_bucket"]
    out = both
    if "before" in sides:
        w = W.partitionBy(*keys).orderBy(F.col(on), "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumn("_before", F.last("_r", ignorenulls=True).over(w))
    if "after" in sides:
        w = W.partitionBy(*keys).orderBy(F.col(on).desc(), "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
        out = out.withColumn("_after", F.last("_r", ignorenulls=True).over(w))
    out = out.filter("_side = 1").drop("_r", "_side")
    # what precedes or follows a bucket: a window over one row per key and bucket that either side has
    frames = l_.select(*keys).unionByName(r_.select(*keys)).distinct().join(ends, keys, "left")
    order = W.partitionBy(*by).orderBy("_bucket") if by else W.partitionBy(F.lit(0)).orderBy("_bucket")
    carried = frames.select(
        *keys,
        F.last("_last", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_carry_before"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_carry_after"),
    )
    out = out.join(carried, keys, "left")
    if "before" in sides:
        out = out.withColumn("before", F.coalesce("_before", "_carry_before"))
    if "after" in sides:
        out = out.withColumn("after", F.coalesce("_after", "_carry_after"))
    return out.drop("_bucket", "_before", "_after", "_carry_before", "_carry_after")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, payload: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """left with the payload of the latest right row at or before its time, and that row's time as `<on>_right`."""
    found = _neighbours(left, right, by, on, payload, bucket, ("before",))
    return found.select(*left.columns, F.col("before.t").alias(f"{on}_right"), *(F.col(f"before.{p}").alias(p) for p in payload))


def asof_interpolate(
    left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], bucket: int = BUCKET, clamped: bool = False, quaternion: Sequence[str] = ()
) -> DataFrame:
    """left with right's values interpolated linearly at its times, and the four columns of a unit quaternion (w, x, y, z),
    if named, along the shorter great arc. Outside right's span: null, or the end's if clamped."""
    found = _neighbours(left, right, by, on, [*values, *quaternion], bucket, ("before", "after"))
    a, b = F.col("before"), F.col("after")
    span = (b["t"] - a["t"]).cast("double")
    alpha = F.when(span > 0, (F.col(on) - a["t"]).cast("double") / span).otherwise(0.0)
    made = [c.lerp(a[v], b[v], alpha) for v in values]
    if quaternion:
        made += c.quat_slerp([a[v] for v in quaternion], [b[v] for v in quaternion], alpha)
    names = [*values, *quaternion]
    if clamped:
        made = [F.coalesce(m, a[v], b[v]) for m, v in zip(made, names, strict=True)]
    return found.select(*left.columns, *(m.alias(v) for m, v in zip(made, names, strict=True)))


#: Columns of a pose: position and unit quaternion.
POSE = ("px", "py", "pz", "qw", "qx", "qy", "qz")


def pose_interpolate(left: DataFrame, poses: DataFrame, by: Sequence[str], on: str, bucket: int = BUCKET) -> DataFrame:
    """left with the pose at its times on the SE(3) geodesic between the neighbouring poses; ends are clamped.

    With a, b the neighbours and (w, u) the twist log(a^-1 b): rotation a exp(alpha w); position follows the screw.
    """
    found = _neighbours(left, poses, by, on, POSE, bucket, ("before", "after"))
    rows = found.withColumns({"_a": F.coalesce("before", "after"), "_b": F.coalesce("after", "before")}).drop("before", "after")

    def named(df: DataFrame, name: str, made: Sequence[Column]) -> tuple[DataFrame, list[Column]]:
        """Each step becomes columns: expressions that used one another in full would grow without bound."""
        names = [f"_{name}{i}" for i in range(len(made))]
        return df.withColumns(dict(zip(names, made, strict=True))), c.vector(*names)

    a, b = F.col("_a"), F.col("_b")
    span = (b["t"] - a["t"]).cast("double")
    rows, (alpha,) = named(rows, "alpha", [c.clamp(F.when(span > 0, (F.col(on) - a["t"]).cast("double") / span).otherwise(0.0), 0.0, 1.0)])
    qa, qb = ([x[k] for k in POSE[3:]] for x in (a, b))
    pa, pb = ([x[k] for k in POSE[:3]] for x in (a, b))
    rows, turn = named(rows, "turn", c.quat_multiply(c.quat_conjugate(qa), qb))
    sign = F.when(turn[0] < 0, -1.0).otherwise(1.0)
    rows, turn = named(rows, "short", [sign * x for x in turn])
    rows, (sine,) = named(rows, "sine", [c.norm(turn[1:])])
    rows, (angle,) = named(rows, "angle", [2.0 * F.atan2(sine, turn[0])])
    still = angle < 1e-9
    rows, axis = named(rows, "axis", [F.when(still, 0.0).otherwise(x / sine) for x in turn[1:]])
    rows, move = named(rows, "move", c.quat_rotate(c.quat_conjugate(qa), [y - x for x, y in zip(pa, pb, strict=True)]))
    # V(angle)^-1 move is the twist's linear part; V(alpha angle) of alpha times it is the position
    half = angle / 2.0
    rows, (k,) = named(rows, "k", [F.when(still, 1.0 / 12.0).otherwise((1.0 - half * F.cos(half) / F.sin(half)) / (angle * angle))])
    w = [angle * x for x in axis]
    rows, once = named(rows, "once", c.cross(w, move))
    rows, linear = named(rows, "linear", [m - 0.5 * x + k * y for m, x, y in zip(move, once, c.cross(w, once), strict=True)])
    part = alpha * angle
    v1 = F.when(still, 0.0).otherwise((1.0 - F.cos(part)) / angle)
    v2 = F.when(still, 0.0).otherwise(alpha - F.sin(part) / angle)
    rows, turned = named(rows, "turned", c.cross(axis, linear))
    rows, shift = named(rows, "shift", [alpha * m + v1 * x + v2 * y for m, x, y in zip(linear, turned, c.cross(axis, turned), strict=True)])
    sin_half = F.sin(part / 2.0)
    rows, raw = named(rows, "q", c.quat_multiply(qa, [F.cos(part / 2.0), *(sin_half * x for x in axis)]))
    position = [x + y for x, y in zip(pa, c.quat_rotate(qa, shift), strict=True)]
    return rows.select(*left.columns, *(x.alias(n) for n, x in zip(POSE, [*position, *c.quat_normalise(raw)], strict=True)))


def nearest_time(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, payload: Sequence[str], tolerance: int, bucket: int = BUCKET) -> DataFrame:
    """left rows with the right row nearest in time within the tolerance; of two as near, the earlier. Others are left out."""
    found = _neighbours(left, right, by, on, payload, bucket, ("before", "after"))
    back, ahead = F.col(on) - F.col("before.t"), F.col("after.t") - F.col(on)
    near = F.when(back.isNull(), F.col("after")).when(ahead.isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    found = found.withColumn("near", near).filter(F.abs(F.col(on) - F.col("near.t")) <= tolerance)
    return found.select(*left.columns, F.col("near.t").alias(f"{on}_right"), *(F.col(f"near.{p}").alias(p) for p in payload))


def interval_join(intervals: DataFrame, samples: DataFrame, by: Sequence[str], start: str, stop: str, on: str, bucket: int = BUCKET) -> DataFrame:
    """Pairs of an interval and a sample strictly inside it (start < on < stop): an equi-join on the time buckets that
    an interval covers, instead of a nested loop over a range condition."""
    first, last = (F.floor(F.col(x) / bucket).cast("long") for x in (start, stop))
    wide = intervals.filter(F.col(start) <= F.col(stop)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    narrow = samples.withColumn("_bucket", F.floor(F.col(on) / bucket).cast("long"))
    inside = (F.col(on) > F.col(start)) & (F.col(on) < F.col(stop))
    return wide.join(narrow, [*by, "_bucket"]).filter(inside).drop("_bucket")


def interval_slice(
    intervals: DataFrame,
    samples: DataFrame,
    by: Sequence[str],
    start: str,
    stop: str,
    on: str,
    values: Sequence[str],
    bucket: int = BUCKET,
    drop_exact_end: bool = False,
    quaternion: Sequence[str] = (),
) -> DataFrame:
    """Per interval the samples inside it and one at each end, interpolated or exact (a quaternion's columns along the
    great arc); intervals that the samples do not cover have none, an interval of one instant has one row. Repeated
    intervals have theirs each, and samples of one time stay. drop_exact_end: without the end row where a sample lies
    exactly there."""
    keys = list(intervals.columns)
    names = [*values, *quaternion]
    inner = interval_join(intervals, samples, by, start, stop, on, bucket).select(*keys, on, *names)
    out = inner
    ends = []
    for edge in (start, stop):
        open_ = intervals if edge == start else intervals.filter(F.col(start) < F.col(stop))
        at = asof_interpolate(open_.withColumn(on, F.col(edge)), samples, by, on, values, bucket, quaternion=quaternion)
        if edge == stop and drop_exact_end:
            exact = samples.select(*by, F.col(on).alias("_exact")).distinct()
            at = at.join(exact, [*(at[b] == exact[b] for b in by), at[on] == exact["_exact"]], "left_anti")
        ends.append(at.filter(F.col(names[0]).isNotNull()).select(*keys, on, *names))
    covered = samples.groupBy(*by).agg(F.min(on).alias("_low"), F.max(on).alias("_high"))
    out = out.unionByName(ends[0]).unionByName(ends[1])
    out = out.join(covered, list(by))
    return out.filter((F.col("_low") <= F.col(start)) & (F.col("_high") >= F.col(stop))).drop("_low", "_high")


def covered(intervals: DataFrame, samples: DataFrame, by: Sequence[str], start: str, stop: str, on: str) -> DataFrame:
    """intervals with `covered`: whether the samples' first and last times enclose it."""
    span = samples.groupBy(*by).agg(F.min(on).alias("_low"), F.max(on).alias("_high"))
    inside: Column = (F.col("_low") <= F.col(start)) & (F.col("_high") >= F.col(stop))
    return intervals.join(span, list(by), "left").withColumn("covered", F.coalesce(inside, F.lit(False))).drop("_low", "_high")


def running_sums(rows: DataFrame, by: Sequence[str], on: str, values: Sequence[str], bucket: int = BUCKET) -> DataFrame:
    """rows with `sum_<value>`: the sum of all rows of its key up to it, in time order, in two levels: within buckets,
    and over one row per bucket."""
    by = list(by)
    here = rows.withColumn("_bucket", F.floor(F.col(on) / bucket).cast("long"))
    keys = [*by, "_bucket"]
    w = W.partitionBy(*keys).orderBy(on).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = here.groupBy(*keys).agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    carried = totals.select(*keys, *(F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0.0)).alias(f"_c_{v}") for v in values))
    out = here.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0.0)).alias(f"_s_{v}") for v in values)).join(carried, keys)
    return out.select(*rows.columns, *((F.col(f"_s_{v}") + F.col(f"_c_{v}")).alias(f"sum_{v}") for v in values))
