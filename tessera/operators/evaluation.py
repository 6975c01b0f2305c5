"""Trajectory evaluation and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators.timejoin import nearest_time

#: Fixed value: seconds within which an estimate and a true position belong together.
TOLERANCE_NS = 30_000_000
EST, TRUE = ("ex", "ey", "ez"), ("tx", "ty", "tz")


def pair_up(estimate: DataFrame, truth: DataFrame, by: Sequence[str], on: str = "t_ns", tolerance: int = TOLERANCE_NS) -> DataFrame:
    """Each estimate (px, py, pz) with the true position nearest in time: by, on, ex..ez, tx..tz."""
    named = truth.select(*by, on, *(F.col(a).alias(t) for a, t in zip(("px", "py", "pz"), TRUE, strict=True)))
    rows = nearest_time(estimate, named, by, on, TRUE, tolerance)
    return rows.withColumnsRenamed(dict(zip(("px", "py", "pz"), EST, strict=True)))


def error(aligned: Sequence[Column] | None = None) -> Column:
    """Squared distance of an estimate (as it is, or aligned) to the truth."""
    return c.squared_distance(aligned or c.vector(*EST), c.vector(*TRUE))


def ate(pairs: DataFrame, by: Sequence[str] = (), aligned: Sequence[Column] | None = None) -> DataFrame:
    """Root mean square of the position errors, and the number of pairs."""
    return pairs.groupBy(*by).agg(F.sqrt(F.avg(error(aligned))).alias("ate_rmse"), F.count("*").alias("n"))


def alignment_moments(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Means of both trajectories and their nine cross-covariances (population): what a rigid alignment needs."""
    means = [F.avg(x).alias(f"mean_{x}") for x in (*EST, *TRUE)]
    cross = [F.covar_pop(t, e).alias(f"c_{t}_{e}") for t in TRUE for e in EST]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *means, *cross)


def rigid_alignment(row) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that take the estimates to the truth with least squared error, from one moments row."""
    cov = np.array([[row[f"c_{t}_{e}"] for e in EST] for t in TRUE])
    u, _, vt = np.linalg.svd(cov)
    r = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt
    return r, np.array([row[f"mean_{t}"] for t in TRUE]) - r @ np.array([row[f"mean_{e}"] for e in EST])


def aligned_ate(pairs: DataFrame) -> DataFrame:
    """ate after a rigid alignment of all pairs: one row of moments goes to the driver, the errors stay distributed."""
    moments = alignment_moments(pairs).first()
    if not moments["n"]:
        return ate(pairs)
    r, t = rigid_alignment(moments)
    return ate(pairs, aligned=c.rigid(c.rotation(r), c.vector(*EST), c.literal(t)))


def relative_errors(pairs: DataFrame, by: Sequence[str], on: str, step_ns: int, tolerance: int) -> DataFrame:
    """RPE of positions: over pairs about step_ns apart, the RMSE of the difference of their displacements' lengths."""
    ahead = pairs.select(*by, F.col(on).alias("_t"), *(F.col(x).alias(f"n_{x}") for x in (*EST, *TRUE)))
    later = pairs.withColumn("_t", F.col(on) + step_ns)
    both = nearest_time(later, ahead, by, "_t", [f"n_{x}" for x in (*EST, *TRUE)], tolerance)
    moved = [c.norm([F.col(f"n_{x}") - F.col(x) for x in axes]) for axes in (EST, TRUE)]
    return both.agg(F.sqrt(F.avg((moved[0] - moved[1]) ** 2)).alias("rpe_rmse"), F.count("*").alias("n"))


def extrinsic_drift(results: DataFrame, translation: Sequence[float], quaternion: Sequence[float], by: Sequence[str] = ("seq",), on: str = "scan_index") -> DataFrame:
    """How far the estimated extrinsic of each key's last result is from its seed: degrees and metres. Null extrinsics
    give nulls."""
    last = results.groupBy(*by).agg(F.max_by(F.struct("extrinsic_p", "extrinsic_q"), on).alias("_e"))
    p, q = ([F.col(f"_e.{n}")[i] for i in range(k)] for n, k in (("extrinsic_p", 3), ("extrinsic_q", 4)))
    away = c.norm([x - float(y) for x, y in zip(p, translation, strict=True)])
    return last.select(*by, rotation_angle_degrees(c.literal(tuple(quaternion)), q).alias("drift_degrees"), away.alias("drift_m"))


def progress(results: DataFrame, every: int = 100, by: Sequence[str] = ("seq",), on: str = "scan_index") -> DataFrame:
    """The counters of every so many scans and of the last: scans, converged scans, iterations and their mean, dropped."""
    last = results.groupBy(*by).agg(F.max(on).alias("_last"))
    rows = results.join(last, list(by)).filter((F.col(on) % every == 0) | (F.col(on) == F.col("_last")))
    return rows.select(*by, on, "converged_scans", "total_iterations", (F.col("total_iterations") / F.col(on)).alias("mean_iterations"), "dropped_scans", "map_size")


def tilt_degrees(q: Sequence[Column], sign: float = 1.0) -> Column:
    """The angle between the body's and the world's vertical: acos of the rotation's last diagonal entry."""
    w, x, y, z = q
    return F.degrees(F.acos(c.clamp(sign * (w * w - x * x - y * y + z * z), -1.0, 1.0)))


def run_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scans, converged scans, iterations, their share and mean."""
    return results.groupBy(*by).agg(
        F.count("*").alias("scans"),
        F.sum(F.col("converged").cast("long")).alias("converged"),
        F.sum("iterations").alias("iterations"),
        (100.0 * F.avg(F.col("converged").cast("double"))).alias("converged_percent"),
        F.avg("iterations").alias("mean_iterations"),
    )


def rotation_angle_degrees(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The angle between two unit quaternions' rotations."""
    turn = c.quat_multiply(c.quat_conjugate(a), b)
    return F.degrees(2.0 * F.atan2(c.norm(turn[1:]), F.abs(turn[0])))


def lever_arm(poses: DataFrame, arm: Sequence[float]) -> DataFrame:
    """poses (px.., qw..) with the position of a point fixed to the body at `arm`."""
    moved = c.quat_rotate(c.vector("qw", "qx", "qy", "qz"), c.literal(arm))
    return poses.withColumns({n: F.col(n) + m for n, m in zip(("px", "py", "pz"), moved, strict=True)})
