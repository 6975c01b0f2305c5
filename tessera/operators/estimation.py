"""Measurement rows, statistical gates and normal equations as column arithmetic and distributive sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as c

#: Names of the twelve measurement columns that can differ from zero, and their places in the 23-dim error state.
H = tuple(f"h{i}" for i in range(12))
H_PLACES = (0, 1, 2, 3, 4, 5, 17, 18, 19, 20, 21, 22)
ERROR_DIM = 23
CHI2 = 3.841


def h_rows(matches: DataFrame, rotation: Sequence[Sequence[float]], extrinsic: Sequence[Sequence[float]], lever: Sequence[float]) -> DataFrame:
    """matches (px, py, pz: lidar frame; nx, ny, nz: world) with their measurement row h0..h11 and z.

    The residual n (R (E p + l) + t) + d, perturbed on the right of R and E: d/dR = (E p + l) x R' n,
    d/dt = n, d/dE = p x (R E)' n, d/dl = R' n.
    """
    n, p = c.vector("nx", "ny", "nz"), c.vector("px", "py", "pz")
    r, e = np.asarray(rotation, float), np.asarray(extrinsic, float)
    turned = [c.dot(c.literal(row), n) for row in r.T]
    deep = [c.dot(c.literal(row), n) for row in (r @ e).T]
    body = c.rigid(c.rotation(e), p, c.literal(lever))
    row = [*c.cross(body, turned), *n, *c.cross(p, deep), *turned]
    return matches.select("*", *(x.alias(h) for x, h in zip(row, H, strict=True)), F.col("residual").alias("z"))


def innovation_variance(covariance: np.ndarray, sigma: float) -> Column:
    """h P h' + sigma^2 for the 12 x 12 block of a covariance that the rows touch."""
    p = np.asarray(covariance, float)
    p = p[np.ix_(H_PLACES, H_PLACES)] if p.shape[0] == ERROR_DIM else p
    terms = [F.col(H[i]) * F.col(H[j]) * float(p[i, j] * (1 if i == j else 2)) for i in range(12) for j in range(i, 12) if p[i, j]]
    total = F.lit(float(sigma) ** 2)
    for t in terms:
        total = total + t
    return total


def chi2_gate(rows: DataFrame, covariance: np.ndarray, sigma: float, limit: float = CHI2) -> DataFrame:
    """The rows whose squared residual over its predicted variance is at most the limit."""
    return rows.filter(F.col("z") * F.col("z") / innovation_variance(covariance, sigma) <= limit)


def normal_equations(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums a_i_j (i <= j) of h_i h_j, b_i of h_i z, and n: one row per key, combined before the shuffle."""
    h = c.vector(*H)
    a = [F.sum(h[i] * h[j]).alias(f"a_{i}_{j}") for i in range(12) for j in range(i, 12)]
    b = [F.sum(h[i] * F.col("z")).alias(f"b_{i}") for i in range(12)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *a, *b)


def equations_of(row) -> tuple[np.ndarray, np.ndarray]:
    """The 23 x 23 matrix H'H and the vector H'z of one row of normal_equations."""
    a, b = np.zeros((ERROR_DIM, ERROR_DIM)), np.zeros(ERROR_DIM)
    for i, u in enumerate(H_PLACES):
        b[u] = row[f"b_{i}"] or 0.0
        for j, v in enumerate(H_PLACES):
            a[u, v] = row[f"a_{min(i, j)}_{max(i, j)}"] or 0.0
    return a, b
