"""Plane fits of neighbourhoods and the association of points with them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import spatial

#: Share of the scale below which a neighbourhood's normal matrix counts as singular.
SINGULAR = 1e-12


@dataclass(frozen=True)
class PlaneParams:
    """Bounds of an association; neighbour_d2 and plane_distance are inclusive, quality is exclusive."""

    k: int = 5
    neighbour_d2: float = 5.0
    plane_distance: float = 0.1
    quality: float = 0.9
    least_normal: float = 1e-6
    least_range: float = 1e-6


def moments(neighbours: DataFrame, by: str | Sequence[str], *extra: Column) -> DataFrame:
    """Sums of the neighbours' coordinates and their products per query: distributive, so combined before a shuffle."""
    x, y, z = c.vector("p_x", "p_y", "p_z")
    terms = {"sx": x, "sy": y, "sz": z, "sxx": x * x, "sxy": x * y, "sxz": x * z, "syy": y * y, "syz": y * z, "szz": z * z}
    keys = [by] if isinstance(by, str) else list(by)
    return neighbours.groupBy(*keys).agg(F.count("*").alias("n"), F.max("d2").alias("max_d2"), *(F.sum(v).alias(k) for k, v in terms.items()), *extra)


SUMS = ("sx", "sy", "sz", "sxx", "sxy", "sxz", "syy", "syz", "szz")


def with_planes(sums: DataFrame, least_normal: float = 1e-6) -> DataFrame:
    """Moment columns replaced by nx, ny, nz, d: the plane n p + d = 0 that solves A m = -1 in least squares, by Cramer's
    rule. d = 1 / |m| is positive, which fixes the normal's sign. Null where the neighbours do not span a plane. Each
    step is columns of its own: as one expression the generated code would not compile."""
    xx, xy, xz, yy, yz, zz = (F.col(k) for k in SUMS[3:])
    # the matrix is symmetric, so its adjugate is too; right-hand side: minus the sums
    adjugate = {"_xx": yy * zz - yz * yz, "_xy": xz * yz - xy * zz, "_xz": xy * yz - xz * yy, "_yy": xx * zz - xz * xz, "_yz": xy * xz - xx * yz, "_zz": xx * yy - xy * xy}
    out = sums.withColumns(adjugate | {"_scale": (xx + yy + zz) / 3.0})
    out = out.withColumn("_det", F.col("sxx") * F.col("_xx") + F.col("sxy") * F.col("_xy") + F.col("sxz") * F.col("_xz"))
    solid = F.abs("_det") > SINGULAR * F.col("_scale") * F.col("_scale") * F.col("_scale")
    rows = (("_xx", "_xy", "_xz"), ("_xy", "_yy", "_yz"), ("_xz", "_yz", "_zz"))
    right = [-F.col(k) for k in SUMS[:3]]
    out = out.withColumns({f"_m{i}": F.when(solid, c.dot(c.vector(*r), right) / F.col("_det")) for i, r in enumerate(rows)})
    out = out.withColumn("_length", c.norm(c.vector("_m0", "_m1", "_m2")))
    ok = F.col("_length") >= least_normal
    made = {a: F.when(ok, F.col(f"_m{i}") / F.col("_length")) for i, a in enumerate(("nx", "ny", "nz"))}
    out = out.withColumns(made | {"d": F.when(ok, 1.0 / F.col("_length"))})
    return out.drop(*SUMS, *adjugate, "_scale", "_det", "_m0", "_m1", "_m2", "_length")


def fit_planes(neighbours: DataFrame, query_id: str, least_normal: float = 1e-6) -> DataFrame:
    """Per query n, max_d2, nx, ny, nz, d; queries without a plane are left out."""
    return with_planes(moments(neighbours, query_id), least_normal).filter(F.col("d").isNotNull())


def associate(points: DataFrame, cloud: DataFrame, query_id: str, point_id: str, params: PlaneParams = PlaneParams(), pose: tuple | None = None, expanding: bool = True) -> DataFrame:
    """Matches of points (query_id, x, y, z, in the body frame) with planes of the cloud's points (point_id, x, y, z).

    pose: (rotation matrix, shift) to the world, identity if None. One row per match: query_id, the body point px, py,
    pz, the unit normal, the residual and its quality. The search writes its levels; then one shuffle brings a point's
    k neighbours together, with their sums combined before it.
    """
    p = c.vector(*spatial.XYZ)
    matrix, shift = (c.rotation(pose[0]), c.literal(pose[1])) if pose else (None, None)
    world = c.rigid(matrix, p, shift) if pose else p
    body = points.select(query_id, *(F.col(a).alias(f"b{a}") for a in spatial.XYZ), *(w.alias(a) for w, a in zip(world, spatial.XYZ, strict=True)))
    radius = params.neighbour_d2**0.5
    search = spatial.knn_expanding if expanding else None
    slim = body.select(query_id, *spatial.XYZ)
    if search:
        radii = [r for r in spatial.LEVELS if r < radius] + [radius]
        near = search(slim, cloud, params.k, query_id, point_id, radii)
    else:
        near = spatial.knn_within(slim, cloud, params.k, radius, query_id, point_id)
    held = F.collect_list(F.struct("p_x", "p_y", "p_z")).alias("_held")  # k at most
    planes = with_planes(moments(near, query_id, held), params.least_normal)
    planes = planes.filter(F.col("d").isNotNull() & (F.col("n") == params.k) & (F.col("max_d2") <= params.neighbour_d2))
    normal = c.vector("nx", "ny", "nz")
    off = F.transform("_held", lambda q: F.abs(c.dot(normal, [q["p_x"], q["p_y"], q["p_z"]]) + F.col("d")))
    planes = planes.filter(F.array_max(off) <= params.plane_distance).drop("_held")
    out = body.join(planes, query_id)
    residual = c.dot(normal, p) + F.col("d")
    reach = c.norm(c.vector("bx", "by", "bz"))
    out = out.withColumn("residual", residual).withColumn("_range", reach).filter(F.col("_range") >= params.least_range)
    out = out.withColumn("quality", 1.0 - 0.9 * F.abs("residual") / F.sqrt("_range")).filter(F.col("quality") > params.quality)
    return out.select(query_id, F.col("bx").alias("px"), F.col("by").alias("py"), F.col("bz").alias("pz"), "nx", "ny", "nz", "residual", "quality")
