"""Named queries over the driver's tables, each with its SQL twin.

The tables hold no sensor data, so operators run over fixed views of them, the same in SQL:

* `pts`: lineitem as points, x = quantity, y = price / 2000, z = 100 discount, intensity = tax;
* `imu`: events as one-axis samples, seq = user, stamp_ns = time, a = value;
* `cloud`: embeddings as points, ten times their first three components; even ids are the map, odd ids a scan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators import estimation, evaluation, inertial, planes, spatial, timejoin
from tessera.session import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOUR, DAY = 3_600 * c.NANOS, 86_400 * c.NANOS

PTS_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS x, l_extendedprice / 2000 AS y, l_discount * 100 AS z, l_tax AS intensity FROM lineitem"
IMU_SQL = "SELECT user_id AS seq, epoch_us(ts) * 1000 AS stamp_ns, event_id, event_type AS topic, value AS a FROM events"
CLOUD_SQL = "SELECT vec_id, 10 * CAST(embedding[1] AS DOUBLE) AS x, 10 * CAST(embedding[2] AS DOUBLE) AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z, label FROM embeddings"
ID = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def pts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    return t.select(*ID, F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"), (F.col("l_discount") * 100).alias("z"), F.col("l_tax").alias("intensity"))


def imu(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events")
    return t.select(F.col("user_id").alias("seq"), c.nanos_of(F.col("ts")).alias("stamp_ns"), "event_id", F.col("event_type").alias("topic"), F.col("value").alias("a"))


def cloud(spark: SparkSession, d: str, scale: float = 10) -> DataFrame:
    t = table(spark, d, "embeddings")
    return t.select("vec_id", *((scale * F.get("embedding", F.lit(i)).cast("double")).alias(n) for i, n in enumerate(spatial.XYZ)), "label")


def _map_and_scan(spark: SparkSession, d: str, scale: float = 10) -> tuple[DataFrame, DataFrame]:
    all_ = cloud(spark, d, scale)
    return all_.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("point_id"), *spatial.XYZ), all_.filter("vec_id % 2 = 1")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """names rounded, as sums of doubles depend on their order in the last bits; negative zeros become zeros."""
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


# --- voxels and filters ----------------------------------------------------------------------------------------


@query(f"""SELECT CAST(floor(x / 5) AS BIGINT) AS cx, CAST(floor(y / 5) AS BIGINT) AS cy, CAST(floor(z / 5) AS BIGINT) AS cz,
  round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z, round(avg(intensity), 6) + 0.0 AS intensity, count(*) AS n
  FROM ({PTS_SQL}) WHERE isfinite(x) AND isfinite(y) AND isfinite(z) GROUP BY 1, 2, 3""")
def voxel_centroid(spark, d):
    return _rounded(spatial.voxel_centroid(pts(spark, d), 5.0), "x", "y", "z", "intensity")


@query(f"""SELECT {", ".join(ID)}, (CAST(floor(x) AS BIGINT) + 1048576) % 2097152 + 2097152 * ((CAST(floor(y) AS BIGINT) + 1048576) % 2097152)
  + 4398046511104 * ((CAST(floor(z) AS BIGINT) + 1048576) % 2097152) AS packed FROM ({PTS_SQL})""")
def voxel_key_packed(spark, d):
    return pts(spark, d).select(*ID, c.packed_cell([c.cell(F.col(a), 1.0) for a in spatial.XYZ]).alias("packed"))


@query(f"SELECT {', '.join(ID)}, x, y, z FROM ({PTS_SQL}) WHERE x BETWEEN 5 AND 40 AND y BETWEEN 2 AND 30 AND z BETWEEN 1 AND 8")
def crop_box(spark, d):
    return spatial.crop_box(pts(spark, d), (5, 2, 1), (40, 30, 8)).select(*ID, *spatial.XYZ)


@query(f"SELECT {', '.join(ID)}, least(x - 0, 50 - x, y - 0, 55 - y, z + 1, 11 - z) < 2 AS slides FROM ({PTS_SQL})")
def slide_trigger(spark, d):
    p = c.vector(*spatial.XYZ)
    return pts(spark, d).select(*ID, spatial.needs_slide(p, c.literal((0, 0, -1)), c.literal((50, 55, 11)), 2.0).alias("slides"))


@query(f"""WITH p AS (SELECT x, y, z, x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 AND z BETWEEN 0 AND 5 AS gone FROM ({PTS_SQL}))
  SELECT CAST(floor(x / 10) AS BIGINT) AS cx, CAST(floor(y / 10) AS BIGINT) AS cy, CAST(floor(z / 10) AS BIGINT) AS cz,
  count(*) AS n_all, count(*) FILTER (NOT gone) AS n_live, min(x) FILTER (NOT gone) AS min_x, max(z) FILTER (NOT gone) AS max_z FROM p GROUP BY 1, 2, 3""")
def lazy_delete_live(spark, d):
    some = spatial.append_points(spark.createDataFrame([], f"{', '.join(f'{a} double' for a in spatial.XYZ)}, valid_from long, valid_to long"), pts(spark, d).select(*spatial.XYZ), 1)
    return spatial.cell_summary(spatial.remove_box(some, (10, 5, 0), (30, 25, 5), 2), 10.0).select(*spatial.CELL, "n_all", "n_live", "min_x", "max_z")


@query(f"""WITH m AS (SELECT * FROM ({CLOUD_SQL}) WHERE vec_id % 2 = 0), s AS (SELECT * FROM ({CLOUD_SQL}) WHERE vec_id % 2 = 1)
  SELECT vec_id, x, y, z FROM s WHERE NOT EXISTS (SELECT 1 FROM m WHERE (s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y) + (s.z - m.z) * (s.z - m.z) < 0.25)""")
def voxel_insert_anti(spark, d):
    known, scan = _map_and_scan(spark, d)
    return spatial.insert_new_by_id(scan.select("vec_id", *spatial.XYZ), known, 0.5, "vec_id")


# --- neighbours and planes -------------------------------------------------------------------------------------

_PAIRS_SQL = f"""m AS (SELECT vec_id AS point_id, x, y, z FROM ({CLOUD_SQL}) WHERE vec_id % 2 = 0), s AS (SELECT * FROM ({CLOUD_SQL}) WHERE vec_id % 2 = 1),
  pairs AS (SELECT s.vec_id, m.point_id, m.x AS px, m.y AS py, m.z AS pz, (s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y) + (s.z - m.z) * (s.z - m.z) AS d2 FROM s, m),
  near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, point_id) AS rank FROM pairs QUALIFY rank <= 5)"""


@query(f"WITH {_PAIRS_SQL} SELECT vec_id, point_id, rank, round(d2, 6) AS d2 FROM near")
def knn5(spark, d):
    known, scan = _map_and_scan(spark, d)
    near = spatial.knn_unbounded(scan.select("vec_id", *spatial.XYZ), known, 5, "vec_id", "point_id", start=1.0)
    return near.select("vec_id", "point_id", F.col("rank").cast("long").alias("rank"), F.round("d2", 6).alias("d2"))


@query(f"WITH {_PAIRS_SQL} SELECT vec_id, point_id, rank, round(d2, 6) AS d2 FROM near WHERE d2 <= 2.25")
def knn_grid(spark, d):
    known, scan = _map_and_scan(spark, d)
    near = spatial.knn_within(scan.select("vec_id", *spatial.XYZ), known, 5, 1.5, "vec_id", "point_id")
    return near.select("vec_id", "point_id", F.col("rank").cast("long").alias("rank"), F.round("d2", 6).alias("d2"))


@query(f"WITH {_PAIRS_SQL}, g AS (SELECT vec_id, point_id, rank, d2 FROM near WHERE d2 <= 5) SELECT vec_id, count(*) AS n, round(max(d2), 6) AS max_d2 FROM g GROUP BY vec_id")
def knn_expanding(spark, d):
    known, scan = _map_and_scan(spark, d)
    near = spatial.knn_expanding(scan.select("vec_id", *spatial.XYZ), known, 5, "vec_id", "point_id")
    return near.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.max("d2"), 6).alias("max_d2"))


_PLANES_SQL = """mom AS (SELECT vec_id, count(*) AS n, max(d2) AS max_d2, sum(px) AS sx, sum(py) AS sy, sum(pz) AS sz, sum(px * px) AS sxx, sum(px * py) AS sxy, sum(px * pz) AS sxz,
    sum(py * py) AS syy, sum(py * pz) AS syz, sum(pz * pz) AS szz FROM near WHERE d2 <= 5 GROUP BY vec_id),
  det AS (SELECT *, sxx * (syy * szz - syz * syz) - sxy * (sxy * szz - syz * sxz) + sxz * (sxy * syz - syy * sxz) AS det FROM mom),
  sol AS (SELECT *, -((syy * szz - syz * syz) * sx + (sxz * syz - sxy * szz) * sy + (sxy * syz - sxz * syy) * sz) / det AS mx,
    -((sxz * syz - sxy * szz) * sx + (sxx * szz - sxz * sxz) * sy + (sxy * sxz - sxx * syz) * sz) / det AS my,
    -((sxy * syz - sxz * syy) * sx + (sxy * sxz - sxx * syz) * sy + (sxx * syy - sxy * sxy) * sz) / det AS mz FROM det
    WHERE abs(det) > 1e-12 * pow((sxx + syy + szz) / 3, 3)),
  pl AS (SELECT vec_id, n, max_d2, mx / l AS nx, my / l AS ny, mz / l AS nz, 1 / l AS d FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM sol) WHERE l >= 1e-6)"""


@query(f"WITH {_PAIRS_SQL}, {_PLANES_SQL} SELECT vec_id, n, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz, round(d, 4) + 0.0 AS d FROM pl")
def plane_fit(spark, d):
    known, scan = _map_and_scan(spark, d)
    near = spatial.knn_blocks(scan, known, 5, 5.0, "vec_id", "point_id")
    return _rounded(planes.fit_planes(near, "vec_id").drop("max_d2"), "nx", "ny", "nz", "d", digits=4)


def _assoc_sql(scale: float) -> str:
    pairs = _PAIRS_SQL.replace("10 * CAST", f"{scale} * CAST")
    return f"""WITH {pairs}, {_PLANES_SQL},
  ok AS (SELECT pl.* FROM pl JOIN (SELECT near.vec_id, max(abs(nx * px + ny * py + nz * pz + d)) AS off FROM near JOIN pl USING (vec_id) WHERE near.d2 <= 5 GROUP BY near.vec_id) o
    USING (vec_id) WHERE n = 5 AND max_d2 <= 5 AND off <= 0.1),
  r AS (SELECT s.vec_id, s.x AS px, s.y AS py, s.z AS pz, nx, ny, nz, nx * s.x + ny * s.y + nz * s.z + d AS residual, sqrt(s.x * s.x + s.y * s.y + s.z * s.z) AS reach
    FROM s JOIN ok USING (vec_id)),
  q AS (SELECT *, 1 - 0.9 * abs(residual) / sqrt(reach) AS quality FROM r WHERE reach >= 1e-6)
  SELECT vec_id, round(px, 6) + 0.0 AS px, round(py, 6) + 0.0 AS py, round(pz, 6) + 0.0 AS pz, round(nx, 4) + 0.0 AS nx, round(ny, 4) + 0.0 AS ny, round(nz, 4) + 0.0 AS nz,
    round(residual, 4) + 0.0 AS residual, round(quality, 4) + 0.0 AS quality FROM q WHERE quality > 0.9"""


def _associate(spark, d, scale):
    known, scan = _map_and_scan(spark, d, scale)
    out = planes.associate(scan.select("vec_id", *spatial.XYZ), known, "vec_id", "point_id")
    return _rounded(_rounded(out, "px", "py", "pz"), "nx", "ny", "nz", "residual", "quality", digits=4)


@query(_assoc_sql(10))
def plane_assoc(spark, d):
    return _associate(spark, d, 10)


@query(_assoc_sql(20))
def plane_assoc_sparse(spark, d):
    return _associate(spark, d, 20)


# --- geometry --------------------------------------------------------------------------------------------------

_TURN = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
_TILT = ((0.8, 0.0, 0.6), (0.0, 1.0, 0.0), (-0.6, 0.0, 0.8))
_Q = (0.5, 0.5, -0.5, 0.5)


@query(f"SELECT {', '.join(ID)}, round(0.8 * x + 0.6 * z + 1, 6) + 0.0 AS wx, round(y - 2, 6) + 0.0 AS wy, round(-0.6 * x + 0.8 * z + 0.5, 6) + 0.0 AS wz FROM ({PTS_SQL})")
def rigid_transform(spark, d):
    w = c.rigid(c.rotation(_TILT), c.vector(*spatial.XYZ), c.literal((1, -2, 0.5)))
    return _rounded(pts(spark, d).select(*ID, *(v.alias(n) for v, n in zip(w, ("wx", "wy", "wz"), strict=True))), "wx", "wy", "wz")


@query(f"SELECT vec_id, round(y, 6) + 0.0 AS rx, round(-z, 6) + 0.0 AS ry, round(-x, 6) + 0.0 AS rz FROM ({CLOUD_SQL})")
def quat_rotate(spark, d):
    sent = c.quat_rotate(c.literal(_Q), [-F.col("x"), -F.col("y"), F.col("z")])
    return _rounded(cloud(spark, d).select("vec_id", *(s.alias(n) for s, n in zip(sent, ("rx", "ry", "rz"), strict=True))), "rx", "ry", "rz")


@query(f"""SELECT vec_id, round(x + 0.1 * (q0 * q0 + q1 * q1 - q2 * q2 - q3 * q3), 6) + 0.0 AS px, round(y + 0.2 * (q1 * q2 + q0 * q3), 6) + 0.0 AS py,
  round(z + 0.2 * (q1 * q3 - q0 * q2), 6) + 0.0 AS pz FROM (SELECT vec_id, x, y, z, 1 / n AS q0, x / n AS q1, y / n AS q2, z / n AS q3
  FROM (SELECT *, sqrt(1 + x * x + y * y + z * z) AS n FROM ({CLOUD_SQL})))""")
def lever_arm(spark, d):
    q = c.quat_normalise([F.lit(1.0), *c.vector(*spatial.XYZ)])
    poses = cloud(spark, d).select("vec_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *(v.alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)))
    return _rounded(evaluation.lever_arm(poses, (0.1, 0.0, 0.0)).select("vec_id", "px", "py", "pz"), "px", "py", "pz")


@query(f"""WITH u AS (SELECT vec_id, x / n AS ux, y / n AS uy, z / n AS uz FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM ({CLOUD_SQL}))),
  s AS (SELECT *, CASE WHEN abs(uz) >= 0.9 THEN 1.0 ELSE 0.0 END AS sx, CASE WHEN abs(uz) >= 0.9 THEN 0.0 ELSE 1.0 END AS sz FROM u),
  g AS (SELECT *, sx - (sx * ux + sz * uz) * ux AS ax, -(sx * ux + sz * uz) * uy AS ay, sz - (sx * ux + sz * uz) * uz AS az FROM s),
  b AS (SELECT *, ax / m AS bx, ay / m AS by_, az / m AS bz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM g))
  SELECT vec_id, round(bx, 6) + 0.0 AS b1x, round(by_, 6) + 0.0 AS b1y, round(bz, 6) + 0.0 AS b1z, round(uy * bz - uz * by_, 6) + 0.0 AS b2x,
    round(uz * bx - ux * bz, 6) + 0.0 AS b2y, round(ux * by_ - uy * bx, 6) + 0.0 AS b2z FROM b""")
def s2_basis(spark, d):
    first, second = c.tangent_basis(c.vector(*spatial.XYZ))
    names = [f"b{i}{a}" for i in (1, 2) for a in spatial.XYZ]
    return _rounded(cloud(spark, d).select("vec_id", *(v.alias(n) for v, n in zip([*first, *second], names, strict=True))), *names)


@query(f"""WITH q AS (SELECT vec_id, 1 / n AS w, x / n AS i, y / n AS j, z / n AS k FROM (SELECT *, sqrt(1 + x * x + y * y + z * z) AS n FROM ({CLOUD_SQL}))),
  a AS (SELECT *, acos(least(w, 1.0)) AS t FROM q)
  SELECT vec_id, round(sin(0.75 * t) / sin(t) + sin(0.25 * t) / sin(t) * w, 6) + 0.0 AS sw, round(sin(0.25 * t) / sin(t) * i, 6) + 0.0 AS sx,
  round(sin(0.25 * t) / sin(t) * j, 6) + 0.0 AS sy, round(sin(0.25 * t) / sin(t) * k, 6) + 0.0 AS sz FROM a""")
def slerp(spark, d):
    q = c.quat_normalise([F.lit(1.0), *c.vector(*spatial.XYZ)])
    s = c.quat_slerp(c.literal((1, 0, 0, 0)), q, F.lit(0.25))
    return _rounded(cloud(spark, d).select("vec_id", *(v.alias(n) for v, n in zip(s, ("sw", "sx", "sy", "sz"), strict=True))), "sw", "sx", "sy", "sz")


_RAMP_SQL = "(least(greatest((z + 2) / 32, 0.0), 1.0) * 4)"


@query(f"""SELECT {', '.join(ID)}, CAST(floor(255 * least(greatest(s - 2, 0.0), 1.0)) AS INT) AS red,
  CAST(floor(255 * CASE WHEN s < 2 THEN least(greatest(s, 0.0), 1.0) ELSE 1 - least(greatest(s - 3, 0.0), 1.0) END) AS INT) AS green,
  CAST(floor(255 * (1 - least(greatest(s - 1, 0.0), 1.0))) AS INT) AS blue FROM (SELECT *, {_RAMP_SQL} AS s FROM ({PTS_SQL}))""")
def height_colour(spark, d):
    return pts(spark, d).select(*ID, *(v.alias(n) for v, n in zip(c.height_colour(F.col("z")), ("red", "green", "blue"), strict=True)))


@query(f"""SELECT {', '.join(ID)}, round(pow(greatest(5 - x, x - 30, 0), 2) + pow(greatest(3 - y, y - 20, 0), 2) + pow(greatest(1 - z, z - 4, 0), 2), 6) AS d2 FROM ({PTS_SQL})""")
def box_distance(spark, d):
    return pts(spark, d).select(*ID, F.round(c.box_distance(c.vector(*spatial.XYZ), c.literal((5, 3, 1)), c.literal((30, 20, 4))), 6).alias("d2"))


# --- measurements ----------------------------------------------------------------------------------------------

#: n = (0.6, 0, 0.8) for every point: R = turn by 90 degrees about z, E = tilt, lever (0.1, 0.2, 0.3)
_H_SQL = f"""SELECT vec_id, 0.8 * x + 0.6 * z + 0.1 AS bx, y + 0.2 AS byy, -0.6 * x + 0.8 * z + 0.3 AS bz, x, y, z, 0.6 * x + 0.8 * z - 1 AS z_ FROM ({CLOUD_SQL})"""
_HROW_SQL = f"""SELECT vec_id, z_ AS z, byy * 0.8 - bz * -0.6 AS h0, bz * 0.0 - bx * 0.8 AS h1, bx * -0.6 - byy * 0.0 AS h2, 0.6 AS h3, 0.0 AS h4, 0.8 AS h5,
  y * 0.64 - z * -0.6 AS h6, z * -0.48 - x * 0.64 AS h7, x * -0.6 - y * -0.48 AS h8, 0.0 AS h9, -0.6 AS h10, 0.8 AS h11 FROM ({_H_SQL})"""
_PRIOR = np.diag([0.01] * 12) + 0.002 * (np.ones((12, 12)) - np.eye(12))


def _h(spark, d):
    p = cloud(spark, d).select("vec_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))
    return estimation.h_rows(p.withColumn("residual", 0.6 * F.col("px") + 0.8 * F.col("pz") - 1), _TURN, _TILT, (0.1, 0.2, 0.3)).select("vec_id", *estimation.H, "z")


@query(f"SELECT vec_id, {', '.join(f'round({h}, 6) + 0.0 AS {h}' for h in (*estimation.H, 'z'))} FROM ({_HROW_SQL})")
def h_rows(spark, d):
    return _rounded(_h(spark, d), *estimation.H, "z")


_SUM_SQL = " + ".join(estimation.H)
_SQ_SQL = " + ".join(f"{h} * {h}" for h in estimation.H)


@query(f"SELECT vec_id, round(z, 6) + 0.0 AS z FROM ({_HROW_SQL}) WHERE z * z / (0.008 * ({_SQ_SQL}) + 0.002 * ({_SUM_SQL}) * ({_SUM_SQL}) + 0.01) <= 3.841")
def chi2_gate(spark, d):
    return _rounded(estimation.chi2_gate(_h(spark, d), _PRIOR, 0.1).select("vec_id", "z"), "z")


@query(f"""SELECT label, count(*) AS n, {', '.join(f'round(sum(h{i} * h{j}), 4) + 0.0 AS a_{i}_{j}' for i in range(12) for j in range(i, 12))},
  {', '.join(f'round(sum(h{i} * z), 4) + 0.0 AS b_{i}' for i in range(12))} FROM ({_HROW_SQL}) JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label""")
def normal_equations(spark, d):
    rows = _h(spark, d).join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    out = estimation.normal_equations(rows, ["label"])
    return _rounded(out, *(n for n in out.columns if n not in ("label", "n")), digits=4)


# --- time ------------------------------------------------------------------------------------------------------


@query(f"""SELECT seq, (stamp_ns // {DAY}) * {DAY} AS stamp_ns, min(stamp_ns) AS t_start, max(stamp_ns) AS t_end FROM ({IMU_SQL}) GROUP BY 1, 2""")
def scan_time_window(spark, d):
    day = F.floor(F.col("stamp_ns") / DAY).cast("long") * DAY
    rows = imu(spark, d).select("seq", day.alias("day"), (F.col("stamp_ns") - day).alias("t_offset_ns"))
    return inertial.scan_windows(rows.withColumnRenamed("day", "stamp_ns"), ["seq"])


@query(f"""WITH w AS (SELECT seq, stamp_ns, count(*) OVER w AS n, avg(a) OVER w AS m, var_pop(a) OVER w AS v FROM ({IMU_SQL})
  WINDOW w AS (PARTITION BY seq ORDER BY stamp_ns ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT seq, min(stamp_ns) AS stamp_ns, round(arg_min(m, stamp_ns), 4) AS mean_a, round(arg_min(v, stamp_ns), 8) AS var_a FROM w WHERE n = 20 AND v <= 2500 GROUP BY seq""")
def static_init_window(spark, d):
    found = inertial.first_static(imu(spark, d), ["seq"], "stamp_ns", 20, 2500.0, 0.0, accel=("a",), gyro=())
    return _rounded(_rounded(found, "mean_a", digits=4), "var_a", digits=8)


_STEP_SQL = f"SELECT *, (stamp_ns - lag(stamp_ns) OVER w) / 1e9 AS dt, (a + lag(a) OVER w) / 2 AS mid FROM ({IMU_SQL}) WINDOW w AS (PARTITION BY seq ORDER BY stamp_ns)"


@query(f"""SELECT seq, stamp_ns, round(sum(coalesce((mid - 0.5) * dt, 0)) OVER (PARTITION BY seq ORDER BY stamp_ns) / 1e6, 5) + 0.0 AS velocity FROM ({_STEP_SQL})""")
def imu_trapezoid_velocity(spark, d):
    rows = inertial.trapezoid(imu(spark, d), ["seq"], "stamp_ns", "a", bias=0.5, bucket=5 * DAY)
    return rows.select("seq", "stamp_ns", (F.round(F.col("integral") / 1e6, 5) + 0.0).alias("velocity"))


_DOUBLE_SQL = f"""WITH s AS (SELECT *, coalesce(mid * dt, 0) AS step FROM ({_STEP_SQL})), v AS (SELECT *, sum(step) OVER (PARTITION BY seq ORDER BY stamp_ns) AS velocity FROM s),
  m AS (SELECT *, coalesce((velocity - step) * dt + 0.5 * mid * dt * dt, 0) AS move FROM v), p AS (SELECT *, sum(move) OVER (PARTITION BY seq ORDER BY stamp_ns) AS position FROM m)"""


@query(f"{_DOUBLE_SQL} SELECT seq, stamp_ns, round(velocity / 1e6, 4) + 0.0 AS velocity, round(position / 1e12, 4) + 0.0 AS position FROM p")
def imu_double_integral(spark, d):
    rows = inertial.double_integral(imu(spark, d), ["seq"], "stamp_ns", "a", bucket=5 * DAY)
    return rows.select("seq", "stamp_ns", (F.round(F.col("velocity") / 1e6, 4) + 0.0).alias("velocity"), (F.round(F.col("position") / 1e12, 4) + 0.0).alias("position"))


@query(f"{_DOUBLE_SQL} SELECT seq, round(arg_max(velocity, stamp_ns) / 1e6, 4) + 0.0 AS velocity, round(arg_max(position, stamp_ns) / 1e12, 4) + 0.0 AS position FROM p GROUP BY seq")
def imu_fold(spark, d):
    rows = inertial.fold_1d(imu(spark, d), ["seq"], "stamp_ns", "a")
    return rows.select("seq", (F.round(F.col("velocity") / 1e6, 4) + 0.0).alias("velocity"), (F.round(F.col("position") / 1e12, 4) + 0.0).alias("position"))


_SPLIT = f"l AS (SELECT seq, stamp_ns, event_id FROM ({IMU_SQL}) WHERE topic = 'click'), r AS (SELECT seq, stamp_ns, a FROM ({IMU_SQL}) WHERE topic = 'view')"


def _split(spark, d):
    rows = imu(spark, d)
    return rows.filter("topic = 'click'").select("seq", "stamp_ns", "event_id"), rows.filter("topic = 'view'").select("seq", "stamp_ns", "a")


@query(f"WITH {_SPLIT} SELECT l.seq, l.stamp_ns, l.event_id, r.stamp_ns AS stamp_ns_right, r.a FROM l ASOF LEFT JOIN r ON l.seq = r.seq AND l.stamp_ns >= r.stamp_ns")
def asof_last_sample(spark, d):
    return timejoin.asof_join(*_split(spark, d), ["seq"], "stamp_ns", ["a"], bucket=DAY)


@query(f"""WITH {_SPLIT}, b AS (SELECT l.*, r.stamp_ns AS t0, r.a AS a0 FROM l ASOF LEFT JOIN r ON l.seq = r.seq AND l.stamp_ns >= r.stamp_ns),
  f AS (SELECT b.*, r.stamp_ns AS t1, r.a AS a1 FROM b ASOF LEFT JOIN r ON b.seq = r.seq AND b.stamp_ns <= r.stamp_ns)
  SELECT seq, stamp_ns, event_id, round(a0 + CASE WHEN t1 > t0 THEN (stamp_ns - t0) / (t1 - t0) ELSE 0.0 END * (a1 - a0), 6) + 0.0 AS a FROM f""")
def asof_interp(spark, d):
    return _rounded(timejoin.asof_interpolate(*_split(spark, d), ["seq"], "stamp_ns", ["a"], bucket=DAY), "a")


@query(f"""WITH {_SPLIT}, c AS (SELECT l.*, r.stamp_ns AS stamp_ns_right, r.a FROM l JOIN r ON l.seq = r.seq AND abs(l.stamp_ns - r.stamp_ns) <= {4 * HOUR})
  SELECT seq, stamp_ns, event_id, stamp_ns_right, a FROM c QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(stamp_ns - stamp_ns_right), stamp_ns_right) = 1""")
def nearest_time_assoc(spark, d):
    return timejoin.nearest_time(*_split(spark, d), ["seq"], "stamp_ns", ["a"], 4 * HOUR, bucket=DAY)


_SPANS = f"w AS (SELECT seq, event_id, stamp_ns AS t0, stamp_ns + {12 * HOUR} AS t1 FROM ({IMU_SQL}) WHERE event_id % 20 = 0), r AS (SELECT seq, stamp_ns, a FROM ({IMU_SQL}))"


def _spans(spark, d):
    rows = imu(spark, d)
    return rows.filter("event_id % 20 = 0").select("seq", "event_id", F.col("stamp_ns").alias("t0"), (F.col("stamp_ns") + 12 * HOUR).alias("t1")), rows.select("seq", "stamp_ns", "a")


@query(f"WITH {_SPANS} SELECT w.*, r.stamp_ns, r.a FROM w JOIN r ON w.seq = r.seq AND r.stamp_ns > t0 AND r.stamp_ns < t1")
def interval_join(spark, d):
    return timejoin.interval_join(*_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns", bucket=DAY)


@query(f"""WITH {_SPANS}, c AS (SELECT w.* FROM w JOIN (SELECT seq, min(stamp_ns) AS lo, max(stamp_ns) AS hi FROM r GROUP BY seq) USING (seq) WHERE lo <= t0 AND hi >= t1),
  e AS (SELECT *, t0 AS stamp_ns FROM c UNION ALL SELECT *, t1 FROM c),
  b AS (SELECT e.*, r.stamp_ns AS ta, r.a AS a0 FROM e ASOF JOIN r ON e.seq = r.seq AND e.stamp_ns >= r.stamp_ns),
  f AS (SELECT b.*, r.stamp_ns AS tb, r.a AS a1 FROM b ASOF JOIN r ON b.seq = r.seq AND b.stamp_ns <= r.stamp_ns)
  SELECT seq, event_id, t0, t1, stamp_ns, round(a0 + CASE WHEN tb > ta THEN (stamp_ns - ta) / (tb - ta) ELSE 0.0 END * (a1 - a0), 6) + 0.0 AS a FROM f
  UNION ALL SELECT c.*, r.stamp_ns, round(r.a, 6) + 0.0 FROM c JOIN r ON c.seq = r.seq AND r.stamp_ns > t0 AND r.stamp_ns < t1""")
def interval_slice(spark, d):
    return _rounded(timejoin.interval_slice(*_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns", ["a"], bucket=DAY), "a")


@query(f"""WITH {_SPANS} SELECT w.*, coalesce(lo <= t0 AND hi >= t1, false) AS covered FROM w LEFT JOIN (SELECT seq, min(stamp_ns) AS lo, max(stamp_ns) AS hi FROM r GROUP BY seq) USING (seq)""")
def coverage(spark, d):
    return timejoin.covered(*_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns")


# The same three with an interval for every event: the queries above and their SQL take one event in twenty.


def _every_span(sql: str) -> str:
    return sql.replace(" WHERE event_id % 20 = 0", "")


def _all_spans(spark, d):
    rows = imu(spark, d)
    return rows.select("seq", "event_id", F.col("stamp_ns").alias("t0"), (F.col("stamp_ns") + 12 * HOUR).alias("t1")), rows.select("seq", "stamp_ns", "a")


@query(_every_span(ORACLES["interval_join"]))
def interval_join_all(spark, d):
    return timejoin.interval_join(*_all_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns", bucket=DAY)


@query(_every_span(ORACLES["interval_slice"]))
def interval_slice_all(spark, d):
    return _rounded(timejoin.interval_slice(*_all_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns", ["a"], bucket=DAY), "a")


@query(_every_span(ORACLES["coverage"]))
def coverage_all(spark, d):
    return timejoin.covered(*_all_spans(spark, d), ["seq"], "t0", "t1", "stamp_ns")


@query(f"""SELECT seq, event_id, t_end FROM (SELECT *, max(t_end) OVER (PARTITION BY seq ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM (SELECT seq, event_id, stamp_ns + CAST(round(a) AS BIGINT) * {HOUR} AS t_end FROM ({IMU_SQL}))) WHERE prior IS NULL OR t_end > prior""")
def non_advancing_drop(spark, d):
    rows = imu(spark, d).select("seq", "event_id", (F.col("stamp_ns") + F.round("a").cast("long") * HOUR).alias("t_end"))
    return inertial.advancing(rows, ["seq"], "event_id", "t_end", bucket=1 << 16)


@query(f"""WITH i AS (SELECT seq, min(stamp_ns) + {2 * DAY} AS init_ns FROM ({IMU_SQL}) GROUP BY seq) SELECT seq, event_id, stamp_ns - 100000000 AS stamp_ns FROM ({IMU_SQL}) JOIN i USING (seq)
  WHERE stamp_ns - 100000000 > init_ns""")
def pre_init_drop(spark, d):
    rows = imu(spark, d)
    starts = rows.groupBy("seq").agg((F.min("stamp_ns") + 2 * DAY).alias("init_ns"))
    return inertial.after_start(inertial.shift_clock(rows.select("seq", "event_id", "stamp_ns"), -100_000_000), starts, ["seq"])


@query(f"SELECT topic, count(*) AS n, min(stamp_ns) AS first_ns FROM ({IMU_SQL}) WHERE topic IN ('click', 'purchase') GROUP BY topic")
def topic_filter(spark, d):
    return inertial.topics(imu(spark, d), ["click", "purchase"]).groupBy("topic").agg(F.count("*").alias("n"), F.min("stamp_ns").alias("first_ns"))


@query(f"SELECT 'imu' AS stream, event_id, stamp_ns FROM ({IMU_SQL}) WHERE topic = 'click' UNION ALL SELECT 'scan', event_id, stamp_ns FROM ({IMU_SQL}) WHERE topic = 'view'")
def topic_multiplex(spark, d):
    rows = imu(spark, d)
    return inertial.multiplex({"imu": rows.filter("topic = 'click'"), "scan": rows.filter("topic = 'view'")}, ["event_id", "stamp_ns"])


@query(f"SELECT event_id, seq FROM ({IMU_SQL}) WHERE event_id % 100 = 0")
def every_nth(spark, d):
    return inertial.every_nth(imu(spark, d).select("event_id", "seq"), "event_id", 100)


@query(f"SELECT event_id, stamp_ns // 1000000000 AS secs, stamp_ns % 1000000000 AS nsecs, (stamp_ns // 1000000000) * 1000000000 + stamp_ns % 1000000000 AS stamp_ns FROM ({IMU_SQL})")
def stamp_parts(spark, d):
    s = F.col("stamp_ns")
    return imu(spark, d).select("event_id", c.seconds(s).alias("secs"), c.remainder_nanos(s).alias("nsecs"), c.nanos(c.seconds(s), c.remainder_nanos(s)).alias("stamp_ns"))


# --- evaluation ------------------------------------------------------------------------------------------------


@query(f"""SELECT seq, count(*) AS scans, CAST(sum(CASE WHEN a > 50 THEN 1 ELSE 0 END) AS BIGINT) AS converged, CAST(sum(event_id % 5) AS BIGINT) AS iterations,
  round(100 * avg(CASE WHEN a > 50 THEN 1.0 ELSE 0.0 END), 6) AS converged_percent, round(avg(event_id % 5), 6) AS mean_iterations FROM ({IMU_SQL}) GROUP BY seq""")
def run_summary(spark, d):
    rows = imu(spark, d).select("seq", (F.col("a") > 50).alias("converged"), (F.col("event_id") % 5).alias("iterations"))
    return _rounded(evaluation.run_summary(rows, ["seq"]), "converged_percent", "mean_iterations")


_PAIRED_SQL = f"""SELECT vec_id, label, x AS ex, y AS ey, z AS ez, 0.8 * x + 0.6 * z + 0.01 * (vec_id % 7) AS tx, y + 0.5 AS ty, -0.6 * x + 0.8 * z - 0.01 * (vec_id % 5) AS tz FROM ({CLOUD_SQL})"""


def _paired(spark, d):
    x, y, z = c.vector(*spatial.XYZ)
    true = (0.8 * x + 0.6 * z + 0.01 * (F.col("vec_id") % 7), y + 0.5, -0.6 * x + 0.8 * z - 0.01 * (F.col("vec_id") % 5))
    return cloud(spark, d).select("vec_id", "label", x.alias("ex"), y.alias("ey"), z.alias("ez"), *(t.alias(n) for t, n in zip(true, evaluation.TRUE, strict=True)))


@query(f"SELECT label, round(sqrt(avg((ex - tx) * (ex - tx) + (ey - ty) * (ey - ty) + (ez - tz) * (ez - tz))), 6) AS ate_rmse, count(*) AS n FROM ({_PAIRED_SQL}) GROUP BY label")
def ate_rmse(spark, d):
    return _rounded(evaluation.ate(_paired(spark, d), ["label"]), "ate_rmse")


@query(
    "SELECT count(*) AS n, "
    + ", ".join(f"round(avg({a}), 6) + 0.0 AS mean_{a}" for a in (*evaluation.EST, *evaluation.TRUE))
    + ", "
    + ", ".join(f"round(covar_pop({t}, {e}), 6) + 0.0 AS c_{t}_{e}" for t in evaluation.TRUE for e in evaluation.EST)
    + f" FROM ({_PAIRED_SQL})"
)
def umeyama_moments(spark, d):
    out = evaluation.alignment_moments(_paired(spark, d))
    return _rounded(out, *(n for n in out.columns if n != "n"))


@query()
def aligned_ate(spark, d):
    return _rounded(evaluation.aligned_ate(_paired(spark, d)), "ate_rmse")


@query(f"""SELECT vec_id, round(degrees(acos(least(greatest((1 - x * x - y * y + z * z) / (1 + x * x + y * y + z * z), -1.0), 1.0))), 5) AS tilt,
  round(degrees(2 * atan2(sqrt(x * x + y * y + z * z), 1.0)), 5) AS turn FROM ({CLOUD_SQL})""")
def tilt_and_turn(spark, d):
    q = c.quat_normalise([F.lit(1.0), *c.vector(*spatial.XYZ)])
    turn = evaluation.rotation_angle_degrees(c.literal((1, 0, 0, 0)), q)
    return cloud(spark, d).select("vec_id", F.round(evaluation.tilt_degrees(q), 5).alias("tilt"), F.round(turn, 5).alias("turn"))


@query(f"""SELECT vec_id, printf('%.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f', CAST(vec_id AS DOUBLE), x, y, z, 0.0, 0.0, 0.0, 1.0) AS line FROM ({CLOUD_SQL})""")
def tum_format(spark, d):
    from tessera.sources import tum

    rows = cloud(spark, d).select("vec_id", (F.col("vec_id") * F.lit(1_000_000_000)).alias("t_ns"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return tum.lines(rows.withColumns({"qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)}), keep=("vec_id",))


# --- sequential operators over synthetic scenes (no SQL twin) ------------------------------------------------------


_MESSAGE_SQL = f"SELECT event_id, stamp_ns, a, a * 0.5 AS b, a + event_id AS c FROM ({IMU_SQL})"


def _message_rows(spark, d):
    return imu(spark, d).select("event_id", "stamp_ns", "a", (F.col("a") * 0.5).alias("b"), (F.col("a") + F.col("event_id")).alias("c"))


@query(f"SELECT event_id, stamp_ns, 1.0 AS qw, 0.0 AS qx, 0.0 AS qy, 0.0 AS qz, a AS wx, b AS wy, c AS wz, b AS ax, c AS ay, a AS az FROM ({_MESSAGE_SQL})")
def imu_decode(spark, d):
    """Every event as a serialised Imu message and back."""
    from tessera.plans import messages
    from tessera.sources import decoders

    named = {"wx": "a", "wy": "b", "wz": "c", "ax": "b", "ay": "c", "az": "a"}
    rows = _message_rows(spark, d).select("event_id", "stamp_ns", F.lit(1.0).alias("qw"), *(F.lit(0.0).alias(q) for q in ("qx", "qy", "qz")), *(F.col(v).alias(k) for k, v in named.items()))
    return decoders.imu_rows(messages.imu_messages(rows, "event_id"), ["event_id"])


@query(f"SELECT event_id, stamp_ns, a AS px, b AS py, c AS pz, 0.5 AS qw, b AS qx, c AS qy, a AS qz FROM ({_MESSAGE_SQL})")
def pose_decode(spark, d):
    """Every event as a serialised PoseStamped message and back."""
    from tessera.plans import messages
    from tessera.sources import decoders

    named = {"px": "a", "py": "b", "pz": "c", "qx": "b", "qy": "c", "qz": "a"}
    rows = _message_rows(spark, d).select("event_id", "stamp_ns", F.lit(0.5).alias("qw"), *(F.col(v).alias(k) for k, v in named.items()))
    return decoders.pose_rows(messages.pose_messages(rows, "event_id"), ["event_id"])


@query("""SELECT l_orderkey, l_orderkey * 1000000007 AS stamp_ns, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pt_idx,
  CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS x, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS y, CAST(CAST(l_tax AS FLOAT) AS DOUBLE) AS z,
  CAST(l_suppkey % 900 AS DOUBLE) AS intensity, l_linenumber AS ring, l_partkey AS t_offset_ns FROM lineitem""")
def cloud_decode(spark, d):
    """Every order as a serialised point cloud of its lines and back."""
    from tessera.plans import messages
    from tessera.sources import decoders

    point = {"x": F.col("l_quantity").cast("float"), "y": F.col("l_discount").cast("float"), "z": F.col("l_tax").cast("float"), "reflectivity": F.col("l_suppkey") % 900, "ring": F.col("l_linenumber"), "t": F.col("l_partkey")}
    ordered = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(*(v.alias(k) for k, v in point.items())).alias("p"))
    scans = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ordered)).alias("o"))  # a few lines an order
    scans = scans.select("l_orderkey", (F.col("l_orderkey") * 1_000_000_007).alias("stamp_ns"), F.col("o.p").alias("points"))
    rows = decoders.point_rows(messages.cloud_messages(scans, "l_orderkey"), decoders.decode_cloud, ["l_orderkey"])
    return rows.select("l_orderkey", "stamp_ns", "pt_idx", *(F.col(a).cast("double").alias(a) for a in ("x", "y", "z", "intensity")), "ring", "t_offset_ns")


@query(f"SELECT vec_id, round(x, 9) + 0.0 AS px, round(y, 9) + 0.0 AS py, round(z, 9) + 0.0 AS pz FROM ({CLOUD_SQL})")
def tum_round_trip(spark, d):
    """Every point as a pose in a trajectory file, in time order, and back."""
    from uuid import uuid4

    from tessera.sources import tum

    path = f"{shared_dir(spark)}/trajectory-{uuid4().hex}.tum"
    level = {"qw": 1.0, "qx": 0.0, "qy": 0.0, "qz": 0.0}
    poses = cloud(spark, d).select((F.col("vec_id") * c.NANOS).alias("t_ns"), *(F.col(a).alias(f"p{a}") for a in spatial.XYZ), *(F.lit(v).alias(k) for k, v in level.items()))
    tum.write(poses, path)
    return tum.read(spark, path).select(F.col("t_sec").cast("long").alias("vec_id"), *((F.col(f"t{a}") + 0.0).alias(f"p{a}") for a in spatial.XYZ))


@query(f"""WITH p AS ({_PAIRED_SQL})
  SELECT round(sqrt(avg(pow(sqrt(pow(b.ex - a.ex, 2) + pow(b.ey - a.ey, 2) + pow(b.ez - a.ez, 2)) - sqrt(pow(b.tx - a.tx, 2) + pow(b.ty - a.ty, 2) + pow(b.tz - a.tz, 2)), 2))), 6) AS rpe_rmse,
  count(*) AS n FROM p AS a JOIN p AS b ON b.vec_id = a.vec_id + 10""")
def rpe_rmse(spark, d):
    pairs = _paired(spark, d).withColumn("t_ns", F.col("vec_id") * c.NANOS)
    return _rounded(evaluation.relative_errors(pairs, [], "t_ns", 10 * c.NANOS, 0), "rpe_rmse")


@query(f"""WITH s AS (SELECT seq, stamp_ns, event_id, a / 1000 AS h FROM ({IMU_SQL})),
  n AS (SELECT *, lead(stamp_ns) OVER w AS t1, lead(h) OVER w AS h1 FROM s WINDOW w AS (PARTITION BY seq ORDER BY stamp_ns, event_id)),
  m AS (SELECT *, h + 0.25 * (h1 - h) AS g FROM n WHERE t1 IS NOT NULL AND (t1 - stamp_ns) % 4 = 0 AND t1 > stamp_ns)
  SELECT event_id, round(cos(g), 6) + 0.0 AS qw, round(sin(g), 6) + 0.0 AS qz FROM m""")
def asof_slerp(spark, d):
    """Rotations about one axis, interpolated at a quarter of the way between an event and its sequence's next."""
    rows = imu(spark, d).select("seq", "stamp_ns", "event_id", (F.col("a") / 1000).alias("h"))
    w = W.partitionBy("seq").orderBy("stamp_ns", "event_id")
    quarter = rows.withColumn("t1", F.lead("stamp_ns").over(w)).filter("t1 > stamp_ns and (t1 - stamp_ns) % 4 = 0")
    quarter = quarter.select("seq", "event_id", (F.col("stamp_ns") + F.floor((F.col("t1") - F.col("stamp_ns")) / 4)).cast("long").alias("t_ns"))
    zero = F.lit(0.0)
    turns = rows.select("seq", F.col("stamp_ns").alias("t_ns"), F.cos("h").alias("qw"), zero.alias("qx"), zero.alias("qy"), F.sin("h").alias("qz"))
    found = timejoin.asof_interpolate(quarter, turns, ["seq"], "t_ns", [], quaternion=("qw", "qx", "qy", "qz"))
    return _rounded(found.select("event_id", "qw", "qz"), "qw", "qz")


def _still_run(spark):
    from tessera.params import Init, Params, Preprocess
    from tessera.plans import scenes
    from tessera.streaming.replay import replay, sensor_rows

    rows = sensor_rows(scenes.still_samples(spark, 2, 2.2), scenes.room_scans(spark, 2, 8))
    return replay(rows, Params(lidar_time_offset_sec=0.0, preprocess=Preprocess(0.25), init=Init(gravity_magnitude=9.81)))


@query("SELECT * FROM (VALUES ('s0', 4, 4, 0), ('s0', 8, 8, 0), ('s1', 4, 4, 0), ('s1', 8, 8, 0)) AS t(seq, scan_index, converged_scans, dropped_scans)")
def replay_progress(spark, d):
    """Counters of a run at rest, independent of the tables."""
    return evaluation.progress(_still_run(spark), 4).select("seq", "scan_index", "converged_scans", "dropped_scans")


@query("SELECT * FROM (VALUES ('s0', 0.0, 0.0, 0.0, 0.0, -9.81), ('s1', 0.0, 0.0, 0.0, 0.0, -9.81)) AS t(seq, drift_degrees, drift_m, gyro_bias, speed, gravity_z)")
def replay_state(spark, d):
    """What a run at rest must leave: no drift of a pinned extrinsic, no bias, no speed, gravity straight down."""
    run = _still_run(spark)
    drift = evaluation.extrinsic_drift(run, (0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0))
    state = run.groupBy("seq").agg(F.max_by(F.struct("gyro_bias", "vx", "vy", "vz", "gravity"), "scan_index").alias("s"))
    size = c.norm([F.col("s.gyro_bias")[i] for i in range(3)])
    state = state.select("seq", size.alias("gyro_bias"), c.norm(c.vector("s.vx", "s.vy", "s.vz")).alias("speed"), F.col("s.gravity")[2].alias("gravity_z"))
    return _rounded(drift.join(state, "seq"), "drift_degrees", "drift_m", "gyro_bias", "speed", "gravity_z", digits=3)


@query()
def ekf_replay(spark, d):
    """The whole filter over two sequences of a room at rest; independent of the tables."""
    return _rounded(_still_run(spark), "px", "py", "pz", "qw", "qx", "qy", "qz", "vx", "vy", "vz")


@query()
def propagate_rest(spark, d):
    from tessera.plans import scenes

    return _rounded(inertial.propagate(scenes.still_samples(spark, 3, 1.0), "seq"), "px", "py", "pz", "vx", "vy", "vz")


@query()
def deskew_scan(spark, d):
    """A room scan from a body that moves along x at 1 m/s, brought to the scan's end."""
    from tessera.plans import scenes

    poses = scenes.still_samples(spark, 1, 2.0).select("seq", F.col("stamp_ns").alias("t_ns"), (F.col("stamp_ns") * 1e-9).alias("px"), *(F.lit(v).alias(n) for n, v in (("py", 0.0), ("pz", 0.0), ("qw", 1.0), ("qx", 0.0), ("qy", 0.0), ("qz", 0.0))))
    out = inertial.deskew(scenes.room_scans(spark, 1, 1), poses, ["seq"], ["scan_id"])
    return _rounded(out.select("pt_idx", "dx", "dy", "dz"), "dx", "dy", "dz")


def _as_sql(name: str, expression: str) -> None:
    ORACLES[name] = expression


_as_sql(
    "propagate_rest",
    """SELECT 's' || CAST(s AS VARCHAR) AS seq, k * 5000000 AS stamp_ns, 0.0 AS px, 0.0 AS py, 0.0 AS pz, 1.0 AS qw, 0.0 AS qx, 0.0 AS qy, 0.0 AS qz, 0.0 AS vx, 0.0 AS vy, 0.0 AS vz
    FROM range(3) a(s), range(200) b(k)""",
)
_as_sql(
    "deskew_scan",
    """WITH p AS (SELECT CAST(k AS INT) AS pt_idx, k // 81 AS face, k % 9 - 4.0 AS a, (k % 81) // 9 - 4.0 AS b, (k * 99000000) // 486 AS o FROM range(486) r(k)),
    q AS (SELECT *, CASE WHEN face % 2 = 0 THEN -5.0 ELSE 5.0 END AS far, max(o) OVER () - o AS late FROM p)
    SELECT pt_idx, round(CASE WHEN face // 2 = 0 THEN far ELSE a END - late * 1e-9, 6) + 0.0 AS dx,
    CASE WHEN face // 2 = 1 THEN far WHEN face // 2 = 0 THEN a ELSE b END + 0.0 AS dy, CASE WHEN face // 2 = 2 THEN far ELSE b END + 0.0 AS dz FROM q""",
)
