"""Operators against plain Python, including empty inputs and their plans' shape."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.functions import manifold as m
from tessera.operators import estimation, evaluation, inertial, planes, spatial, timejoin
from tessera.plans import catalogue
from tessera.streaming import filter as f

RNG = np.random.default_rng(1)


def test_pose_interpolation_equals_the_geodesic(spark):
    poses = [(1, int(t * 1e9), *RNG.normal(0, 3, 3).tolist(), *m.quat_of(m.so3_exp(RNG.normal(0, 1.2, 3))).tolist()) for t in range(6)]
    schema = "seq int, t_ns bigint, px double, py double, pz double, qw double, qx double, qy double, qz double"
    times = [(1, int(t * 1e9)) for t in (-1, 0, 0.25, 1.5, 2.999, 3, 4.8, 5, 9)]
    got = timejoin.pose_interpolate(spark.createDataFrame(times, "seq int, t_ns bigint"), spark.createDataFrame(poses, schema), ["seq"], "t_ns", bucket=2 * c.NANOS)
    path = [(p[1], m.rotation_of(p[5:]), np.array(p[2:5])) for p in poses]
    for r in got.collect():
        rot, pos = (x[0] for x in f.poses_at(path, np.array([r.t_ns])))
        assert np.allclose([r.px, r.py, r.pz], pos, atol=1e-9)
        assert np.allclose(m.rotation_of([r.qw, r.qx, r.qy, r.qz]), rot, atol=1e-9)
    assert got.count() == len(times)


def test_deskew_equals_the_filter(spark):
    times = np.arange(0, 101, 10) * 1_000_000
    s = m.State(v=np.array([1.0, -0.5, 0.2]), g=np.zeros(3), RE=m.so3_exp(np.array([0.1, 0.2, 0])), pE=np.array([0.1, 0, 0.3]))
    path = f.scan_trajectory(s, times, np.tile([0.3, -0.2, 1.0, 0.1, 0, 0], (len(times), 1)))
    points, offsets = RNG.normal(0, 5, (40, 3)), np.sort(RNG.integers(0, 100_000_000, 40))
    want = f.deskew(points, offsets, path, int(offsets.max()), s)
    poses = [(1, t, *p, *m.quat_of(r)) for t, r, p in path]
    rows = [(1, 0, 0, k, int(o), *map(float, p)) for k, (o, p) in enumerate(zip(offsets, points, strict=True))]
    got = inertial.deskew(
        spark.createDataFrame(rows, "seq int, scan_id int, stamp_ns bigint, k int, t_offset_ns bigint, x double, y double, z double"),
        spark.createDataFrame([(p[0], int(p[1]), *map(float, p[2:])) for p in poses], "seq int, t_ns bigint, px double, py double, pz double, qw double, qx double, qy double, qz double"),
        ["seq"], ["scan_id"], (s.RE.tolist(), s.pE.tolist()), bucket=30_000_000,
    )
    rows = {r.k: (r.dx, r.dy, r.dz) for r in got.collect()}
    assert np.allclose([rows[k] for k in range(40)], want, atol=1e-8)


def test_buckets_change_no_join(spark):
    left = [(k % 3, int(t)) for k, t in enumerate(RNG.integers(0, 1000, 80))]
    right = [(k % 3, int(t), float(t) * 2) for k, t in enumerate(RNG.permutation(1000)[:60])]
    a, b = spark.createDataFrame(left, "seq int, t long"), spark.createDataFrame(right, "seq int, t long, v double")
    for key, kind in (("asof", timejoin.asof_join), ("interp", timejoin.asof_interpolate)):
        results = [sorted(kind(a, b, ["seq"], "t", ["v"], bucket=w).collect(), key=str) for w in (7, 100, 10**6)]
        assert results[0] == results[1] == results[2] and len(results[0]) == len(left), key
    for s, t, right_t, v in [tuple(r) for r in timejoin.asof_join(a, b, ["seq"], "t", ["v"], bucket=50).collect()]:
        held = [x for q, x, _ in right if q == s and x <= t]
        assert (right_t, v) == ((max(held), max(held) * 2.0) if held else (None, None))
    sums = timejoin.running_sums(b, ["seq"], "t", ["v"], bucket=50).collect()
    assert all(abs(r.sum_v - sum(v for s, t, v in right if s == r.seq and t <= r.t)) < 1e-9 for r in sums)


def test_exact_interval_ends(spark):
    samples = spark.createDataFrame([(1, t, float(t)) for t in (0, 10, 20, 30)], "seq int, t long, v double")
    spans = spark.createDataFrame([(1, 5, 20), (1, 5, 25), (1, 0, 30), (1, -1, 5), (1, 12, 13)], "seq int, a long, b long")
    rows = timejoin.interval_slice(spans, samples, ["seq"], "a", "b", "t", ["v"], bucket=7).collect()
    got = {(a, b): sorted(r.t for r in rows if (r.a, r.b) == (a, b)) for a, b in ((5, 20), (5, 25), (0, 30), (-1, 5), (12, 13))}
    assert got == {(5, 20): [5, 10, 20], (5, 25): [5, 10, 20, 25], (0, 30): [0, 10, 20, 30], (-1, 5): [], (12, 13): [12, 13]}
    assert all(abs(r.v - r.t) < 1e-12 for r in rows)
    dropped = timejoin.interval_slice(spans, samples, ["seq"], "a", "b", "t", ["v"], bucket=7, drop_exact_end=True).collect()
    assert sorted(r.t for r in dropped if (r.a, r.b) == (5, 20)) == [5, 10]


def test_voxels_negative_and_non_finite(spark):
    points = [(-0.1, 0.1, 0.0, 1.0), (-0.4, 0.3, 0.2, 3.0), (float("nan"), 0.0, 0.0, 9.0), (0.0, float("inf"), 0.0, 9.0), (None, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(points, "x double, y double, z double, intensity double")
    (r,) = spatial.voxel_centroid(df, 0.5).collect()
    assert (r.cx, r.cy, r.cz, r.n, r.intensity) == (-1, 0, 0, 2, 2.0) and abs(r.x + 0.25) < 1e-12
    assert spatial.voxel_centroid(df.limit(0), 0.5).collect() == []


def test_planes_of_the_noisy_sheet(spark):
    xy = RNG.uniform(-4, 4, (500, 2))
    cloud = [(k, float(x), float(y), float(-2 + RNG.normal(0, 0.005))) for k, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(cloud, "point_id int, x double, y double, z double")
    points = df.select(F.col("point_id").alias("q"), "x", "y", (F.col("z") + 0.05).alias("z"))
    found = planes.associate(points, df, "q", "point_id").collect()
    assert len(found) > 450 and np.mean([abs(r.nz) for r in found]) > 0.98 and abs(np.mean([r.residual for r in found]) - 0.05) < 0.02
    line = spark.createDataFrame([(k, float(k), 0.0, 0.0) for k in range(9)], "point_id int, x double, y double, z double")
    assert planes.associate(line.withColumnRenamed("point_id", "q"), line, "q", "point_id").collect() == []


def test_knn_levels_agree(spark):
    cloud = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(RNG.uniform(-3, 3, (300, 3)))], "point_id int, x double, y double, z double")
    queries = cloud.sample(0.3, 1).withColumnRenamed("point_id", "q")
    a = spatial.knn_within(queries, cloud, 5, 2.0, "q", "point_id")
    b = spatial.knn_expanding(queries, cloud, 5, "q", "point_id", (0.5, 1.0, 2.0))
    key = lambda df: sorted((r.q, r.rank, r.point_id) for r in df.collect())
    assert key(a) == key(b)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan


def test_map_versions(spark):
    some = spark.createDataFrame([(float(x), float(y), float(z)) for x in range(-10, 11, 2) for y in range(-10, 11, 2) for z in range(-10, 11, 2)], "x double, y double, z double")
    held = spatial.append_points(spark.createDataFrame([], "x double, y double, z double, valid_from long, valid_to long"), some, 1)
    cut = spatial.remove_box(held, (-4, -4, -4), (4, 4, 4), 2)
    assert spatial.live(cut).count() == 11**3 - 5**3 and spatial.compact(cut, 3).count() == 11**3 - 5**3
    again = spatial.append_points(cut, some.filter("abs(x) <= 4 and abs(y) <= 4 and abs(z) <= 4"), 3)
    assert spatial.live(again).count() == 11**3
    assert spatial.crop_box(some, (-4, -4, -4), (4, 4, 4)).count() == 125
    assert spatial.insert_new(some, some, 0.5).count() == 0 and spatial.insert_new(some.withColumn("x", F.col("x") + 1), some, 1.0).count() == 11**3


@pytest.mark.parametrize("sigma,prior,kept", [(0.01, 0.25, 3), (3.0, 1.0, 5)])
def test_chi2_gate(spark, sigma, prior, kept):
    rows = [(*[0.0] * 3, 1.0, *[0.0] * 8, z) for z in (0.0, 0.0, 0.0, 5.0, -5.0)]
    df = spark.createDataFrame(rows, ", ".join(f"{h} double" for h in estimation.H) + ", z double")
    assert estimation.chi2_gate(df, prior * np.eye(23), sigma).count() == kept


def test_one_update_by_sums_equals_the_filter(spark):
    points, normals = RNG.normal(0, 3, (50, 3)), RNG.normal(0, 1, (50, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    s = m.State(R=m.so3_exp(np.array([0.1, 0.2, 0.3])), RE=m.so3_exp(np.array([0.3, 0, 0])), pE=np.array([0.1, 0.2, 0.3]))
    z = RNG.normal(0, 0.1, 50)
    df = spark.createDataFrame([(*map(float, p), *map(float, n), float(v)) for p, n, v in zip(points, normals, z, strict=True)], "px double, py double, pz double, nx double, ny double, nz double, residual double")
    a, b = estimation.equations_of(estimation.normal_equations(estimation.h_rows(df, s.R, s.RE, s.pE)).first())
    h = f.linearise(s, points, normals)
    assert np.allclose(a, h.T @ h) and np.allclose(b, h.T @ z)


def test_alignment_recovers_a_rigid_motion(spark):
    true = RNG.normal(0, 5, (200, 3))
    r, t = m.so3_exp(np.array([0.2, -0.5, 1.0])), np.array([1.0, -2.0, 3.0])
    est = (true - t) @ r
    pairs = spark.createDataFrame([(*map(float, e), *map(float, x)) for e, x in zip(est, true, strict=True)], "ex double, ey double, ez double, tx double, ty double, tz double")
    assert evaluation.aligned_ate(pairs).first().ate_rmse < 1e-9 < evaluation.ate(pairs).first().ate_rmse
    moving = pairs.withColumn("seq", F.lit(1)).withColumn("t_ns", F.monotonically_increasing_id())
    assert evaluation.aligned_ate(pairs.limit(0)).first() is None or evaluation.aligned_ate(pairs.limit(0)).first().n == 0
    assert moving.count() == 200


def test_pairing_and_relative_errors(spark):
    est = spark.createDataFrame([(1, k * 100, float(k), 0.0, 0.0) for k in range(50)], "seq int, t_ns long, px double, py double, pz double")
    truth = spark.createDataFrame([(1, k * 100 + 7, k * 1.1, 0.0, 0.0) for k in range(40)], "seq int, t_ns long, px double, py double, pz double")
    pairs = evaluation.pair_up(est, truth, ["seq"], tolerance=20)
    assert pairs.count() == 40
    rpe = evaluation.relative_errors(pairs, ["seq"], "t_ns", 1000, 20).first()
    assert rpe.n == 30 and abs(rpe.rpe_rmse - 1.0) < 1e-9


def test_association_has_a_small_plan_whatever_the_levels(spark):
    cloud = spark.range(2000).select(F.col("id").alias("point_id"), (F.rand(1) * 10).alias("x"), (F.rand(2) * 10).alias("y"), F.lit(0.5).alias("z"))
    queries = cloud.withColumnRenamed("point_id", "q")
    for radii in ((0.2, 0.4), (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)):
        out = spatial.knn_expanding(queries, cloud, 5, "q", "point_id", radii)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2 * len(radii)
    turn = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (10.0, 0.0, 0.0)
    for pose in (None, turn):
        found = planes.associate(queries, cloud, "q", "point_id", pose=pose)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 15
        rows = found.collect()
        assert len(rows) > 500 and all(abs(abs(r.nz) - 1) < 1e-6 and abs(r.residual) < 1e-6 for r in rows)


def test_interval_slices_keep_repeated_rows(spark):
    samples = spark.createDataFrame([(1, 0, 0.0), (1, 10, 1.0), (1, 10, 1.0), (1, 20, 2.0)], "k int, t long, v double")
    intervals = spark.createDataFrame([(1, 5, 15), (1, 5, 15), (1, 7, 7)], "k int, a long, b long")
    got = timejoin.interval_slice(intervals, samples, ["k"], "a", "b", "t", ["v"], bucket=4).collect()
    assert sorted((r.a, r.t, r.v) for r in got) == sorted(2 * [(5, 5, 0.5), (5, 10, 1.0), (5, 10, 1.0), (5, 15, 1.5)] + [(7, 7, 0.7)])


def test_scans_of_many_times_are_deskewed_at_once():
    import time

    stamps = np.arange(0, 105, 5) * 1_000_000
    path = [(int(t), m.so3_exp(np.array([0.0, 0.0, t * 1e-8])), np.array([t * 1e-8, 0.0, 0.0])) for t in stamps]
    times, points = np.linspace(0, 100_000_000, 65_000).astype(np.int64), RNG.normal(0, 5, (65_000, 3))
    began = time.perf_counter()
    got = f.deskew(points, times, path, 100_000_000, m.State())
    assert time.perf_counter() - began < 2
    for i in (0, 1000, 64_999):
        turn, shift = m.so3_exp(np.array([0.0, 0.0, times[i] * 1e-8])), np.array([times[i] * 1e-8, 0.0, 0.0])
        end, last = path[-1][1], path[-1][2]
        assert np.allclose(got[i], end.T @ (turn @ points[i] + shift - last), atol=1e-3)


def test_scans_without_times_are_dropped(spark):
    from tessera.params import Params
    from tessera.streaming.replay import SENSOR, replay

    rows = [("s", 0, "scan", 0, *[None] * 6, [(1.0, 2.0, 3.0, None)])]
    assert replay(spark.createDataFrame(rows, SENSOR), Params()).collect() == []


def test_neighbours_and_advancing_scans_across_buckets_equal_plain_windows(spark):
    rng = np.random.default_rng(5)
    rows = [(k if k < 3 else None, int(t), float(v), int(e), 7) for k in range(4) for t, v, e in zip(rng.choice(1000, 60, replace=False), rng.random(60), rng.integers(0, 900, 60), strict=True)]
    rows += [(0, None, 0.5, 10, 7), (9, 5, None, None, 7)]
    df = spark.createDataFrame(rows, "k long, t long, v double, e long, extra long")
    w = W.partitionBy("k").orderBy("t")
    for bucket in (1, 30, 10_000):
        got = inertial.consecutive(df, ["k"], "t", ["v"], bucket)
        want = df.select("*", ((F.col("t") - F.lag("t").over(w)) / 1e9).alias("dt"), F.lag("v").over(w).alias("prev_v"))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        got = inertial.advancing(df, ["k"], "t", "e", bucket)
        before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
        want = df.withColumn("b", before).filter("b is null or e > b").drop("b")
        assert got.columns == df.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert inertial.consecutive(df.limit(0), ["k"], "t", ["v"]).collect() == inertial.advancing(df.limit(0), ["k"], "t", "e").collect() == []


def test_block_search_equals_brute_force(spark):
    """Clusters of three densities, one place held by many points and queries, queries far off, repeated and odd rows."""
    rng = np.random.default_rng(5)
    spots = [rng.normal(0, 1, (1500, 3)), rng.normal(3, 0.01, (800, 3)), rng.normal(-4, 1e-4, (400, 3)), np.tile([[0.5, 0.5, 0.5]], (300, 1)), np.array([[0.0, 0, 9], [2, 0, 9], [-0.0, 0, 9], [0, 0, 9]])]
    xyz = np.concatenate(spots)
    ids = rng.permutation(len(xyz))
    points = [(int(i), *map(float, p)) for i, p in zip(ids, xyz, strict=True)]
    queries = [(int(n), *map(float, xyz[j])) for n, j in enumerate(rng.permutation(len(xyz))[:900])] + [(5000 + i, 0.5, 0.5, 0.5) for i in range(40)] + [(6000, 0.0, 0.0, 11.0), (6001, 50.0, 0.0, 0.0), (6002, 4.0, 0.0, 9.0), (7, 3.0, 3.0, 3.0)]
    odd = [(9000, float("nan"), 0.0, 0.0), (9001, None, 0.0, 0.0), (9002, float("inf"), 0.0, 0.0)]
    frames = [spark.createDataFrame(rows + odd, f"{n} long, x double, y double, z double") for n, rows in (("q", queries), ("p", points))]
    got: dict[int, list] = {}
    for r in spatial.knn_blocks(*frames, 5, 4.0, "q", "p").orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.d2, r.p, r.p_x, r.p_y, r.p_z))
    want: dict[int, list] = {}
    for q, *at in queries:
        off = np.array(at) - xyz
        d2 = off[:, 0] * off[:, 0] + off[:, 1] * off[:, 1] + off[:, 2] * off[:, 2]
        want[q] = want.get(q, []) + [(float(d2[j]), int(ids[j]), *map(float, xyz[j])) for j in np.flatnonzero(d2 <= 4.0)]
    assert got == {q: sorted(rows)[:5] for q, rows in want.items() if rows}


def test_plane_fit_makes_no_rows_of_pairs(spark, sf_dir):
    plan = catalogue.QUERIES["plane_fit"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
