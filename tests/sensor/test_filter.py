"""Numerical oracles and synthetic scenes for the filter."""

import numpy as np
import pandas as pd
import pytest

from tessera.functions import manifold as m
from tessera.params import Association, Crop, Estimator, Iekf, ImuNoise, Init, Map, Params, Preprocess
from tessera.streaming import filter as f
from tessera.streaming import replay as rp

RNG = np.random.default_rng(0)


def random_state(rng):
    return m.State(m.so3_exp(rng.normal(0, 1, 3)), *(rng.normal(0, 1, 3) for _ in range(4)), np.array([0.3, -0.2, -9.8]), m.so3_exp(rng.normal(0, 1, 3)), rng.normal(0, 1, 3))


def room(step=1.0):
    g = np.arange(-4, 4.1, step)
    a, b = (x.ravel() for x in np.meshgrid(g, g))
    walls = [np.insert(np.column_stack([a, b]), axis, side, axis=1) for axis in range(3) for side in (-5.0, 5.0)]
    return np.concatenate(walls)


def test_manifold_round_trips():
    for _ in range(50):
        a, b, d = random_state(RNG), random_state(RNG), RNG.normal(0, 0.4, 23)
        assert np.allclose(a.plus(d).minus(a), d, atol=1e-9)
        back = b.plus(a.minus(b).copy()) if abs(np.linalg.norm(a.g) - np.linalg.norm(b.g)) < 1e-12 else a
        assert np.allclose(back.R, a.R, atol=1e-9)
        assert abs(np.linalg.norm(a.plus(d).g) - np.linalg.norm(a.g)) < 1e-9
        r = m.so3_exp(RNG.normal(0, 1.5, 3))
        assert np.allclose(m.rotation_of(m.quat_of(r)), r, atol=1e-9)
        rho, w = RNG.normal(0, 1, 3), RNG.normal(0, 0.8, 3)
        assert np.allclose(np.concatenate(m.se3_log(*m.se3_exp(rho, w))), np.concatenate([rho, w]), atol=1e-8)
        u, v = RNG.normal(0, 1, 3), RNG.normal(0, 1, 3)
        assert np.allclose(m.between(u, v) @ u / np.linalg.norm(u), v / np.linalg.norm(v), atol=1e-9)
    assert np.allclose(m.between(np.array([0, 0, 1.0]), np.array([0, 0, -1.0])) @ [0, 0, 1], [0, 0, -1])
    assert np.allclose(m.State.unpacked(a.packed()).RE, a.RE)


def test_measurement_rows_equal_central_differences():
    s = random_state(RNG)
    points, normals = RNG.normal(0, 3, (4, 3)), RNG.normal(0, 1, (4, 3))
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)

    def residual(x):
        r, p = x.lidar_pose()
        return ((points @ r.T + p) * normals).sum(1)

    h = f.linearise(s, points, normals)
    for k in range(23):
        d = np.zeros(23)
        d[k] = 1e-6
        assert np.allclose((residual(s.plus(d)) - residual(s.plus(-d))) / 2e-6, h[:, k], atol=1e-5)
    assert not h[:, 6:17].any()


def test_covariance_step_equals_numerical_jacobian():
    s, dt = random_state(RNG), 0.005
    m0, m1 = RNG.normal(0, 1, 6), RNG.normal(0, 1, 6)
    nominal, jac = f.propagate(s, m0, m1, dt), np.zeros((23, 23))
    for k in range(23):
        d = np.zeros(23)
        d[k] = 1e-6
        jac[:, k] = (f.propagate(s.plus(d), m0, m1, dt).minus(nominal) - f.propagate(s.plus(-d), m0, m1, dt).minus(nominal)) / 2e-6
    got = f.propagate_covariance(s, np.eye(23), m0, m1, dt, ImuNoise())
    assert np.abs(got - jac @ jac.T).max() < 5e-4
    noisy = f.propagate_covariance(s, np.zeros((23, 23)), m0, m1, dt, ImuNoise(1, 2, 3, 4))
    assert np.allclose(np.diag(noisy)[[0, 3, 6, 9, 12]], [dt, 0, 4 * dt, 9 * dt, 16 * dt])


def test_knn_equals_brute_force():
    for n in (1, 5, 50, 2000):
        cloud, queries = RNG.uniform(-5, 5, (n, 3)), RNG.uniform(-6, 6, (60, 3))
        for k in (1, 5, 10):
            found, d2 = f.GridMap(cloud).knn(queries, k, 2.0)
            for q, ids, ds in zip(queries, found, d2, strict=True):
                want = np.sort(((cloud - q) ** 2).sum(1))
                want = want[want <= 4.0][:k]
                assert np.allclose(ds[ids >= 0], want)


def test_map_insert_and_crop():
    sheet = np.array([(x, y, 0.0) for x in np.arange(0, 5, 0.5) for y in np.arange(0, 5, 0.5)])
    grid = f.GridMap()
    grid.insert(sheet, 0.5)
    n = len(grid)
    for shift, more in ((0.0, 0), (0.1, 0), (100.0, n)):
        grid.insert(sheet + [shift, 0, 0], 0.5)
        assert len(grid) == n + more
    grid.insert(sheet, None)
    assert len(grid) == 3 * n
    cube = f.LocalMap(Map(crop=Crop(sensor_range=50)), np.array([(x, 0.0, 0.0) for x in range(-120, 121)]))
    cube.recenter(np.zeros(3))
    cube.recenter(np.array([20.0, 0, 0]))
    assert cube.box[0, 0] == -100
    cube.recenter(np.array([30.0, 0, 0]))
    assert cube.box[0, 0] == -70 and cube.grid.points[:, 0].min() == -70


def test_update_converges_and_gates():
    normals = np.repeat(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [0, 1, 1]], float), 5, 0)
    normals /= np.linalg.norm(normals, axis=1, keepdims=True)
    truth, points = m.State(), RNG.uniform(-3, 3, (25, 3))
    d = (points * normals).sum(1)
    prior = np.diag([0.25] * 17 + [1e-10] * 6)
    start = truth.plus(np.concatenate([[0.05, -0.04, 0.03, 0.2, -0.1, 0.15], np.zeros(17)]))

    def rows(extra):
        def measure(x):
            r, p = x.lidar_pose()
            z = ((points @ r.T + p) * normals).sum(1) - d
            h = f.linearise(x, points, normals)
            if extra:
                h, z = np.vstack([h, h[:8]]), np.append(z, z[:8] + 10)
            return h, z

        return measure

    done = f.iterated_update(start, prior, rows(False), Iekf(sigma=0.01, max_iterations=10))
    assert done.converged and np.abs(done.state.minus(truth)[:6]).max() < 1e-3
    assert np.allclose(done.cov, done.cov.T) and np.linalg.eigvalsh(done.cov).min() > -1e-12 and np.trace(done.cov) < np.trace(prior)
    gated = f.iterated_update(start, prior, rows(True), Iekf(sigma=0.01, max_iterations=10))
    loose = f.iterated_update(start, prior, rows(True), Iekf(sigma=0.01, max_iterations=10, reject_outliers=False))
    assert np.abs(gated.state.minus(truth)[:6]).max() < 1e-3 < 0.05 < np.abs(loose.state.minus(truth)[:6]).max()
    none = f.iterated_update(start, prior, lambda x: (np.empty((0, 23)), np.empty(0)), Iekf())
    assert none.converged and none.iterations == 0 and none.state is start and none.cov is prior


def test_initialisation():
    level = f.initialise(np.zeros((200, 3)) + 0.01, np.tile([0, 0, 9.78], (200, 1)), Init())
    assert level.ok and np.allclose(level.state.R, np.eye(3)) and np.allclose(level.state.bg, 0.01)
    turn = m.so3_exp(np.array([np.radians(10), 0, 0]))
    tilted = f.initialise(np.zeros((200, 3)), np.tile(turn.T @ [0, 0, 9.78], (200, 1)), Init())
    assert np.allclose(tilted.state.R, turn, atol=1e-9)
    moving = f.initialise(np.zeros((200, 3)), np.tile([[1, 0, 9.78], [-1, 0, 9.78]], (100, 1)), Init())
    assert not moving.ok and not f.initialise(np.empty((0, 3)), np.empty((0, 3)), Init()).ok


def test_slices_and_deskew():
    b = f.ImuBuffer()
    for t in (0, 10, 20, 30):
        b.push(t, np.full(6, float(t)))
    assert b.slice(5, 20)[0].tolist() == [5, 10, 20] and b.slice(5, 20, True)[0].tolist() == [5, 10]
    assert b.slice(5, 25)[1][:, 0].tolist() == [5, 10, 20, 25]
    with pytest.raises(ValueError):
        b.slice(-1, 5)
    b.forget(20)
    assert b.stamps == [20, 30]
    times = np.arange(0, 101, 10) * 1_000_000
    for rate, speed in ((np.zeros(3), np.array([1.0, 2, 0])), (np.array([0, 0, 1.0]), np.zeros(3))):
        s = m.State(v=speed, g=np.zeros(3), RE=m.so3_exp(np.array([0.1, 0, 0])), pE=np.array([0.1, 0, 0]))
        path = f.scan_trajectory(s, times, np.tile([*rate, 0, 0, 0], (len(times), 1)))
        still = RNG.normal(0, 5, (len(times), 3))
        seen = []
        for t, w in zip(times, still, strict=True):
            r, p = m.so3_exp(rate * t * 1e-9), speed * t * 1e-9
            seen.append(s.RE.T @ (r.T @ (w - p) - s.pE))
        r, p = m.so3_exp(rate * 0.1), speed * 0.1
        want = ((still - p) @ r - s.pE) @ s.RE
        assert np.allclose(f.deskew(np.array(seen), times, path, int(times[-1]), s), want, atol=1e-6)


PARAMS = Params(
    lidar_time_offset_sec=0.0, preprocess=Preprocess(0.25), init=Init(imu_count=60, gravity_magnitude=9.81), imu_noise=ImuNoise(0.01, 0.01, 1e-4, 1e-4),
    iekf=Iekf(sigma=0.01), association=Association(), map=Map(voxel_leaf=0.1), estimator=Estimator(),
)


def sensor_table(seq="a", scans=20, velocity=0.0):
    """200 Hz samples at rest, then scans of the room whose points are spread over 0.1 s."""
    rows, points = [], room()
    offsets = np.linspace(0, 99_000_000, len(points)).astype(int)
    for k in range(61 + 20 * scans + 20):
        rows.append(dict(seq=seq, arrival=k * 5_000_000, kind="imu", stamp_ns=k * 5_000_000, wx=0.0, wy=0.0, wz=0.0, ax=0.0, ay=0.0, az=9.81, points=None))
    for k in range(-1, scans):
        stamp = 300_000_000 + k * 100_000_000 if k >= 0 else 100_000_000  # one before the start
        p = [dict(x=float(x), y=float(y), z=float(z), t_offset_ns=int(o)) for (x, y, z), o in zip(points, offsets, strict=True)]
        rows.append(dict(seq=seq, arrival=stamp + 99_000_000, kind="scan", stamp_ns=stamp, wx=None, wy=None, wz=None, ax=None, ay=None, az=None, points=p))
    return rows


def test_room_at_rest_batch(spark):
    rows = [r for s in ("a", "b") for r in sensor_table(s)]
    out = rp.replay(spark.createDataFrame(rows, rp.SENSOR), PARAMS).toPandas()
    assert set(out.groupby("seq").size()) == {20}
    assert out[["px", "py", "pz"]].abs().to_numpy().max() < 0.05 and (out.qw > 0.999).all() and (out.map_size > 100).all()


def test_batch_equals_stream(spark, tmp_path):
    rows = sensor_table("a", scans=6) + sensor_table("b", scans=6)
    table = spark.createDataFrame(rows, rp.SENSOR)
    want = rp.replay(table, PARAMS).toPandas()
    cuts = [0, 350_000_000, 520_000_000, 10**12]
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        table.filter(f"arrival >= {low} and arrival < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(rp.SENSOR).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = rp.stream(source, PARAMS).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    key = ["seq", "t_ns"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), atol=1e-12)
