"""The iterated error-state filter over one sequence: pure NumPy, shared by batch replay and streaming."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tessera.functions.manifold import ACCEL_BIAS, DIM, EXT_POS, EXT_ROT, GRAVITY, GYRO_BIAS, POS, THETA, VEL, State, between, se3_exp_many, se3_log, skew, so3_exp, tangent_basis
from tessera.operators.spatial import LEVELS
from tessera.params import Association, Iekf, ImuNoise, Init, Map, Params

#: Variance that holds the extrinsic where it is not estimated.
PINNED = 1e-12
#: Samples this long before the last scan and all pending ones stay, for scans that overlap it; what comes later still
#: and starts before them is counted as dropped.
OVERLAP_NS = 1_000_000_000


# --- inertial --------------------------------------------------------------------------------------------------


@dataclass
class Initial:
    ok: bool
    state: State | None = None
    cov: np.ndarray | None = None
    accel_norm: float = 0.0
    max_accel_var: float = 0.0
    max_gyro_var: float = 0.0


def initialise(gyro: np.ndarray, accel: np.ndarray, params: Init) -> Initial:
    """State and covariance from a window at rest; not ok if some axis varies too much or there are no samples."""
    if not len(gyro):
        return Initial(False)
    stats = float(np.linalg.norm(accel.mean(0))), float(accel.var(0).max()), float(gyro.var(0).max())
    if stats[1] > params.max_accel_var or stats[2] > params.max_gyro_var:
        return Initial(False, None, None, *stats)
    up = np.array([0.0, 0.0, 1.0])
    state = State(R=between(accel.mean(0), up), bg=gyro.mean(0), g=-params.gravity_magnitude * up)
    var = np.empty(DIM)
    for part, std in ((THETA, params.theta_std), (POS, params.pos_std), (VEL, params.vel_std), (GYRO_BIAS, params.bias_gyro_std), (ACCEL_BIAS, params.bias_accel_std), (GRAVITY, params.gravity_std), (EXT_ROT, params.ext_rot_std), (EXT_POS, params.ext_trans_std)):
        var[part] = std**2
    return Initial(True, state, np.diag(var), *stats)


def propagate(s: State, m0: np.ndarray, m1: np.ndarray, dt: float) -> State:
    """Midpoint step over one interval; m0, m1: angular velocity and acceleration at its ends."""
    w, a = 0.5 * (m0[:3] + m1[:3]) - s.bg, 0.5 * (m0[3:] + m1[3:]) - s.ba
    force = s.R @ so3_exp(0.5 * dt * w) @ a + s.g
    return s.with_(R=s.R @ so3_exp(dt * w), v=s.v + dt * force, p=s.p + dt * s.v + 0.5 * dt * dt * force)


def propagate_covariance(s: State, cov: np.ndarray, m0: np.ndarray, m1: np.ndarray, dt: float, noise: ImuNoise) -> np.ndarray:
    """First-order error propagation, linearised at the interval's start."""
    w, a = 0.5 * (m0[:3] + m1[:3]) - s.bg, 0.5 * (m0[3:] + m1[3:]) - s.ba
    f = np.eye(DIM)
    f[THETA, THETA] -= dt * skew(w)
    f[THETA, GYRO_BIAS] = -dt * np.eye(3)
    f[POS, VEL] = dt * np.eye(3)
    f[VEL, THETA] = -dt * s.R @ skew(a)
    f[VEL, ACCEL_BIAS] = -dt * s.R
    f[VEL, GRAVITY] = -dt * skew(s.g) @ tangent_basis(s.g)
    out = f @ cov @ f.T
    for part, std in ((THETA, noise.gyro_noise_std), (VEL, noise.accel_noise_std), (GYRO_BIAS, noise.gyro_rw_std), (ACCEL_BIAS, noise.accel_rw_std)):
        out[part, part] += dt * std**2 * np.eye(3)
    return out


@dataclass
class ImuBuffer:
    """Samples in time order: stamps (ns) and rows of angular velocity and acceleration."""

    stamps: list[int] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)

    def push(self, stamp: int, value: np.ndarray) -> None:
        self.stamps.append(int(stamp))
        self.values.append(np.asarray(value, float))

    def covers(self, t0: int, t1: int) -> bool:
        return bool(self.stamps) and self.stamps[0] <= t0 and self.stamps[-1] >= t1

    def slice(self, t0: int, t1: int, drop_exact_end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Stamps and values inside [t0, t1] with both ends, interpolated where no sample lies there."""
        if not self.covers(t0, t1):
            raise ValueError(f"samples do not cover [{t0}, {t1}]")
        stamps = np.array(self.stamps, np.int64)
        inside = np.flatnonzero((stamps > t0) & (stamps < t1))
        exact = bool((stamps == t1).any())
        last = [t1] if t1 > t0 and not (exact and drop_exact_end) else []
        values = [self._at(t0, stamps), *(self.values[i] for i in inside.tolist()), *(self._at(t, stamps) for t in last)]
        return np.array([t0, *stamps[inside].tolist(), *last], np.int64), np.array(values)

    def at(self, t: int) -> np.ndarray:
        return self._at(t, np.array(self.stamps, np.int64))

    def _at(self, t: int, stamps: np.ndarray) -> np.ndarray:
        i = int(np.searchsorted(stamps, t))
        if i < len(stamps) and stamps[i] == t:
            return self.values[i]
        alpha = (t - stamps[i - 1]) / (stamps[i] - stamps[i - 1])
        return (1 - alpha) * self.values[i - 1] + alpha * self.values[i]

    def forget(self, before: int) -> None:
        """Drops what no later slice from `before` on can need; one sample at or before it stays."""
        keep = max(0, int(np.searchsorted(np.array(self.stamps, np.int64), before, "right")) - 1)
        del self.stamps[:keep], self.values[:keep]


def scan_trajectory(s: State, stamps: np.ndarray, values: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(stamp, rotation, position) at each sample, from s's attitude and velocity and the origin."""
    now = s.with_(p=np.zeros(3))
    out = [(int(stamps[0]), now.R, now.p)]
    for i in range(1, len(stamps)):
        now = propagate(now, values[i - 1], values[i], (int(stamps[i]) - int(stamps[i - 1])) * 1e-9)
        out.append((int(stamps[i]), now.R, now.p))
    return out


def poses_at(trajectory: list, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and positions on the trajectory's geodesics at many times at once; its ends stand for what is beyond."""
    stamps = np.array([x[0] for x in trajectory], np.int64)
    rs, ps = np.array([x[1] for x in trajectory]), np.array([x[2] for x in trajectory])
    if len(stamps) == 1:
        return np.repeat(rs, len(times), 0), np.repeat(ps, len(times), 0)
    at = np.clip(np.searchsorted(stamps, times, "right"), 1, len(stamps) - 1) - 1
    alpha = np.clip((times - stamps[at]) / (stamps[at + 1] - stamps[at]), 0.0, 1.0)
    twists = np.zeros((len(stamps), 2, 3))
    for i in np.unique(at).tolist():
        twists[i] = se3_log(rs[i].T @ rs[i + 1], rs[i].T @ (ps[i + 1] - ps[i]))
    turn, move = se3_exp_many(alpha[:, None] * twists[at, 0], alpha[:, None] * twists[at, 1])
    return rs[at] @ turn, np.einsum("nij,nj->ni", rs[at], move) + ps[at]


def deskew(points: np.ndarray, times: np.ndarray, trajectory: list, t_ref: int, s: State) -> np.ndarray:
    """Lidar points measured at `times` moved to where the lidar was at t_ref. One pose per distinct time."""
    distinct, which = np.unique(times, return_inverse=True)
    (r_ref,), (p_ref,) = poses_at(trajectory, np.array([t_ref], np.int64))
    r, p = poses_at(trajectory, distinct)
    back = s.RE.T @ r_ref.T
    rs = back @ r @ s.RE
    ts = (r @ s.pE + p - p_ref) @ back.T - s.RE.T @ s.pE
    return np.einsum("nij,nj->ni", rs[which], points) + ts[which]


def voxel_means(points: np.ndarray, leaf: float) -> np.ndarray:
    """The mean point of each occupied voxel; non-finite points are left out."""
    points = points[np.isfinite(points).all(1)]
    if not len(points):
        return points
    _, which, n = np.unique(np.floor(points / leaf).astype(np.int64), axis=0, return_inverse=True, return_counts=True)
    return np.column_stack([np.bincount(which.ravel(), points[:, i]) for i in range(3)]) / n[:, None]


# --- map -------------------------------------------------------------------------------------------------------


class GridMap:
    """World points with nearest-neighbour search by sorted grid cells, one grid per search radius."""

    _SPAN = np.int64(1) << 20

    def __init__(self, points: np.ndarray | None = None):
        self.points = np.empty((0, 3)) if points is None else np.asarray(points, float).reshape(-1, 3)
        self._grids: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def __len__(self) -> int:
        return len(self.points)

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        c = cells + self._SPAN
        return (c[..., 0] << np.int64(42)) | (c[..., 1] << np.int64(21)) | c[..., 2]

    def _grid(self, size: float) -> tuple[np.ndarray, np.ndarray]:
        if size not in self._grids:
            keys = self._keys(np.floor(self.points / size).astype(np.int64))
            order = np.argsort(keys, kind="stable")
            self._grids[size] = keys[order], order
        return self._grids[size]

    def _pairs(self, queries: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, d2) of all pairs within the radius."""
        keys, order = self._grid(radius)
        steps = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], np.int64)
        wanted = self._keys(np.floor(queries / radius).astype(np.int64)[:, None] + steps).reshape(-1)
        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        n = high - low
        stop = np.cumsum(n)
        point = order[np.repeat(low - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)]
        query = np.repeat(np.arange(len(wanted)) // len(steps), n)
        d2 = ((queries[query] - self.points[point]) ** 2).sum(1)
        near = d2 <= radius * radius
        return query[near], point[near], d2[near]

    def knn(self, queries: np.ndarray, k: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Per query its k nearest points within the radius and their d2, or -1 and inf where there are fewer."""
        found, dist = np.full((len(queries), k), -1), np.full((len(queries), k), np.inf)
        if not len(self.points) or not len(queries):
            return found, dist
        rest = np.arange(len(queries))
        for r in [*(x for x in LEVELS if x < radius), radius]:
            query, point, d2 = self._pairs(queries[rest], r)
            order = np.lexsort((point, d2, query))
            query, point, d2 = query[order], point[order], d2[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            few = rank < k
            full = np.bincount(query, minlength=len(rest)) >= k
            take = few & (full[query] | (r == radius))
            found[rest[query[take]], rank[take]] = point[take]
            dist[rest[query[take]], rank[take]] = d2[take]
            rest = rest[~full]
            if not len(rest):
                break
        return found, dist

    def insert(self, new: np.ndarray, leaf: float | None) -> None:
        """Adds points; with a leaf, only those that have no point of the map, as it was, nearer than it."""
        if leaf and len(self.points) and len(new):
            query, _, d2 = self._pairs(new, leaf)
            taken = np.zeros(len(new), bool)
            taken[query[d2 < leaf * leaf]] = True
            new = new[~taken]
        self.points = np.concatenate([self.points, new])
        self._grids = {}

    def crop(self, low: np.ndarray, high: np.ndarray) -> None:
        inside = ((self.points >= low) & (self.points <= high)).all(1)
        if not inside.all():
            self.points, self._grids = self.points[inside], {}


class LocalMap:
    """A GridMap within a cube that follows the sensor in steps."""

    def __init__(self, params: Map, points: np.ndarray | None = None, box: np.ndarray | None = None):
        self.params, self.grid, self.box = params, GridMap(points), box

    def insert(self, points: np.ndarray) -> None:
        self.grid.insert(points, self.params.voxel_leaf if self.params.voxel_on_insert else None)

    def recenter(self, position: np.ndarray) -> None:
        """Seats the cube at the first call; later moves it to the position when that is within the margin of a face."""
        crop = self.params.crop
        if not crop.enabled:
            return
        half, margin = crop.keep_factor * crop.sensor_range, crop.margin_factor * crop.sensor_range
        if self.box is None:
            self.box = np.array([position - half, position + half])
        elif min((position - self.box[0]).min(), (self.box[1] - position).min()) < margin:
            self.box = np.array([position - half, position + half])
            self.grid.crop(*self.box)


def fit_planes(neighbours: np.ndarray, least: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normals, offsets and validity of the planes through n x k x 3 neighbours (least squares of A m = -1)."""
    m2 = np.einsum("nki,nkj->nij", neighbours, neighbours)
    det = np.linalg.det(m2)
    ok = np.abs(det) > 1e-12 * (np.trace(m2, axis1=1, axis2=2) / 3) ** 3
    m = np.zeros((len(neighbours), 3))
    m[ok] = np.linalg.solve(m2[ok], -neighbours[ok].sum(1)[..., None])[..., 0]
    length = np.linalg.norm(m, axis=1)
    ok &= length >= least
    safe = np.where(ok, length, 1.0)
    return m / safe[:, None], 1 / safe, ok


def associate(grid: GridMap, points: np.ndarray, pose: tuple, params: Association) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lidar points with a plane, their normals and residuals."""
    world = points @ pose[0].T + pose[1]
    found, _ = grid.knn(world, params.num_neighbors, params.max_neighbor_dist2**0.5)
    whole = np.flatnonzero(found[:, -1] >= 0)
    near = grid.points[found[whole]]
    normal, d, ok = fit_planes(near)
    ok &= (np.abs(np.einsum("nki,ni->nk", near, normal) + d[:, None]) <= params.max_plane_dist).all(1)
    residual = (normal * world[whole]).sum(1) + d
    reach = np.linalg.norm(points[whole], axis=1)
    ok &= reach >= 1e-6
    ok &= 1 - 0.9 * np.abs(residual) / np.sqrt(np.where(ok, reach, 1.0)) > params.min_quality
    return points[whole[ok]], normal[ok], residual[ok]


def linearise(s: State, points: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """The measurement rows (m x 23) of point-to-plane residuals."""
    h = np.zeros((len(points), DIM))
    turned, body = normals @ s.R, points @ s.RE.T + s.pE
    h[:, THETA] = np.cross(body, turned)
    h[:, POS] = normals
    h[:, EXT_ROT] = np.cross(points, turned @ s.RE)
    h[:, EXT_POS] = turned
    return h


@dataclass
class Update:
    state: State
    cov: np.ndarray
    iterations: int
    converged: bool


def iterated_update(s: State, cov: np.ndarray, measure: Callable[[State], tuple[np.ndarray, np.ndarray]], params: Iekf) -> Update:
    """Fixed point of the measurement update around the iterate; the gate and the prior use the predicted covariance.

    With r = sigma^2 and S = P^-1 + H'H / r, K z = S^-1 H'z / r and K H = S^-1 H'H / r, so no matrix grows with the rows.
    No rows at first: the prior, converged. No rows later: the last rows' covariance, not converged.
    """
    r, prior = params.sigma**2, np.linalg.inv(cov)
    now, gain, iterations, converged = s, None, 0, False
    for _ in range(params.max_iterations):
        h, z = measure(now)
        if params.reject_outliers and len(z):
            keep = z * z / (np.einsum("ni,ij,nj->n", h, cov, h) + r) <= params.outlier_chi2
            h, z = h[keep], z[keep]
        if not len(z):
            converged = iterations == 0
            break
        hh = h.T @ h / r
        solve = np.linalg.solve(prior + hh, np.column_stack([hh, h.T @ z / r]))
        gain = solve[:, :-1]
        step = -solve[:, -1] - (np.eye(DIM) - gain) @ now.minus(s)
        now = now.plus(step)
        iterations += 1
        if np.linalg.norm(step) < params.convergence_tol:
            converged = True
            break
    if gain is not None:
        cov = (np.eye(DIM) - gain) @ cov
        cov = 0.5 * (cov + cov.T)
    return Update(now, cov, iterations, converged)


# --- sequence --------------------------------------------------------------------------------------------------


@dataclass
class Scan:
    stamp: int
    points: np.ndarray  # n x 3, lidar frame
    offsets: np.ndarray  # n, ns after stamp


@dataclass
class Result:
    t_ns: int
    scan_index: int
    state: State
    iterations: int
    converged: bool
    map_size: int
    cov: np.ndarray
    converged_scans: int
    total_iterations: int
    dropped_scans: int


class Sequence:
    """All state of one sequence. Samples and scans are pushed in arrival order; ready() processes what it can."""

    def __init__(self, params: Params, extrinsic: tuple[np.ndarray, np.ndarray] | None = None, drop_exact_end: bool = False):
        self.params, self.drop_exact_end = params, drop_exact_end
        self.extrinsic = extrinsic or (params.extrinsic.matrix(), np.array(params.extrinsic.translation))
        self.buffer, self.pending = ImuBuffer(), []
        self.window: list[tuple[int, np.ndarray]] = []
        self.state: State | None = None
        self.cov: np.ndarray | None = None
        self.last_ref = 0
        self.map = LocalMap(params.map)
        self.scans = self.converged_scans = self.total_iterations = self.dropped_scans = 0

    def add_imu(self, stamp: int, value: np.ndarray) -> None:
        self.buffer.push(stamp, value)
        if self.state is not None:
            return
        self.window.append((int(stamp), np.asarray(value, float)))
        n = self.params.init.imu_count
        if len(self.window) < n:
            return
        rows = np.array([v for _, v in self.window])
        start = initialise(rows[:, :3], rows[:, 3:], self.params.init)
        if not start.ok:
            self.window.pop(0)
            return
        self.state = start.state.with_(RE=self.extrinsic[0], pE=self.extrinsic[1])
        self.cov = start.cov
        if not self.params.estimator.enable_extrinsic_estimation:
            for part in (EXT_ROT, EXT_POS):
                self.cov[part, part] = PINNED * np.eye(3)
        self.last_ref, self.window = int(stamp), []

    def add_scan(self, scan: Scan) -> None:
        """Scans before the start are dropped; the clock offset is applied."""
        if self.state is not None:
            shift = round(self.params.lidar_time_offset_sec * 1e9)
            self.pending.append(Scan(scan.stamp + shift, scan.points, scan.offsets))

    def ready(self) -> list[Result]:
        """Results of the pending scans whose span the inertial samples cover, in order."""
        out = []
        while self.pending:
            scan = self.pending[0]
            if not len(scan.offsets):
                self.pending.pop(0)
                continue
            t0, t1 = scan.stamp + int(scan.offsets.min()), scan.stamp + int(scan.offsets.max())
            if self.last_ref and t1 <= self.last_ref:
                self.pending.pop(0)
                continue
            if not self.buffer.covers(min(self.last_ref, t0), t1):
                if self.buffer.stamps and self.buffer.stamps[0] > min(self.last_ref, t0):
                    self.pending.pop(0)  # starts before all samples that are left: it can never be covered
                    self.dropped_scans += 1
                    continue
                break
            self.pending.pop(0)
            out.append(self._process(scan, t0, t1))
        return out

    def _process(self, scan: Scan, t0: int, t1: int) -> Result:
        trajectory = scan_trajectory(self.state, *self.buffer.slice(t0, t1, self.drop_exact_end))
        points = deskew(scan.points, scan.stamp + scan.offsets, trajectory, t1, self.state)
        points = voxel_means(points, self.params.preprocess.scan_voxel_leaf)
        stamps, values = self.buffer.slice(self.last_ref, t1, self.drop_exact_end)
        s, cov = self.state, self.cov
        for i in range(1, len(stamps)):
            dt = (int(stamps[i]) - int(stamps[i - 1])) * 1e-9
            s, cov = propagate(s, values[i - 1], values[i], dt), propagate_covariance(s, cov, values[i - 1], values[i], dt, self.params.imu_noise)

        def measure(x: State) -> tuple[np.ndarray, np.ndarray]:
            body, normal, residual = associate(self.map.grid, points, x.lidar_pose(), self.params.association)
            return linearise(x, body, normal), residual

        done = iterated_update(s, cov, measure, self.params.iekf)
        self.state, self.cov, self.last_ref = done.state, done.cov, t1
        r, p = self.state.lidar_pose()
        self.map.insert(points @ r.T + p)
        self.map.recenter(self.state.p)
        starts = [x.stamp + int(x.offsets.min()) for x in self.pending if len(x.offsets)]
        self.buffer.forget(min([t1, *starts]) - OVERLAP_NS)
        self.scans += 1
        self.converged_scans += done.converged
        self.total_iterations += done.iterations
        return Result(t1, self.scans, self.state, done.iterations, done.converged, len(self.map.grid), self.cov, self.converged_scans, self.total_iterations, self.dropped_scans)
