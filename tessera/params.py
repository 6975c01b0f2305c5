"""Run parameters: dataclasses with defaults, overlaid by a YAML file."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any, get_type_hints

import numpy as np

from tessera.functions.manifold import nearest_rotation, rotation_of


@dataclass(frozen=True)
class Preprocess:
    scan_voxel_leaf: float = 0.5


@dataclass(frozen=True)
class Init:
    imu_count: int = 200
    gravity_magnitude: float = 9.78
    max_accel_var: float = 0.05
    max_gyro_var: float = 0.01
    theta_std: float = 0.017
    pos_std: float = 1e-3
    vel_std: float = 1e-2
    bias_gyro_std: float = 1e-3
    bias_accel_std: float = 0.01
    gravity_std: float = 1e-2
    ext_rot_std: float = 0.0035
    ext_trans_std: float = 0.002


@dataclass(frozen=True)
class ImuNoise:
    gyro_noise_std: float = 0.0
    accel_noise_std: float = 0.0
    gyro_rw_std: float = 0.0
    accel_rw_std: float = 0.0


@dataclass(frozen=True)
class Iekf:
    sigma: float = 0.01
    max_iterations: int = 5
    convergence_tol: float = 1e-3
    reject_outliers: bool = True
    outlier_chi2: float = 3.841


@dataclass(frozen=True)
class Association:
    num_neighbors: int = 5
    max_neighbor_dist2: float = 5.0
    max_plane_dist: float = 0.1
    min_quality: float = 0.9


@dataclass(frozen=True)
class Crop:
    enabled: bool = True
    sensor_range: float = 300.0
    margin_factor: float = 1.5
    keep_factor: float = 2.0


@dataclass(frozen=True)
class Map:
    voxel_on_insert: bool = True
    voxel_leaf: float = 0.1
    crop: Crop = field(default_factory=Crop)


@dataclass(frozen=True)
class Estimator:
    enable_extrinsic_estimation: bool = False


@dataclass(frozen=True)
class Extrinsic:
    """Lidar to inertial unit: translation, and rotation as a quaternion (w, x, y, z) or nine matrix entries by rows."""

    translation: tuple[float, ...] = (0.0, 0.0, 0.0)
    rotation: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)

    def matrix(self) -> np.ndarray:
        r = np.array(self.rotation, float)
        return rotation_of(r) if len(r) == 4 else nearest_rotation(r.reshape(3, 3))


@dataclass(frozen=True)
class Params:
    lidar_time_offset_sec: float = -0.1
    preprocess: Preprocess = field(default_factory=Preprocess)
    init: Init = field(default_factory=Init)
    imu_noise: ImuNoise = field(default_factory=ImuNoise)
    iekf: Iekf = field(default_factory=Iekf)
    association: Association = field(default_factory=Association)
    map: Map = field(default_factory=Map)
    estimator: Estimator = field(default_factory=Estimator)
    extrinsic: Extrinsic = field(default_factory=Extrinsic)


def _value(kind: Any, given: Any, path: str) -> Any:
    if kind is bool and isinstance(given, bool):
        return given
    if kind is int and isinstance(given, int) and not isinstance(given, bool):
        return given
    if kind is float and isinstance(given, (int, float)) and not isinstance(given, bool):
        return float(given)
    if kind not in (bool, int, float) and isinstance(given, list) and all(isinstance(x, (int, float)) for x in given):
        allowed = {"translation": (3,), "rotation": (4, 9)}[path.rpartition(".")[2]]
        if len(given) in allowed:
            return tuple(float(x) for x in given)
        raise ValueError(f"params: {path} needs {' or '.join(map(str, allowed))} values")
    raise ValueError(f"params: bad value for '{path}': {given!r}")


def overlay(base: Any, given: dict, warnings: list[str] | None = None, prefix: str = "") -> Any:
    """base with given's values; unknown keys become warnings, wrong types raise."""
    kinds = get_type_hints(type(base))
    known = {f.name for f in fields(base)}
    if warnings is not None:
        warnings += [f"params: unknown key '{prefix}{k}' ignored" for k in given if k not in known]
    made = {}
    for name in known & set(given):
        value, now = given[name], getattr(base, name)
        if is_dataclass(now):
            if value is None:
                continue
            if not isinstance(value, dict):
                raise ValueError(f"params: '{prefix}{name}' is not a section")
            made[name] = overlay(now, value, warnings, f"{prefix}{name}.")
        elif value is not None:
            made[name] = _value(kinds[name], value, f"{prefix}{name}")
    return replace(base, **made)


def load_params(path: str | Path, warnings: list[str] | None = None) -> Params:
    """Parameters from a YAML file over the defaults."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"params: file not found: {path}")
    try:
        root = yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as e:
        raise ValueError(f"params: failed to parse {path}: {e}") from e
    if not isinstance(root, dict):
        raise ValueError(f"params: {path} is not a YAML mapping")
    return overlay(Params(), root, warnings)
