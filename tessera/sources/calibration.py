"""Calibration files in OpenCV's YAML dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from tessera.functions.manifold import quat_of, rotation_of

#: A key that imu files may give twice: first the noise, then the random walk.
TWICE = "gyro_std"


@dataclass
class ImuCalibration:
    topic: str = "/imu/imu"
    body: np.ndarray = field(default_factory=lambda: np.eye(4))
    accel_noise_std: float = 0.0
    accel_rw_std: float = 0.0
    gyro_noise_std: float = 0.0
    gyro_rw_std: float = 0.0


@dataclass
class LidarCalibration:
    topic: str
    body: np.ndarray
    vert_res: int
    horz_res: int


@dataclass
class PrismCalibration:
    topic: str
    body: np.ndarray


def _parse(path: str | Path) -> tuple[dict, list[float]]:
    """The file's mapping without directives and tags, and all values of the key that may come twice."""
    import yaml

    kept, twice = [], []
    for line in Path(path).read_text().splitlines():
        if line.startswith("%") or line.strip() == "---":
            continue
        if m := re.match(rf"\s*{TWICE}\s*:\s*([-+0-9.eE]+)", line):
            twice.append(float(m[1]))
            continue
        kept.append(re.sub(r"!!opencv-matrix", "", line))
    return yaml.safe_load("\n".join(kept)) or {}, twice


def _transform(root: dict, *names: str) -> np.ndarray:
    """A 4 x 4 matrix under the first of the names that is there, as OpenCV's data list or a plain one."""
    for name in names:
        if name in root:
            given = root[name]
            values = np.array(given["data"] if isinstance(given, dict) else given, float).ravel()
            if len(values) != 16:
                raise ValueError(f"{name}: {len(values)} values, expected 16")
            return values.reshape(4, 4)
    raise KeyError(f"none of {', '.join(names)}")


def load_imu(path: str | Path) -> ImuCalibration:
    root, twice = _parse(path)
    noise, walk = (*twice, 0.0, 0.0)[:2]
    return ImuCalibration(root["imu_topic"], _transform(root, "T_Body_Imu"), float(root["accel_std"]), float(root["accel_rw"]), noise, walk)


def load_lidar(path: str | Path) -> LidarCalibration:
    root, _ = _parse(path)
    return LidarCalibration(root["pointcloud_topic"], _transform(root, "T_Body_Lidar", "T_Body2Lidar"), int(root["VERT_RES"]), int(root["HORZ_RES"]))


def load_prism(path: str | Path) -> PrismCalibration:
    root, _ = _parse(path)
    return PrismCalibration(root["gndtr_topic"], _transform(root, "T_Body_Prism", "T_Body2Imu"))


def imu_from(body_imu: np.ndarray, body_other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation (made exact) and translation from another sensor's frame to the inertial unit's."""
    t = np.linalg.inv(body_imu) @ body_other
    return rotation_of(quat_of(t[:3, :3])), t[:3, 3]
