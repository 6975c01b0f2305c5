"""Dataset layouts: where a sequence's file, topics, extrinsic and ground truth are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.inertial import scale_acceleration, topics
from tessera.params import Params
from tessera.sources import calibration, decoders
from tessera.sources.bag import BagDataSource, find_bag

#: Fixed value: standard gravity, the unit of some inertial units.
G = 9.80665


@dataclass
class Sequence:
    """What a layout says about one sequence; lever: the true position's point in the inertial frame, if there is one."""

    name: str
    bag: Path
    imu_topic: str
    lidar_topic: str
    extrinsic: tuple[np.ndarray, np.ndarray]
    decode: Callable[[bytes], tuple]
    accel_scale: float = 1.0
    truth_topic: str | None = None
    lever: np.ndarray | None = None


def ntu_viral(folder: Path, params: Params) -> Sequence:
    file = folder / "imu_v100.yaml"
    imu = calibration.load_imu(file) if file.exists() else calibration.ImuCalibration()
    lidar, prism = calibration.load_lidar(folder / "lidar_horz.yaml"), calibration.load_prism(folder / "leica_prism.yaml")
    lever = calibration.imu_from(imu.body, prism.body)[1]
    return Sequence(folder.name, folder / f"{folder.name}.bag", imu.topic, lidar.topic, calibration.imu_from(imu.body, lidar.body), decoders.decode_cloud, 1.0, prism.topic, lever)


def _from_params(folder: Path, params: Params, imu: str, lidar: str, decode: Callable, scale: float = 1.0) -> Sequence:
    return Sequence(folder.name, find_bag(folder), imu, lidar, (params.extrinsic.matrix(), np.array(params.extrinsic.translation)), decode, scale)


#: Layouts by name.
FORMATS: dict[str, Callable[[Path, Params], Sequence]] = {
    "NTU_VIRAL": ntu_viral,
    "HILTI_22": lambda f, p: _from_params(f, p, "/alphasense/imu", "/hesai/pandar", partial(decoders.decode_cloud, time_mode=decoders.ABSOLUTE_SECONDS)),
    "FAST_LIVO2": lambda f, p: _from_params(f, p, "/livox/imu", "/livox/lidar", decoders.decode_livox, G),
}


def open_sequence(layout: str, folder: str | Path, params: Params) -> Sequence:
    if layout not in FORMATS:
        raise ValueError(f"unknown format {layout!r}; known: {', '.join(FORMATS)}")
    return FORMATS[layout](Path(folder).resolve(), params)


def tables(spark: SparkSession, s: Sequence) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Samples, scan points (scan_id in the file's order) and true positions (t_ns, px, py, pz) of a sequence."""
    spark.dataSource.register(BagDataSource)
    read = lambda topic: topics(spark.read.format("rosbag").load(str(s.bag)), [topic]).withColumn("seq", F.lit(s.name))
    imu = scale_acceleration(decoders.imu_rows(read(s.imu_topic), ["seq"]), s.accel_scale)
    scans = read(s.lidar_topic).withColumn("scan_id", (F.col("chunk").cast("long") * (1 << 32)) + F.col("place"))
    points = decoders.point_rows(scans, s.decode, ["seq", "scan_id"])
    truth = None
    if s.truth_topic:
        truth = decoders.pose_rows(read(s.truth_topic), ["seq"]).select("seq", F.col("stamp_ns").alias("t_ns"), "px", "py", "pz")
    return imu, points, truth
