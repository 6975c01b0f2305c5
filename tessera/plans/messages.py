"""Serialised sensor messages made of table rows, for queries that decode them again."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The layouts of sensor_msgs/Imu and geometry_msgs/PoseStamped with an empty frame name.
_HEADER = [("number", "<u4"), ("secs", "<u4"), ("nsecs", "<u4"), ("frame", "<u4")]
IMU = np.dtype([*_HEADER, ("q", "<f8", 4), ("cov_q", "<f8", 9), ("gyro", "<f8", 3), ("cov_w", "<f8", 9), ("accel", "<f8", 3), ("cov_a", "<f8", 9)])
POSE = np.dtype([*_HEADER, ("p", "<f8", 3), ("q", "<f8", 4)])
#: Fields of a PointCloud2 point, their offsets and types.
CLOUD = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "<u2"), ("ring", "u1"), ("pad", "u1"), ("t", "<u4")])
_CLOUD_FIELDS = (("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("reflectivity", 12, 4), ("ring", 14, 2), ("t", 16, 6))


def _packed(b: pa.RecordBatch, kind: np.dtype, parts: dict[str, list[str]]) -> pa.Array:
    rows = np.zeros(b.num_rows, kind)
    stamp = b.column("stamp_ns").to_numpy()
    rows["secs"], rows["nsecs"] = stamp // 1_000_000_000, stamp % 1_000_000_000
    for part, names in parts.items():
        rows[part] = np.stack([b.column(n).to_numpy() for n in names], 1)
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _messages(rows: DataFrame, key: str, kind: np.dtype, parts: dict[str, list[str]]) -> DataFrame:
    names = [n for p in parts.values() for n in p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(b, kind, parts)], [key, "data"])

    return rows.select(key, "stamp_ns", *names).mapInArrow(run, f"{key} long, data binary")


def imu_messages(rows: DataFrame, key: str) -> DataFrame:
    """key and data: rows (key, stamp_ns, qw.., wx.., ax..) as Imu messages."""
    return _messages(rows, key, IMU, {"q": ["qx", "qy", "qz", "qw"], "gyro": ["wx", "wy", "wz"], "accel": ["ax", "ay", "az"]})


def pose_messages(rows: DataFrame, key: str) -> DataFrame:
    """key and data: rows (key, stamp_ns, px.., qw..) as PoseStamped messages."""
    return _messages(rows, key, POSE, {"p": ["px", "py", "pz"], "q": ["qx", "qy", "qz", "qw"]})


def cloud_messages(scans: DataFrame, key: str) -> DataFrame:
    """key and data: rows (key, stamp_ns, points array<struct<x, y, z, reflectivity, ring, t>>) as PointCloud2 messages."""
    fields = b"".join(struct.pack("<I", len(n)) + n.encode() + struct.pack("<IBI", at, kind, 1) for n, at, kind in _CLOUD_FIELDS)

    def one(stamp: int, points: list[dict]) -> bytes:
        rows = np.zeros(len(points), CLOUD)
        for n, _, _ in _CLOUD_FIELDS:
            rows[n] = [p[n] for p in points]
        head = struct.pack("<IIII", 0, stamp // 1_000_000_000, stamp % 1_000_000_000, 0) + struct.pack("<III", 1, len(points), len(_CLOUD_FIELDS))
        data = rows.tobytes()
        return head + fields + struct.pack("<BIII", 0, CLOUD.itemsize, len(data), len(data)) + data + b"\x01"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [one(t, p) for t, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], [key, "data"])

    return scans.select(key, "stamp_ns", "points").mapInArrow(run, f"{key} long, data binary")
