"""Serialised sensor messages to rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sources.bag import Cursor

#: NumPy types of the point field type codes 1 to 8.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "<i2", 4: "<u2", 5: "<i4", 6: "<u4", 7: "<f4", 8: "<f8"}
#: Names that an optional point field may have.
INTENSITY, RING, TIME = ("intensity", "reflectivity"), ("ring",), ("t", "time", "timestamp")
#: Meaning of a point's time: nanoseconds after the header's stamp, or seconds since the epoch.
OFFSET_NANOS, ABSOLUTE_SECONDS = "offset_nanos", "absolute_seconds"
#: Fixed value: the layout of a Livox point (19 bytes).
LIVOX = np.dtype([("offset", "<u4"), ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("reflectivity", "u1"), ("tag", "u1"), ("line", "u1")])

IMU_SCHEMA = "stamp_ns bigint, qw double, qx double, qy double, qz double, wx double, wy double, wz double, ax double, ay double, az double"
POSE_SCHEMA = "stamp_ns bigint, px double, py double, pz double, qw double, qx double, qy double, qz double"
POINT_SCHEMA = "stamp_ns bigint, frame_id string, pt_idx int, x float, y float, z float, intensity float, ring int, t_offset_ns bigint"


def _header(c: Cursor) -> tuple[int, str]:
    _, secs, nsecs = c.read("III")
    return secs * 1_000_000_000 + nsecs, c.string()


def decode_imu(data: bytes) -> tuple:
    c = Cursor(data)
    stamp, _ = _header(c)
    x, y, z, w = c.read("4d")
    c.take(72)
    gyro = c.read("3d")
    c.take(72)
    return stamp, w, x, y, z, *gyro, *c.read("3d")


def decode_pose(data: bytes) -> tuple:
    c = Cursor(data)
    stamp, _ = _header(c)
    position, (x, y, z, w) = c.read("3d"), c.read("4d")
    return stamp, *position, w, x, y, z


def _unsigned(values: np.ndarray, most: int) -> np.ndarray:
    return np.clip(np.nan_to_num(values.astype(np.float64)), 0, most).astype(np.int64)


def decode_cloud(data: bytes, time_mode: str = OFFSET_NANOS) -> tuple[int, str, dict[str, np.ndarray]]:
    """Stamp, frame and point columns of a PointCloud2, by the field descriptors of the message itself. Fields that are
    missing or of an unknown type are zero; a time before the header's stamp counts as at it."""
    c = Cursor(data)
    stamp, frame = _header(c)
    height, width = c.read("II")
    layout = {}
    for _ in range(c.read("I")):
        name = c.string()
        layout[name] = c.read("IBI")[:2]
    _, step, _ = c.read("BII")
    raw, n = np.frombuffer(c.take(c.read("I")), np.uint8), height * width
    grid = raw[: n * step].reshape(n, step) if step else np.empty((n, 0), np.uint8)

    def column(*names: str) -> np.ndarray:
        at = next((layout[x] for x in names if x in layout), None)
        if at is None or at[1] not in FIELD_TYPES:
            return np.zeros(n, np.float64)
        kind = np.dtype(FIELD_TYPES[at[1]])
        return np.ascontiguousarray(grid[:, at[0] : at[0] + kind.itemsize]).view(kind).reshape(n)

    if time_mode == ABSOLUTE_SECONDS:
        # subtract whole seconds first: a double holds an epoch time to a few hundred nanoseconds only
        seconds = column(*TIME).astype(np.float64)
        offset = np.maximum(0, np.rint((seconds - stamp // 1_000_000_000) * 1e9) - stamp % 1_000_000_000).astype(np.int64)
    else:
        offset = _unsigned(column(*TIME), 2**32 - 1)
    points = {a: column(a).astype(np.float32) for a in ("x", "y", "z")}
    return stamp, frame, points | {"intensity": column(*INTENSITY).astype(np.float32), "ring": _unsigned(column(*RING), 2**16 - 1), "t_offset_ns": offset}


def decode_livox(data: bytes) -> tuple[int, str, dict[str, np.ndarray]]:
    """Stamp, frame and point columns of a Livox CustomMsg; offsets count from the header's stamp."""
    c = Cursor(data)
    stamp, frame = _header(c)
    c.read("QIB3B")
    p = np.frombuffer(c.take(c.read("I") * LIVOX.itemsize), LIVOX)
    out = {a: p[a].copy() for a in ("x", "y", "z")}
    return stamp, frame, out | {"intensity": p["reflectivity"].astype(np.float32), "ring": p["line"].astype(np.int64), "t_offset_ns": p["offset"].astype(np.int64)}


def _keyed(schema: str, keep: dict[str, str]) -> str:
    return ", ".join([*(f"{k} {t}" for k, t in keep.items()), schema])


def _rows(messages: DataFrame, decode: Callable[[bytes], tuple], schema: str, keep: list[str]) -> DataFrame:
    kinds = {k: t for k, t in messages.dtypes if k in keep}
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [decode(x.as_buffer()) for x in b.column(b.num_columns - 1)]
            arrays = [pa.array(list(v), pa.int64() if i == 0 else pa.float64()) for i, v in enumerate(zip(*found, strict=True))] or [pa.array([], pa.int64() if i == 0 else pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], [*keep, *names])

    return messages.select(*keep, "data").filter("data is not null").mapInArrow(run, _keyed(schema, kinds))


def imu_rows(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """sensor_msgs/Imu payloads (column data) as IMU_SCHEMA, after the columns to keep."""
    return _rows(messages, decode_imu, IMU_SCHEMA, keep or [])


def pose_rows(messages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """geometry_msgs/PoseStamped payloads as POSE_SCHEMA."""
    return _rows(messages, decode_pose, POSE_SCHEMA, keep or [])


def point_rows(messages: DataFrame, decode: Callable[[bytes], tuple], keep: list[str] | None = None) -> DataFrame:
    """Scans decoded to one row per point, POINT_SCHEMA; one batch per scan."""
    keep = keep or []
    kinds = {k: t for k, t in messages.dtypes if k in keep}
    names = [x.split()[0] for x in POINT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column(b.num_columns - 1)):
                stamp, frame, p = decode(x.as_buffer())
                n = len(p["x"])
                held = [pa.concat_arrays([b.column(k).slice(i, 1)] * n) if n else b.column(k).slice(0, 0) for k in range(len(keep))]
                own = [pa.array(np.full(n, stamp)), pa.array([frame] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(p[a]) for a in ("x", "y", "z", "intensity")), pa.array(p["ring"].astype(np.int32)), pa.array(p["t_offset_ns"])]
                yield pa.RecordBatch.from_arrays([*held, *own], [*keep, *names])

    return messages.select(*keep, "data").filter("data is not null").mapInArrow(run, _keyed(POINT_SCHEMA, kinds))
