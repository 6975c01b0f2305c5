"""Drivers of the filter: batch replay and Structured Streaming over the same rows, one Sequence per key.

Rows (SENSOR): seq, arrival (their order within the sequence), kind ("imu" or "scan"), stamp_ns, wx, wy, wz, ax, ay, az for
samples, points for scans.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.manifold import quat_of
from tessera.params import Params
from tessera.streaming.filter import Result, Scan, Sequence

AXES = ("wx", "wy", "wz", "ax", "ay", "az")
POINT = "struct<x:float,y:float,z:float,t_offset_ns:bigint>"
SENSOR = f"seq string, arrival bigint, kind string, stamp_ns bigint, {', '.join(f'{a} double' for a in AXES)}, points array<{POINT}>"
RESULT = (
    "seq string, t_ns bigint, scan_index bigint, px double, py double, pz double, qw double, qx double, qy double, qz double, "
    "vx double, vy double, vz double, iterations int, converged boolean, map_size bigint, "
    "gyro_bias array<double>, accel_bias array<double>, gravity array<double>, extrinsic_p array<double>, extrinsic_q array<double>, cov_diagonal array<double>, "
    "converged_scans bigint, total_iterations bigint, dropped_scans bigint"
)
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def sensor_rows(imu: DataFrame, scan_points: DataFrame, arrival: str = "stamp") -> DataFrame:
    """SENSOR rows of decoded tables (seq, stamp_ns, axes) and (seq, scan_id, stamp_ns, x, y, z, t_offset_ns), in the order
    in which a replay meets them: a sample at its stamp, a scan when its last point is measured."""
    order = F.struct("pt_idx", F.struct("x", "y", "z", "t_offset_ns").alias("p"))
    scans = scan_points.groupBy("seq", "scan_id", "stamp_ns").agg(F.array_sort(F.collect_list(order)).alias("o"), F.max("t_offset_ns").alias("last"))
    null = F.lit(None).cast("double")
    a = imu.select("seq", F.col("stamp_ns").alias("arrival"), F.lit("imu").alias("kind"), "stamp_ns", *AXES, F.lit(None).cast(f"array<{POINT}>").alias("points"))
    b = scans.select("seq", (F.col("stamp_ns") + F.col("last")).alias("arrival"), F.lit("scan").alias("kind"), "stamp_ns", *(null.alias(x) for x in AXES), F.col("o.p").cast(f"array<{POINT}>").alias("points"))
    return a.unionByName(b)


def _feed(sequence: Sequence, rows: pd.DataFrame) -> list[Result]:
    out = []
    axes = rows[list(AXES)].to_numpy(float)
    for i, (kind, stamp, points) in enumerate(zip(rows["kind"], rows["stamp_ns"], rows["points"], strict=True)):
        if kind == "imu":
            sequence.add_imu(int(stamp), axes[i])
        else:
            p = [] if points is None else [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in points]
            p = [x for x in p if x[3] is not None]  # a scan without times is dropped
            a = np.array(p, float).reshape(-1, 4)
            offsets = np.array([x[3] for x in p], np.int64)
            sequence.add_scan(Scan(int(stamp), a[:, :3], offsets))
        out += sequence.ready()
    return out


def _frame(seq: str, results: list[Result]) -> pd.DataFrame:
    rows = []
    for r in results:
        s = r.state
        whole = [x.tolist() for x in (s.bg, s.ba, s.g, s.pE, quat_of(s.RE), np.diag(r.cov))]
        rows.append((seq, r.t_ns, r.scan_index, *s.p, *quat_of(s.R), *s.v, r.iterations, bool(r.converged), r.map_size, *whole, r.converged_scans, r.total_iterations, r.dropped_scans))
    return pd.DataFrame(rows, columns=_NAMES)


def replay(rows: DataFrame, params: Params, extrinsics: dict | None = None) -> DataFrame:
    """Results of all sequences. One shuffle by seq; each task then streams its sequences' rows in arrival order, so what it
    holds is the filter's own state and one batch, whatever a sequence's length. Sequences run in parallel."""
    ordered = rows.repartition("seq").sortWithinPartitions("seq", "arrival", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sequence = None, None
        for batch in batches:
            for seq, part in batch.groupby("seq", sort=False):
                if seq != now:
                    now, sequence = seq, Sequence(params, (extrinsics or {}).get(seq))
                found = _feed(sequence, part)
                if found:
                    yield _frame(seq, found)

    return ordered.mapInPandas(run, RESULT)


class FilterProcessor(StatefulProcessor):
    """The streaming twin of replay: the Sequence of a key is its state. Rows of one micro-batch are put in arrival order;
    scans wait in the state until the samples cover them."""

    def __init__(self, params: Params, extrinsics: dict | None = None):
        self.params, self.extrinsics = params, extrinsics or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("sequence", "blob binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seq = key[0]
        sequence = pickle.loads(self.held.get()[0]) if self.held.exists() else Sequence(self.params, self.extrinsics.get(seq))
        batch = pd.concat(list(rows)).sort_values(["arrival", "kind"], kind="stable")
        found = _feed(sequence, batch)
        self.held.update((pickle.dumps(sequence),))
        yield _frame(seq, found)

    def close(self) -> None:
        pass


def stream(rows: DataFrame, params: Params, extrinsics: dict | None = None) -> DataFrame:
    """replay over a streaming DataFrame of SENSOR rows, to be written in append mode with the RocksDB state store."""
    return rows.groupBy("seq").transformWithStateInPandas(
        statefulProcessor=FilterProcessor(params, extrinsics), outputStructType=RESULT, outputMode="Append", timeMode="None"
    )
