"""Command line: replay a recorded sequence and write its trajectories."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import functions as F

from tessera.functions import columns as c
from tessera.operators.evaluation import rotation_angle_degrees, run_summary
from tessera.params import load_params
from tessera.sources import loaders, tum
from tessera.streaming.replay import replay, sensor_rows


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    p.add_argument("--format", required=True, choices=sorted(loaders.FORMATS))
    p.add_argument("--sequence", required=True, type=Path)
    p.add_argument("--params", required=True, type=Path)
    p.add_argument("--output", type=Path)
    a = p.parse_args(argv)
    if not a.sequence.is_dir():
        p.error(f"no such folder: {a.sequence}")
    a.output = a.output or Path("evaluation") / a.sequence.resolve().name
    return a


def main(argv: list[str] | None = None) -> int:
    from tessera.session import local_session

    a = arguments(sys.argv[1:] if argv is None else argv)
    warnings: list[str] = []
    params = load_params(a.params, warnings)
    for w in warnings:
        print(w, file=sys.stderr)
    spark = local_session()
    s = loaders.open_sequence(a.format, a.sequence, params)
    imu, points, truth = loaders.tables(spark, s)
    results = replay(sensor_rows(imu, points), params, {s.name: s.extrinsic}).cache()
    poses = results.select("t_ns", "px", "py", "pz", "qw", "qx", "qy", "qz")
    tum.write_run(poses, str(a.output), None if s.lever is None else s.lever.tolist(), truth)
    total = run_summary(results).first()
    turned = results.agg(F.max_by(rotation_angle_degrees(c.literal((1, 0, 0, 0)), c.vector("qw", "qx", "qy", "qz")), "scan_index").alias("deg")).first()["deg"]
    print(f"{total['scans']} scans, {total['converged_percent'] or 0:.1f} % converged, {total['mean_iterations'] or 0:.2f} iterations each, final attitude {turned or 0:.2f} degrees from the start; written to {a.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
