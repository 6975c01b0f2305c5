"""Bag files, message decoders, calibration, parameters, layouts, trajectories and the command line."""

import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.params import Params, load_params
from tessera.sources import bag, calibration, decoders, loaders, tum
from tests.sensor.test_filter import room


def header(stamp=0, frame="f"):
    return struct.pack("<III", 7, stamp // 10**9, stamp % 10**9) + struct.pack("<I", len(frame)) + frame.encode()


def imu_message(stamp, gyro=(0.1, 0.2, 0.3), accel=(1.0, 2.0, 3.0)):
    cov = struct.pack("<9d", *range(9))
    return header(stamp) + struct.pack("<4d", 0.0, 0.0, 0.6, 0.8) + cov + struct.pack("<3d", *gyro) + cov + struct.pack("<3d", *accel) + cov


def pose_message(stamp, position=(1.0, 2.0, 3.0)):
    return header(stamp) + struct.pack("<3d", *position) + struct.pack("<4d", 0.0, 0.0, 0.0, 1.0)


def cloud_message(stamp, fields, rows, step):
    """fields: (name, offset, type); rows: bytes of each point."""
    out = header(stamp) + struct.pack("<II", 1, len(rows)) + struct.pack("<I", len(fields))
    for name, offset, kind in fields:
        out += struct.pack("<I", len(name)) + name.encode() + struct.pack("<IBI", offset, kind, 1)
    data = b"".join(rows)
    return out + struct.pack("<BII", 0, step, step * len(rows)) + struct.pack("<I", len(data)) + data + b"\x01"


OUSTER = [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("reflectivity", 12, 4), ("ring", 14, 2), ("t", 16, 6)]


def ouster(stamp, points, offsets):
    rows = [struct.pack("<fffHBxI", *p, 900, k % 64, o) for k, (p, o) in enumerate(zip(points, offsets, strict=True))]
    return cloud_message(stamp, OUSTER, rows, 20)


def record(head, data):
    h = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in head.items())
    return struct.pack("<I", len(h)) + h + struct.pack("<I", len(data)) + data


def u32(x):
    return struct.pack("<I", x)


def write_bag(path, messages, compression="none", per_chunk=3):
    """messages: (topic, stamp, data)."""
    topics = list(dict.fromkeys(t for t, _, _ in messages))
    connections = b"".join(record({"op": b"\x07", "conn": u32(i), "topic": t.encode()}, b"") for i, t in enumerate(topics))
    top = lambda at: record({"op": b"\x03", "index_pos": struct.pack("<Q", at), "conn_count": u32(len(topics)), "chunk_count": u32(0)}, b" " * 40)
    out, infos = bag.MAGIC + top(0), b""
    for k in range(0, len(messages), per_chunk):
        data = connections if k == 0 else b""
        for t, stamp, m in messages[k : k + per_chunk]:
            data += record({"op": b"\x02", "conn": u32(topics.index(t)), "time": struct.pack("<II", stamp // 10**9, stamp % 10**9)}, m)
        packed = data if compression == "none" else pa.Codec("lz4").compress(data).to_pybytes()
        infos += record({"op": b"\x06", "ver": u32(1), "chunk_pos": struct.pack("<Q", len(out)), "count": u32(1)}, b"")
        out += record({"op": b"\x05", "compression": compression.encode(), "size": u32(len(data))}, packed) + record({"op": b"\x04", "ver": u32(1), "conn": u32(0), "count": u32(0)}, b"")
    whole = bag.MAGIC + top(len(out)) + out[len(bag.MAGIC + top(0)) :] + connections + infos
    path.write_bytes(whole)
    return path


@pytest.mark.parametrize("compression", ["none", "lz4"])
def test_bag_scan_and_topic_filter(spark, tmp_path, compression):
    messages = [("/a" if k % 3 else "/b", 10**9 * k + 5, bytes([k]) * k) for k in range(20)]
    path = write_bag(tmp_path / "x.bag", messages, compression)
    spark.dataSource.register(bag.BagDataSource)
    df = spark.read.format("rosbag").load(str(path))
    rows = sorted(df.collect(), key=lambda r: (r.chunk, r.place))
    assert [(r.topic, r.stamp_ns, bytes(r.data)) for r in rows] == messages and df.rdd.getNumPartitions() == 7
    some = df.filter(F.col("topic") == "/b")
    assert {r.stamp_ns for r in some.collect()} == {s for t, s, _ in messages if t == "/b"}
    reader = bag.BagReader([str(path)])
    assert list(reader.pushFilters([bag.EqualTo(("topic",), "/b"), bag.EqualTo(("place",), 1)])) == [bag.EqualTo(("place",), 1)]
    assert {m[0] for p in reader.partitions() for m in reader.read(p)} == {"/b"}
    assert df.filter("topic in ('/c')").count() == 0
    assert bag.find_bag(tmp_path) == path


def test_damaged_bags(tmp_path):
    (tmp_path / "no.bag").write_bytes(b"#ROSBAG V1.2\n")
    path = write_bag(tmp_path / "cut.bag", [("/a", 1, b"x" * 100)])
    whole = path.read_bytes()
    with pytest.raises(bag.BadBag):
        bag.catalog(str(tmp_path / "no.bag"))
    with pytest.raises(FileNotFoundError):
        bag.find_bag(tmp_path)
    for n in (20, len(whole) - 3):
        path.write_bytes(whole[:n])
        with pytest.raises(bag.BadBag):
            bag.catalog(str(path))
    path.write_bytes(whole.replace(struct.pack("<Q", int.from_bytes(whole[whole.index(b"index_pos=") + 10 :][:8], "little")), struct.pack("<Q", 0), 1))
    with pytest.raises(bag.BadBag, match="not indexed"):
        bag.catalog(str(path))
    with pytest.raises(bag.BadBag):
        bag.inflate(b"", "bz2", 0)


def test_messages():
    assert decoders.decode_imu(imu_message(12 * 10**9 + 345)) == (12 * 10**9 + 345, 0.8, 0.0, 0.0, 0.6, 0.1, 0.2, 0.3, 1.0, 2.0, 3.0)
    assert decoders.decode_pose(pose_message(12 * 10**9 + 345))[:4] == (12 * 10**9 + 345, 1.0, 2.0, 3.0)
    stamp, frame, p = decoders.decode_cloud(ouster(5, [(1, 2, 3), (4, 5, 6)], [100, 5000]))
    assert (stamp, frame) == (5, "f") and p["t_offset_ns"].tolist() == [100, 5000] and p["ring"].tolist() == [0, 1] and p["intensity"].tolist() == [900, 900]
    t = 1_600_000_000
    rows = [struct.pack("<fffdH", *q, t + s, 3) for q, s in (((1, 2, 3), 100e-9), ((4, 5, 6), 0.05), ((7, 8, 9), -1.0))]
    hesai = cloud_message(t * 10**9, [("x", 0, 7), ("y", 4, 7), ("z", 8, 7), ("timestamp", 12, 8), ("ring", 20, 4), ("odd", 0, 77)], rows, 22)
    p = decoders.decode_cloud(hesai, decoders.ABSOLUTE_SECONDS)[2]
    assert np.abs(p["t_offset_ns"] - [100, 50_000_000, 0]).max() < 250 and not p["intensity"].any()
    livox = header(9) + struct.pack("<QIB3B", 77, 2, 0, 0, 0, 0) + u32(2) + struct.pack("<IfffBBB", 200, 1, 2, 3, 50, 0, 4) + struct.pack("<IfffBBB", 123_456, 4, 5, 6, 60, 0, 5)
    p = decoders.decode_livox(livox)[2]
    assert p["t_offset_ns"].tolist() == [200, 123_456] and p["ring"].tolist() == [4, 5] and p["x"].tolist() == [1, 4] and p["intensity"].tolist() == [50, 60]
    with pytest.raises(bag.BadBag):
        decoders.decode_imu(imu_message(1)[:80])


def test_parameters(tmp_path):
    file, warnings = tmp_path / "p.yaml", []
    file.write_text("lidar_time_offset_sec: 0\ninit: {imu_count: 50, typo: 1}\nmap: {crop: {enabled: false, odd: 2}}\nnew: 3\nextrinsic: {translation: [1, 2, 3], rotation: [0, -1, 0, 1.01, 0, 0, 0, 0, 1]}\n")
    p = load_params(file, warnings)
    assert p.init.imu_count == 50 and p.init.theta_std == Params().init.theta_std and not p.map.crop.enabled and p.lidar_time_offset_sec == 0.0
    assert sorted(w.split("'")[1] for w in warnings) == ["init.typo", "map.crop.odd", "new"]
    assert np.allclose(p.extrinsic.matrix(), [[0, -1, 0], [1, 0, 0], [0, 0, 1]], atol=1e-9) and p.extrinsic.translation == (1.0, 2.0, 3.0)
    for text, key in (("init: {imu_count: many}", "imu_count"), ("extrinsic: {rotation: [1, 2]}", "rotation"), ("iekf: {reject_outliers: 3.5}", "reject_outliers"), ("[1]", "mapping"), ("a: [", "parse")):
        file.write_text(text)
        with pytest.raises(ValueError, match=key):
            load_params(file)
    with pytest.raises(FileNotFoundError):
        load_params(tmp_path / "none.yaml")


def _matrix(key, shift):
    return f"{key}: !!opencv-matrix\n  rows: 4\n  cols: 4\n  dt: d\n  data: [1, 0, 0, {shift[0]}, 0, 1, 0, {shift[1]}, 0, 0, 1, {shift[2]}, 0, 0, 0, 1]\n"


def _folder(tmp_path, imu=True):
    d = tmp_path / "run_01"
    d.mkdir()
    if imu:
        (d / "imu_v100.yaml").write_text("%YAML:1.0\n---\nimu_topic: /imu/imu\n" + _matrix("T_Body_Imu", (0.1, 0, 0)) + "accel_std: 0.1\naccel_rw: 0.2\ngyro_std: 0.3 # noise\ngyro_std: 0.4\n")
    (d / "lidar_horz.yaml").write_text("%YAML:1.0\npointcloud_topic: /os1\nVERT_RES: 16\nHORZ_RES: 1024\n" + _matrix("T_Body2Lidar", (0.1, 0, 0)))
    (d / "leica_prism.yaml").write_text("%YAML:1.0\ngndtr_topic: /leica\n" + _matrix("T_Body_Prism", (0.3, 0, 0.2)))
    return d


def test_calibration_and_layouts(tmp_path):
    d = _folder(tmp_path)
    imu = calibration.load_imu(d / "imu_v100.yaml")
    assert (imu.gyro_noise_std, imu.gyro_rw_std, imu.accel_rw_std) == (0.3, 0.4, 0.2)
    s = loaders.open_sequence("NTU_VIRAL", d, Params())
    assert (s.lidar_topic, s.truth_topic, s.bag.name) == ("/os1", "/leica", "run_01.bag") and np.allclose(s.extrinsic[1], 0) and np.allclose(s.lever, [0.2, 0, 0.2])
    with pytest.raises(ValueError, match="unknown format"):
        loaders.open_sequence("OTHER", d, Params())
    write_bag(d / "x.bag", [("/livox/imu", 1, b"")])
    assert loaders.open_sequence("FAST_LIVO2", d, Params()).accel_scale == loaders.G
    assert loaders.open_sequence("HILTI_22", d, Params()).lidar_topic == "/hesai/pandar"


def test_command_line_replays_a_recording(spark, tmp_path):
    d, points = _folder(tmp_path, imu=False), room()
    offsets = np.linspace(0, 99_000_000, len(points)).astype(int)
    messages = [("/imu/imu", k * 5_000_000, imu_message(k * 5_000_000, (0, 0, 0), (0, 0, 9.81))) for k in range(1, 160)]
    messages += [("/os1", 400_000_000 + k * 100_000_000, ouster(400_000_000 + k * 100_000_000, points, offsets)) for k in range(3)]
    messages += [("/leica", k * 100_000_000, pose_message(k * 100_000_000)) for k in range(5)]
    write_bag(d / "run_01.bag", messages, "lz4", per_chunk=40)
    (tmp_path / "p.yaml").write_text("lidar_time_offset_sec: 0.0\ninit: {imu_count: 60, gravity_magnitude: 9.81}\npreprocess: {scan_voxel_leaf: 0.25}\n")
    out = tmp_path / "out"
    assert cli.main(["--format", "NTU_VIRAL", "--sequence", str(d), "--params", str(tmp_path / "p.yaml"), "--output", str(out)]) == 0
    rows = tum.read(spark, str(out / "trajectory.tum")).orderBy("t_sec").collect()
    assert [round(r.t_sec, 3) for r in rows] == [0.499, 0.599, 0.699]
    assert max(abs(v) for r in rows for v in (r.tx, r.ty, r.tz)) < 0.05
    moved = tum.read(spark, str(out / "estimate_gt.tum")).collect()
    assert all(abs(r.tx - 0.3) < 0.05 and abs(r.tz - 0.2) < 0.05 and r.qw == 1.0 for r in moved)
    assert tum.read(spark, str(out / "gt.tum")).count() == 5
    tum.project(spark, str(out / "trajectory.tum"), (1.0, 0, 0), str(tmp_path / "moved"))
    assert all(abs(r.tx - 1.0) < 0.05 for r in tum.read(spark, str(tmp_path / "moved")).collect())
    with pytest.raises(SystemExit):
        cli.main(["--format", "NTU_VIRAL", "--sequence", str(tmp_path / "none"), "--params", "p"])


def test_lines_round_as_printf_does(spark):
    """Halves go to the even neighbour, and only exact ones are halves; no line for a pose that lacks a value."""
    values = [0.4345703125, 0.0009765625, 0.1234567895, 123456789.1234567895, -0.0, float("nan"), float("-inf"), None]
    poses = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "t_ns long, px double")
    rows = tum.lines(poses.selectExpr("t_ns", "px", "px AS py", "px AS pz", "1.0D AS qw", "px AS qx", "px AS qy", "px AS qz"), keep=("t_ns",)).collect()
    with duckdb.connect() as db:
        want = {k: v is not None and db.execute("SELECT printf('%.9f', CAST(? AS DOUBLE))", [v]).fetchone()[0] for k, v in enumerate(values)}
    assert {r.t_ns: r.line and r.line.split(" ")[1] for r in rows} == {k: v or None for k, v in want.items()}
