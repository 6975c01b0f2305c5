"""A Spark data source for ROS bag files (format 2.0): one partition per chunk, topic filters pushed into the scan.

spark.dataSource.register(BagDataSource); spark.read.format("rosbag").load(path) gives topic, stamp_ns (the record's own
time), chunk, place (together the file's order) and data. The files must be on a path every executor can open.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Fixed values of the format: first line, operation codes.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7

SCHEMA = "topic string, stamp_ns bigint, chunk int, place int, data binary"


class BadBag(ValueError):
    """A file that is no complete bag."""


class Cursor:
    """Bounds-checked reads from a buffer."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.data, self.at = memoryview(data), at

    def remaining(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> memoryview:
        if n < 0 or n > self.remaining():
            raise BadBag(f"{n} bytes wanted, {self.remaining()} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, layout: str):
        values = struct.unpack("<" + layout, self.take(struct.calcsize("<" + layout)))
        return values[0] if len(values) == 1 else values

    def string(self) -> str:
        return bytes(self.take(self.read("I"))).decode("utf-8", "replace")


def fields(header: bytes | memoryview) -> dict[str, bytes]:
    """The name=value fields of a record header."""
    out, c = {}, Cursor(header)
    while c.remaining():
        name, found, value = bytes(c.take(c.read("I"))).partition(b"=")
        if not found:
            raise BadBag("a header field without '='")
        out[name.decode("utf-8", "replace")] = value
    return out


def records(c: Cursor) -> Iterator[tuple[dict[str, bytes], memoryview]]:
    while c.remaining():
        header = fields(c.take(c.read("I")))
        yield header, c.take(c.read("I"))


def _int(header: dict[str, bytes], name: str) -> int:
    if name not in header:
        raise BadBag(f"a record without {name}")
    return int.from_bytes(header[name], "little")


def _exactly(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise BadBag("a record ends early")
    return data


def _record(f) -> tuple[dict[str, bytes], bytes] | None:
    """The next record of an open file, None at its end."""
    size = f.read(4)
    if not size:
        return None
    if len(size) < 4:
        raise BadBag("a record ends early")
    header = fields(_exactly(f, int.from_bytes(size, "little")))
    return header, _exactly(f, int.from_bytes(_exactly(f, 4), "little"))


@dataclass
class Catalog:
    topics: dict[int, str]
    chunks: list[int]


def catalog(path: str) -> Catalog:
    """The index at a bag's end: topics by connection number, and where chunks begin, in the file's order."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise BadBag(f"{path}: not a version 2.0 bag")
        first = _record(f)
        if first is None or _int(first[0], "op") != HEADER:
            raise BadBag(f"{path}: no bag header")
        index = _int(first[0], "index_pos")
        if not index:
            raise BadBag(f"{path}: not indexed (it was not closed properly)")
        f.seek(index)
        found = Catalog({}, [])
        while (r := _record(f)) is not None:
            op = _int(r[0], "op")
            if op == CONNECTION:
                found.topics[_int(r[0], "conn")] = r[0]["topic"].decode("utf-8", "replace")
            elif op == CHUNK_INFO:
                found.chunks.append(_int(r[0], "chunk_pos"))
        found.chunks.sort()
        return found


def inflate(data: bytes, compression: str, size: int) -> bytes:
    if compression == "none":
        return data
    if compression == "lz4":
        return pa.Codec("lz4").decompress(data, size).to_pybytes()
    raise BadBag(f"chunks compressed by {compression!r} are not supported")


def messages(path: str, position: int, topics: dict[int, str], wanted: frozenset[str] | None) -> Iterator[tuple[str, int, bytes]]:
    """(topic, stamp_ns, data) of a chunk's messages; payloads of other topics are passed over uncopied."""
    with open(path, "rb") as f:
        f.seek(position)
        record = _record(f)
    if record is None or _int(record[0], "op") != CHUNK:
        raise BadBag(f"{path}: no chunk at {position}")
    header, data = record
    keep = {k: t for k, t in topics.items() if wanted is None or t in wanted}
    for h, payload in records(Cursor(inflate(data, header["compression"].decode(), _int(header, "size")))):
        if _int(h, "op") == MESSAGE and (topic := keep.get(_int(h, "conn"))) is not None:
            secs, nsecs = struct.unpack("<II", h["time"])
            yield topic, secs * 1_000_000_000 + nsecs, bytes(payload)


@dataclass
class ChunkPartition(InputPartition):
    path: str
    position: int
    number: int
    topics: dict


class BagReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.wanted = paths, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes topic = x and topic in (...); all else stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self._narrow({f.value})
            elif isinstance(f, In) and f.attribute == ("topic",):
                self._narrow(set(f.value))
            else:
                yield f

    def _narrow(self, topics: set) -> None:
        self.wanted = frozenset(topics) if self.wanted is None else self.wanted & topics

    def partitions(self) -> list[ChunkPartition]:
        out = []
        for path in self.paths:
            found = catalog(path)
            if self.wanted is None or self.wanted & set(found.topics.values()):
                out += [ChunkPartition(path, p, i, found.topics) for i, p in enumerate(found.chunks)]
        return out

    def read(self, partition: ChunkPartition | None) -> Iterator[tuple]:
        if partition is None:  # no chunk is left
            return
        for place, (topic, stamp, data) in enumerate(messages(partition.path, partition.position, partition.topics, self.wanted)):
            yield topic, stamp, partition.number, place, data


class BagDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rosbag"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BagReader:
        path = Path(self.options["path"])
        return BagReader([str(p) for p in sorted(path.glob("*.bag"))] if path.is_dir() else [str(path)])


def find_bag(folder: str | Path) -> Path:
    """The only bag of a folder."""
    found = sorted(Path(folder).glob("*.bag"))
    if len(found) != 1:
        raise FileNotFoundError(f"{folder}: {len(found)} bags; expected one")
    return found[0]
