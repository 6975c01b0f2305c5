"""Token-id files: documents in id order as checksummed blocks of the context-mixing range coder."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.chunks import SLICE_CHARS
from tessera.llm.common import documents, lean, slices, whole_text, written
from tessera.llm.idcoder import Corrupt, decode_block, encode_block
from tessera.llm.library_tokenizer import encoder

END_ID = 2
#: A block ends with the document that brings it to this many ids.
BLOCK_IDS = 1 << 21
MAGIC = b"TIDS"
#: Magic, documents, ids before the block within its file; a checksum of these and the directory.
_HEAD, _CHECK = struct.Struct("<4sIQ"), struct.Struct("<I")

FILES = "file int, block int, n_ids long, data binary"


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, start: int, ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: its head, a directory (per document a null flag, its id and length), the coded ids."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    directory = null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes()
    head = _HEAD.pack(MAGIC, len(doc_ids), start)
    return head + _CHECK.pack(zlib.crc32(directory, zlib.crc32(head))) + directory + encode_block(ids, vocabulary)


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, int, np.ndarray]:
    """What pack_block was given; Corrupt if a checksum fails."""
    magic, n, start = _HEAD.unpack_from(data)
    at = _HEAD.size + _CHECK.size
    directory = data[at : at + 13 * n]
    if magic != MAGIC or (zlib.crc32(directory, zlib.crc32(data[: _HEAD.size])),) != _CHECK.unpack_from(data, _HEAD.size):
        raise Corrupt("a block's directory is damaged")
    null = np.frombuffer(directory, np.uint8, n)
    numbers = np.frombuffer(directory, "<i8", n, n).tolist()
    lengths = np.frombuffer(directory, "<u4", n, 9 * n).astype(np.int64)
    ids = decode_block(data[at + 13 * n :])
    if len(ids) != lengths.sum():
        raise Corrupt("a block's directory and ids differ in length")
    return [None if z else d for z, d in zip(null.tolist(), numbers, strict=True)], lengths, start, ids


def write_token_files(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, vocabulary: int | None = None) -> DataFrame:
    """The written file table (file, block, n_ids, data): one file per range of ascending ids, blocks in order.

    The texts are dealt out by ranges of doc_id and a hash of the text, one shuffle, and sorted there; ids come from
    the `tokenizers` file at path, and each document ends with end_id. Blocks are independent: each starts with an empty model and
    carries its own checksums, so one that is lost or damaged costs no other. The table lies in the shared
    folder under Spark's commit protocol. A null text counts as empty; null ids come first; rows of one id, of
    which no task gets all, follow by their texts' hashes; repeated rows each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(path), TaskContext.get().partitionId()
        size = vocabulary or max(end_id + 1, _vocabulary(path))
        numbers: list[int | None] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = start = block = 0

        def emit() -> pa.RecordBatch:
            nonlocal held, start, block
            data = pack_block(numbers, np.concatenate(lengths), start, np.concatenate(parts), size)
            row = [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            start, block, held = start + held, block + 1, 0
            numbers.clear(), lengths.clear(), parts.clear()
            return pa.RecordBatch.from_arrays(row, ["file", "block", "n_ids", "data"])

        for b in slices(batches, limit=SLICE_CHARS):
            ids, stops = encode(b.column(1).to_pylist())
            size_ = np.diff(stops) + 1
            out = np.full(int(size_.sum()), end_id, np.int32)
            inside = np.ones(len(out), bool)
            inside[np.cumsum(size_) - 1] = False
            out[inside] = ids
            numbers += b.column(0).to_pylist()
            lengths.append(size_)
            parts.append(out)
            held += len(out)
            if held >= BLOCK_IDS:
                yield emit()
        if held:
            yield emit()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")
    rows = rows.select("doc_id", "text")
    return written(rows.mapInArrow(lean(run), FILES), "token-files")


def _vocabulary(path: str) -> int:
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max(chain(spec["model"]["vocab"].values(), (t["id"] for t in spec["added_tokens"]))) + 1


#: Files whose totals are summed up in one task; as many sums again make one task's next level.
FILES_A_GROUP = 512


def _bases(files: DataFrame) -> DataFrame:
    """file and base, the ids of all files before it, as a written table: running sums within groups of files and
    over the groups' totals. Spark broadcasts it only below its own bound of size."""
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n")).withColumn("part", F.floor(F.col("file") / FILES_A_GROUP))
    groups = totals.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("part"), before.alias("before"))
    within = F.coalesce(F.sum("n").over(W.partitionBy("part").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = totals.withColumn("within", within).join(groups, "part")
    return written(rows.select("file", (F.col("before") + F.col("within")).alias("base")), "token-bases")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files alone: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. A damaged block fails its task."""
    before = _bases(files)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                numbers, lengths, start, ids = unpack_block(data.as_py())
                stops = np.cumsum(lengths)
                wire = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(wire[4 * (e - n) : 4 * e]) for e, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                arrays = [pa.array(numbers, pa.int64()), pa.array(first + start + stops - lengths), pa.array(lengths), pa.array(crcs, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(0, stops), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = files.join(before, "file").select("base", "data")
    return rows.mapInArrow(lean(run), READ + ", ids array<int>" * with_ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(documents(spark, sf_dir), default_path()))
