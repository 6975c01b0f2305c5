"""Harmonic packing of token sequences into rows of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import SLICE_CHARS
from tessera.llm.common import documents, lean, slices, whole_text
from tessera.llm.library_tokenizer import encoder

CAPACITY, END_ID = 2048, 1
#: A remainder stays whole if a bin full of its like is filled to this share.
FILL = 0.98
#: Sequence ids: the worker's partition in the high bits, its own count in the low ones.
WORKER_BITS = 40


class Piece(NamedTuple):
    doc: int
    start: int
    length: int


def cut(length: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of a document's pieces: whole rows first, then parts that nearly fill their harmonic class.

    Class k holds lengths in (capacity / (k + 1), capacity / k]; its bins take k pieces. A remainder for which k
    pieces fill a bin well stays whole, else a part of the next class's full length is cut off first.
    """
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        part = rest if k * rest >= fill * capacity else capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


def _powers(length: int) -> list[int]:
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class HarmonicPacker:
    """Fills bins of each class with a fixed number of pieces as they come; finish() packs what is left over."""

    def __init__(self, capacity: int = CAPACITY, fill: float = FILL):
        self.capacity, self.fill = capacity, fill
        self.open: dict[int, list[Piece]] = {}
        self.sequences = 0

    def add(self, doc: int, length: int) -> Iterator[tuple[Piece, int, int]]:
        """(piece, sequence, offset) of every bin that this document's pieces complete."""
        start = 0
        for n in cut(length, self.capacity, self.fill):
            k = self.capacity // n
            held = self.open.setdefault(k, [])
            held.append(Piece(doc, start, n))
            start += n
            if len(held) == k:
                yield from self._emit(self.open.pop(k))

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.sequences, offset
            offset += p.length
        self.sequences += 1

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        """Bins that lack pieces: laid end to end and cut at the capacity; the last, short stretch is cut into
        powers of two, which need no padding."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(p.length for p in left)
        sizes = [self.capacity] * (total // self.capacity) + _powers(total % self.capacity)
        parts = iter(left)
        piece = next(parts, None)
        for size in sizes:
            row, room = [], size
            while room:
                n = min(room, piece.length)
                row.append(piece._replace(length=n))
                room -= n
                piece = Piece(piece.doc, piece.start + n, piece.length - n) if n < piece.length else next(parts, None)
            yield from self._emit(row)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids
    (little-endian unsigned 32-bit). A document is its ids and then end_id, so a null or empty text has one id.

    Workers pack their own rows without a shuffle: a worker keeps the pieces of unfinished bins only, at most
    k of each class k. A repeated row is packed again; null ids stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), HarmonicPacker(capacity)
        base = TaskContext.get().partitionId() << WORKER_BITS
        waiting: dict[int, tuple] = {}  # of documents with pieces in open bins
        count = 0

        def rows(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
            docs_, crcs, ids = [], [], []
            for p, _, _ in placed:
                entry = waiting[p.doc]
                part = entry[1][4 * p.start : 4 * (p.start + p.length)]
                docs_.append(entry[0])
                crcs.append(zlib.crc32(part))
                ids.append(part if with_ids else None)
            lengths = [p.length for p, _, _ in placed]
            out = [
                pa.array(docs_, pa.int64()),
                pa.array([p.start for p, _, _ in placed], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array(crcs, pa.int64()),
                pa.array([len(waiting[p.doc][1]) // 4 for p, _, _ in placed], pa.int64()),
                pa.array([base + s for _, s, _ in placed], pa.int64()),
                pa.array([o for _, _, o in placed], pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            for p, _, _ in placed:
                entry = waiting[p.doc]
                entry[2][0] -= p.length
            for d in {p.doc for p, _, _ in placed}:
                if not waiting[d][2][0]:
                    del waiting[d]
            return pa.RecordBatch.from_arrays(out, NAMES)

        for b in slices(batches, limit=SLICE_CHARS // 2):
            ids, ends = encode(b.column(1).to_pylist())
            stops = ends.tolist()
            placed = []
            for i, d in enumerate(b.column(0).to_pylist()):
                part = np.append(ids[stops[i] : stops[i + 1]], np.int32(end_id)).astype("<u4").tobytes()
                n = len(part) // 4
                waiting[count] = (d, part, [n])
                placed += packer.add(count, n)
                count += 1
            if placed:
                yield rows(placed)
        last = list(packer.finish())
        if last:
            yield rows(last)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    packed = given.mapInArrow(lean(run), SCHEMA)
    return packed if with_ids else packed.drop("ids")


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_path(), with_ids=False)
