"""Animated GIFs as a media column: written from bytes, decoded to timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, slices, whole_text

#: Payloads are multiples of one tile; a frame is this wide and holds at most so many tiles.
WIDTH, TILE, FRAME_TILES, FILLER = 24, 576, 64, 255
DELAY_CS = 10
HISTOGRAM_BINS = 16
#: Pixels of the largest canvas that is decoded: a file's head alone may ask for 17 GB.
MOST_PIXELS = 1 << 24
_MOST_CODES = 4096
_GRAY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


class BadGif(ValueError):
    """Bytes that are no complete GIF."""


@dataclass
class Frame:
    delay_cs: int
    pixels: np.ndarray  # height x width x (red, green, blue, alpha), the whole canvas
    left: int
    top: int
    width: int
    height: int


# --- LZW -------------------------------------------------------------------------------------------------------


@lru_cache
def _layout(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offsets and widths of the first codes after a clear code, as far as the table grows: the width follows from
    the entries that the codes before have added."""
    entries = (1 << min_size) + 2 + np.maximum(0, np.arange(_MOST_CODES) - 1)
    width = np.clip(np.frexp(entries.astype(np.float64))[1], min_size + 1, 12).astype(np.int64)
    return np.cumsum(width) - width, width


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """samples (each below 2**min_size) as an LZW stream: the longest known string each time, a clear code whenever
    the table is full."""
    clear, first = 1 << min_size, (1 << min_size) + 2
    codes, ends = [clear], [0]  # ends: the places of clear codes
    table: dict[int, int] = {}
    size, prefix = first, -1
    for s in samples:
        key = prefix << 8 | s
        known = table.get(key) if prefix >= 0 else s
        if known is not None:
            prefix = known
            continue
        codes.append(prefix)
        table[key] = size
        size += 1
        prefix = s
        if size == _MOST_CODES:
            ends.append(len(codes))
            codes.append(clear)
            table, size = {}, first
    codes += [prefix, clear + 1] if prefix >= 0 else [clear + 1]
    # a stretch is what follows a clear code up to and with the next one; before the first lies that code alone
    _, widths = _layout(min_size)
    lengths = np.diff([*ends, len(codes) - 1])
    width = np.concatenate([[min_size + 1], *(widths[:n] for n in lengths.tolist())])
    bits = np.array(codes, np.uint16)[:, None] >> np.arange(12, dtype=np.uint16) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _stretches(data: bytes, min_size: int) -> Iterator[list[int]]:
    """The codes between clear codes, cut out in array operations, as a code's width depends only on its place."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    raw = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, pos, held = 8 * len(data), 0, []
    offset, width = _layout(min_size)
    while True:
        fits = int(np.searchsorted(offset + width, total - pos, "right"))
        if not fits:
            break
        at = pos + offset[:fits]
        codes = (words[at >> 3] >> (at & 7).astype(np.uint32)) & ((1 << width[:fits]) - 1).astype(np.uint32)
        special = np.flatnonzero((codes == clear) | (codes == end))
        if not len(special):  # the table has reached its end without a clear code
            held += codes.tolist()
            pos += int(offset[fits - 1] + width[fits - 1])
            width = np.full(_MOST_CODES, 12)
            offset = 12 * np.arange(_MOST_CODES)
            continue
        k = int(special[0])
        yield held + codes[:k].tolist()
        if codes[k] == end:
            return
        pos += int(offset[k] + width[k])
        held = []
        offset, width = _layout(min_size)
    yield held


def _expand(codes: list[int], clear: int) -> bytes:
    """The samples of one stretch of codes, by the growing table."""
    table = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out, last, size = [], b"", clear + 2
    for c in codes:
        if c < size:
            now = table[c]
        elif c == size and last:
            now = last + last[:1]
        else:
            raise BadGif("an LZW code is out of range")
        if last and size < _MOST_CODES:
            table.append(last + now[:1])
            size += 1
        out.append(now)
        last = now
    return b"".join(out)


def lzw_decode(data: bytes, min_size: int, most: int | None = None) -> bytes:
    """Samples of any GIF LZW stream; once `most` are there, the rest is left."""
    if not 2 <= min_size <= 8:
        raise BadGif("LZW code size")
    out, n = [], 0
    for codes in _stretches(data, min_size):
        out.append(_expand(codes, 1 << min_size))
        n += len(out[-1])
        if most is not None and n >= most:
            break
    return b"".join(out)[:most]


# --- container -------------------------------------------------------------------------------------------------


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    grid = np.full((whole, 256), 255, np.uint8)
    grid[:, 1:] = np.frombuffer(data, np.uint8, 255 * whole).reshape(whole, 255)
    rest = data[255 * whole :]
    return grid.tobytes() + (bytes((len(rest),)) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes) -> bytes:
    """payload (a multiple of TILE bytes) as grey samples of a GIF with one frame per FRAME_TILES tiles."""
    step = TILE * FRAME_TILES
    height = min(len(payload), step) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), _GRAY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for start in range(0, len(payload), step):
        part = payload[start : start + step]
        out += [
            b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0",
            b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0),
            b"\x08",
            _sub_blocks(lzw_encode(part)),
        ]
    return b"".join([*out, b"\x3b"])


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The composed frames of a GIF: palettes, transparency, interlacing and disposal applied. Canvases and frames of
    more than MOST_PIXELS are refused as damaged."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        part = data[at : at + n]
        if len(part) < n:
            raise BadGif("the file ends early")
        at += n
        return part

    def palette(flags: int) -> np.ndarray | None:
        return np.frombuffer(take(3 << (flags & 7) + 1), np.uint8).reshape(-1, 3) if flags & 0x80 else None

    def blocks() -> bytes:
        parts = []
        while n := take(1)[0]:
            parts.append(take(n))
        return b"".join(parts)

    if take(6) not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF signature")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", take(7))
    common = palette(flags)
    if high * wide > MOST_PIXELS:
        raise BadGif("a canvas of too many pixels")
    canvas = np.zeros((high, wide, 4), np.uint8)
    delay, disposal, clear_index = 0, 0, -1
    while True:
        kind = take(1)[0]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = take(1)[0]
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else -1
            continue
        if kind != 0x2C:
            raise BadGif("an unknown block")
        left, top, width, height, flags = struct.unpack("<HHHHB", take(9))
        colours = palette(flags)
        colours = common if colours is None else colours
        if colours is None:
            raise BadGif("a frame without a palette")
        min_size = take(1)[0]
        if width * height > MOST_PIXELS:
            raise BadGif("a frame of too many pixels")
        samples = np.frombuffer(lzw_decode(blocks(), min_size, width * height), np.uint8)
        if len(samples) < width * height:
            samples = np.append(samples, np.zeros(width * height - len(samples), np.uint8))
        image = samples.reshape(height, width)
        if flags & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]
            straight = np.empty_like(image)
            straight[order] = image
            image = straight
        seen = image[: max(0, high - top), : max(0, wide - left)]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        shown = np.minimum(seen, len(colours) - 1)
        if clear_index < 0:
            area[:, :, :3], area[:, :, 3] = colours[shown], 255
        else:
            drawn = seen != clear_index
            area[drawn] = np.append(colours[shown[drawn]], np.full((int(drawn.sum()), 1), 255, np.uint8), 1)
        yield Frame(delay, canvas.copy(), left, top, width, height)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, -1


def histograms(pixels: np.ndarray) -> list[list[int]]:
    """Per channel the pixels of each of HISTOGRAM_BINS equal bins; transparent pixels are left out."""
    solid = pixels[pixels[:, :, 3] > 0]
    return [np.bincount(solid[:, c] // (256 // HISTOGRAM_BINS), minlength=HISTOGRAM_BINS).tolist() for c in range(3)]


_COUNTS = "hist_red array<long>, hist_green array<long>, hist_blue array<long>"
FRAMES = f"media_id long, frame int, start_cs long, delay_cs int, width int, height int, rgba binary, {_COUNTS}, error string"
#: Bytes of pixels that leave a worker in one batch, one frame at least.
BATCH_BYTES = 8_000_000


def timed_frames(blob: bytes) -> Iterator[tuple[int, int, Frame, list[list[int]]]]:
    """Of each frame of a GIF its number, its start in hundredths of a second, itself and its colour histograms."""
    start = 0
    for number, f in enumerate(decode_gif(blob)):
        yield number, start, f, histograms(f.pixels)
        start += f.delay_cs


def decode_frames(media: DataFrame, media_id: str = "media_id", data: str = "media") -> DataFrame:
    """One row per frame of every GIF: its time, size, RGBA pixels and colour histograms.

    Bytes that are no GIF, null or cut short give one row with `error` after the frames that could be read.
    Null ids and repeated rows stay; a GIF without frames has none. Workers hold one GIF's canvas at a time.
    """
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), longs, longs, longs, pa.string()]
    names = [x.split()[0] for x in FRAMES.split(", ")]

    def rows(media_id_: int | None, blob: bytes | None) -> Iterator[tuple]:
        end = 0
        try:
            if blob is None:
                raise BadGif("no bytes")
            for number, start, f, counts in timed_frames(blob):
                yield media_id_, number, start, f.delay_cs, f.pixels.shape[1], f.pixels.shape[0], f.pixels.tobytes(), *counts, None
                end = start + f.delay_cs
        except BadGif as e:
            yield media_id_, None, end, *[None] * 7, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            nonlocal size
            columns = [pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            for number, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in rows(number, blob.as_py()):
                    held.append(row)
                    size += len(row[6] or b"")
                    if size > BATCH_BYTES:
                        yield emit()
        if held:
            yield emit()

    return media.select(F.col(media_id).cast("long").alias("media_id"), F.col(data).alias("media")).mapInArrow(run, FRAMES)


def padded(text: bytes) -> bytes:
    """text and filler up to a positive multiple of TILE."""
    return text + bytes((FILLER,)) * (max(1, -(-len(text) // TILE)) * TILE - len(text))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and each whole text as a GIF. A null text counts as empty; null ids and repeated rows stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [t.encode() for t in b.column(1).to_pylist()]
            media = pa.array([encode_gif(padded(x)) for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    f"n_frames int, duration_cs long, frame_start_cs array<long>, {_COUNTS}"
)


def media_digests(stored: DataFrame) -> DataFrame:
    """Reads store_texts' GIFs back, frame by frame: digests of the payload, which is the red channel of each frame's
    own rectangle, and of the file; when each frame starts; colour histograms over all frames, whose red one is the
    feature as text."""

    def one(blob: bytes) -> tuple:
        payload, tail, size, time = hashlib.sha256(), b"", 0, 0
        counts, starts = np.zeros((3, HISTOGRAM_BINS), np.int64), []
        for _, start, f, found in timed_frames(blob):
            part = f.pixels[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
            payload.update(part)
            tail, size, time = (tail + part)[-32:], size + len(part), start + f.delay_cs
            starts.append(start)
            counts += found
        feature = f"red{HISTOGRAM_BINS}:" + ",".join(map(str, counts[0].tolist()))
        return size, payload.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(), feature, len(starts), time, starts, *counts.tolist()

    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), longs, longs, longs, longs]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x.as_py()) for x in b.column(2)]
            arrays = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names)

    return stored.mapInArrow(run, DIGEST)


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(store_texts(documents(spark, sf_dir)))
