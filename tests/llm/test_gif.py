import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import gif


def lzw(samples, min_size, clear_at=4096):
    """A plain LZW encoder with a growing table."""
    clear, bits, out = 1 << min_size, [], bytearray()

    def put(code, width):
        bits.extend(code >> k & 1 for k in range(width))

    table, width = {(i,): i for i in range(clear)}, min_size + 1
    size = clear + 2
    put(clear, width)
    prefix = ()
    for s in samples:
        if (*prefix, s) in table:
            prefix = (*prefix, s)
            continue
        put(table[prefix], width)
        if size < 4096:
            if size == 1 << width and width < 12:
                width += 1
            table[(*prefix, s)] = size
            size += 1
        if size >= clear_at:
            if size == 1 << width and width < 12:
                width += 1
            put(clear, width)
            table, width, size = {(i,): i for i in range(clear)}, min_size + 1, clear + 2
        prefix = (s,)
    if prefix:
        put(table[prefix], width)
        if size == 1 << width and width < 12 and size < 4096:
            width += 1
    put(clear + 1, width)
    for i in range(0, len(bits), 8):
        out.append(sum(b << k for k, b in enumerate(bits[i : i + 8])))
    return bytes(out)


def test_lzw_streams_round_trip():
    rng = random.Random(1)
    for min_size in (2, 4, 8):
        for n in (1, 2, 7, 600, 9000):
            for top in (1, 2, (1 << min_size) - 1):
                samples = [rng.randint(0, top) for _ in range(n)]
                for clear_at in (4096, 40 + (1 << min_size), 10_000):
                    assert gif.lzw_decode(lzw(samples, min_size, clear_at), min_size) == bytes(samples)


def test_own_streams_equal_the_plain_encoder():
    rng = np.random.default_rng(1)
    words = " ".join(rng.choice(["the", "house", "on", "a", "hill", "stood"], 9000)).encode()
    for x in (b"", b"a", b"aa", b"a" * 9000, words, rng.integers(0, 256, 30_000).astype(np.uint8).tobytes()):
        assert gif.lzw_decode(gif.lzw_encode(x), 8) == x
        if x and len(x) < 5000:
            assert gif.lzw_encode(x) == lzw(x, 8)
    x = rng.integers(0, 4, 20_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(x, 2), 2) == x
    assert gif.lzw_encode(b"abab" * 600) == lzw(b"abab" * 600, 8)


def test_prose_gets_smaller():
    text = b"It was the best of times, it was the worst of times, it was the age of wisdom. " * 60
    payload = gif.padded(text)
    media = gif.encode_gif(payload)
    assert len(media) < 0.5 * len(payload)


def test_a_canvas_or_frame_that_is_too_large_is_refused():
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6) + b"\x3b"
    with pytest.raises(gif.BadGif):
        list(gif.decode_gif(head))
    frame = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\0\x3b"
    with pytest.raises(gif.BadGif):
        list(gif.decode_gif(frame))
    empty = b"GIF89a" + struct.pack("<HHBBB", 0, 0, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 0, 0, 0) + b"\x02\0\x3b"
    (f,) = gif.decode_gif(empty)
    assert f.pixels.size == 0 and gif.histograms(f.pixels)[0] == [0] * 16


def _file(frames, size=(4, 4), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + bytes(c for p in palette for c in p)
    for left, top, w, h, samples, delay, disposal, clear, extra in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0"
        data = lzw(samples, 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, extra) + b"\x02" + bytes((len(data),)) + data + b"\0"
    return out + b"\x3b"


def test_transparency_and_disposal():
    whole, dot = [1] * 16, [2, 0, 0, 3]
    frames = list(gif.decode_gif(_file([(0, 0, 4, 4, whole, 5, 1, None, 0), (1, 1, 2, 2, dot, 6, 3, 0, 0), (0, 0, 1, 1, [3], 7, 2, None, 0), (3, 3, 1, 1, [2], 8, 0, None, 0)])))
    assert [f.delay_cs for f in frames] == [5, 6, 7, 8]
    assert frames[1].pixels[1, 1].tolist() == [0, 255, 0, 255] and frames[1].pixels[1, 2].tolist() == [255, 0, 0, 255]
    assert frames[2].pixels[1, 1].tolist() == [255, 0, 0, 255] and frames[2].pixels[0, 0].tolist() == [0, 0, 255, 255]
    assert frames[3].pixels[0, 0].tolist() == [0, 0, 0, 0] and frames[3].pixels[3, 3].tolist() == [0, 255, 0, 255]


def test_interlaced_rows():
    rows = [[y % 4] * 4 for y in range(9)]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    (f,) = gif.decode_gif(_file([(0, 0, 4, 9, [x for y in order for x in rows[y]], 1, 0, None, 0x40)], size=(4, 9)))
    want = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)]
    assert [tuple(f.pixels[y, 0, :3].tolist()) for y in range(9)] == [want[y % 4] for y in range(9)]


def test_damaged_files():
    whole = gif.encode_gif(b"x" * 576)
    for cut in (0, 5, 20, len(whole) - 30, len(whole) - 1):
        with pytest.raises(gif.BadGif):
            list(gif.decode_gif(whole[:cut]))


def test_frames_table(spark):
    media = spark.createDataFrame([(1, bytearray(gif.encode_gif(b"\x10" * 576 * 65)), 1), (None, None, 2), (2, bytearray(b"GIF"), 3)], "media_id long, media binary, frame int")
    rows = sorted(gif.decode_frames(media).collect(), key=lambda r: (r.media_id or 0, r.frame or 0))
    assert [(r.media_id, r.frame, r.start_cs, r.error is None) for r in rows] == [(None, None, 0, False), (1, 0, 0, True), (1, 1, 10, True), (2, None, 0, False)]
    assert rows[1].hist_red == [0, 576 * 64] + [0] * 14
    assert gif.decode_frames(media.limit(0)).collect() == []


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = gif.op3_gif(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        counts = [sum(payload.count(bytes((16 * k + i,))) for i in range(16)) for k in range(16)]
        assert r.hist_red == r.hist_green == r.hist_blue == counts
        assert r.feature == "red16:" + ",".join(map(str, counts))
        assert r.frame_start_cs == [10 * i for i in range(-(-len(payload) // (576 * 64)))] and r.duration_cs == 10 * r.n_frames
    stored = {r.doc_id: bytes(r.media) for r in gif.store_texts(docs).collect()}
    for r in rows:
        media = stored[r.doc_id]
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert sum(map(len, stored.values())) < sum(r.payload_bytes for r in rows)
    some = docs.filter("doc_id < 40").select("doc_id", "n_chars")
    frames = gif.decode_frames(gif.store_texts(docs).join(some, "doc_id"), "doc_id").collect()
    for d in {f.media_id for f in frames}:
        mine = sorted((f for f in frames if f.media_id == d), key=lambda f: f.frame)
        assert b"".join(bytes(f.rgba)[::4] for f in mine)[: len(texts[d].encode())] == texts[d].encode()
    empty = gif.media_digests(gif.store_texts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).collect()
    assert {(r.n_bytes, r.payload_bytes, r.n_frames) for r in empty} == {(0, 576, 1)}
    assert len({r.media_sha256 for r in empty}) == 1
