"""Byte-level BPE in batched numpy merge rounds, and its inverse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import SLICE_CHARS, ChunkEncoder, gather, text_of, utf8
from tessera.llm.common import documents, slices, whole_text

#: White space, as the split pattern means it; the split pattern of byte-level BPE.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
_FIND = regex.compile(PATTERN).findall
#: What a byte of UTF-8 may be: an ASCII letter or digit, another visible ASCII character, the first of a wider character
#: of white space, a space or line break, other white space.
_ALNUM, _MARK, _LEAD, _SPACE, _OTHER_SPACE = range(1, 6)
_WIDE_SPACE = np.array([int.from_bytes(c.encode().ljust(3, b"\0")) for c in map(chr, range(0x80, 0x3001)) if regex.fullmatch(f"[{SPACE}]", c)])
_KIND = bytearray(256)
for _i in range(33, 127):
    _KIND[_i] = _ALNUM if chr(_i).isalnum() else _MARK
for _i in range(9, 14):
    _KIND[_i] = _OTHER_SPACE
_KIND[10] = _KIND[32] = _SPACE
for _i in set((_WIDE_SPACE >> 16).tolist()):
    _KIND[_i] = _LEAD
#: Second bytes of the letters from U+00C0 to U+00FF, whose first is 0xC3.
_LATIN = np.isin(np.arange(256), [*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)])
_SHIFT = 20


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeModel:
    """The tables of a byte-level BPE file: pair keys in ascending order with their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], byte_chars()
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max(chain(vocab.values(), added.values())) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(to_byte[c] for c in token)
        for token, i in added.items():
            self.token_bytes[i] = token.encode()
        self.added = added
        self.first = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.first[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << _SHIFT) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        joins = np.zeros((256, 256), bool)  # two bytes that stand side by side within some token
        for t in self.token_bytes:
            b = np.frombuffer(t, np.uint8)
            joins[b[:-1], b[1:]] = True
        self.joins = joins
        self.encoder = ChunkEncoder(self.cut, self.encode_chunks)
        self.special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.special_bytes = regex.compile(self.special.pattern.encode()) if added else None

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces whose ids, one after another, are the texts', for a ChunkEncoder. Cuts before a space or line break
        between two other characters and before an ASCII mark after a letter or digit, where every split of the pattern
        ends. Texts with runs of white space are split by the pattern itself, and those with a special token's string,
        which is a piece of its own."""
        raw = [utf8(t) for t in texts]
        bounds = np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
        data = b"".join(raw)
        byte, kind = (np.frombuffer(x, np.uint8) for x in (data, data.translate(_KIND)))
        space, mark = kind >= _SPACE, kind == _MARK
        cut = space.copy()
        cut[1:] |= mark[1:] & (kind[:-1] == _ALNUM)
        wide = np.flatnonzero(mark[2:] & (byte[:-2] == 0xC3)) + 2
        cut[wide[_LATIN[byte[wide - 1]]]] = True
        odd = [np.flatnonzero(space[1:] & space[:-1]) + 1, np.flatnonzero(kind == _OTHER_SPACE)]
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            first, second, third = (np.append(byte, [0, 0])[lead + k].astype(np.int64) for k in range(3))
            odd.append(lead[np.isin(first << 16 | second << 8 | np.where(first < 0xE0, 0, third), _WIDE_SPACE)])
        if self.special_bytes is not None and b"<|" in data:
            odd.append(np.array([m.start() for m in self.special_bytes.finditer(data)], np.int64))
        for i in np.unique(np.searchsorted(bounds, np.concatenate(odd), "right") - 1).tolist():
            cut[bounds[i] : bounds[i + 1]] = False
            sizes = [len(utf8(p)) for p in self.split(texts[i])]
            cut[bounds[i] + np.cumsum(sizes[:-1], dtype=np.int64)] = True
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(cut)
        offsets = np.append(at, len(data))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), np.searchsorted(at, bounds)

    def split(self, text: str) -> list[str]:
        """What the pattern finds in a text, and special tokens' strings."""
        out, done = [], 0
        for m in self.special.finditer(text) if self.special is not None and "<|" in text else ():
            out += [*_FIND(text[done : m.start()]), m[0]]
            done = m.end()
        return out + _FIND(text[done:])

    def encode_chunks(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, flat, and how many each has: the pieces' distinct words are merged together."""
        numbers: dict[str, int] = {}
        used, counts, special = [], [], set()
        for p in map(text_of, pieces):
            if p in self.added:
                words = [p]
                special.add(p)
            else:
                words = _FIND(p)
            counts.append(len(words))
            used += words
        for w in used:
            numbers.setdefault(w, len(numbers))
        ids, ends = self.merge([b"" if w in special else w.encode() for w in numbers])
        start, size = ends[:-1], np.diff(ends)
        for w in special:
            start[numbers[w]], size[numbers[w]] = len(ids), 1
            ids = np.append(ids, np.int32(self.added[w]))
        at = np.fromiter(map(numbers.__getitem__, used), np.int64, len(used))
        totals = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[at])])
        last = np.cumsum(np.array(counts, np.int64))
        return gather(ids, start[at], size[at]), np.diff(totals[last], prepend=0)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each word, flat, and their ends.

        All words' symbols lie in one array. A round looks up every neighbouring pair by binary search in the
        sorted keys, takes each word's lowest rank and merges all its occurrences from left to right; words
        without a known pair leave. Between bytes that no token has side by side a word is cut first, as no
        merge can cross: the rounds of a very long word are those of its longest part.
        """
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        cut = np.ones(len(raw), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | ~self.joins[raw[:-1], raw[1:]]
        part = np.cumsum(cut) - 1
        place, symbols = np.arange(len(raw)), self.first[raw]
        final, done = np.full(len(raw), -1, np.int64), len(self.ranks)
        while len(symbols):
            key = (symbols[:-1] << _SHIFT) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), done, np.int64)
            rank[:-1] = np.where((self.keys[at] == key) & (part[1:] == part[:-1]), self.ranks[at], done)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            finished = best == done
            if finished.any():
                final[place[finished]] = symbols[finished]
                keep = ~finished
                symbols, part, place, rank, best = symbols[keep], part[keep], place[keep], rank[keep], best[keep]
                if not len(symbols):
                    break
            hit = rank == best
            i = np.flatnonzero(hit)
            run = np.r_[True, np.diff(i) != 1]  # neighbours overlap only in a run of one symbol: every second pair
            i = i[(np.arange(len(i)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            symbols[i] = self.results[rank[i]]
            keep = np.ones(len(symbols), bool)
            keep[i + 1] = False
            symbols, part, place = symbols[keep], part[keep], place[keep]
        kept = final >= 0
        counts = np.bincount(owner[kept], minlength=len(words)) if len(words) else np.empty(0, np.int64)
        return final[kept].astype(np.int32), np.r_[0, np.cumsum(counts)].astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every whole text. Null texts count as empty and have no ids; null ids and
    repeated rows stay; other columns are ignored. No shuffle; a worker holds some megabytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(path).encoder
        for b in slices(batches, limit=SLICE_CHARS):
            ids, ends = encode(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The texts of encode_documents' rows; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = model(path).decode
        for b in batches:
            texts = [decode(x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens and the digests of its ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in slices(batches, limit=SLICE_CHARS):
            ids, ends = m.encoder(b.column(1).to_pylist())
            wire = memoryview(ids.astype("<u4").tobytes())
            stops = ends.tolist()
            spans = list(zip(stops[:-1], stops[1:], strict=True))
            digests = [hashlib.sha256(wire[4 * x : 4 * y]).hexdigest() for x, y in spans]
            texts = [hashlib.sha256(m.decode(ids[x:y]).encode()).hexdigest() for x, y in spans]
            arrays = [b.column(0), pa.array(np.diff(ends)), pa.array(digests, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_path())
