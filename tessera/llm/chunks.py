"""Token ids of many texts by way of a bounded cache of short pieces of text ("chunks").

A tokenizer's own splitting never joins characters across certain white space, so a text is cut there and each
distinct piece is encoded once per worker. Arrow cuts the texts and finds the distinct pieces of all texts at hand;
what remains is one dictionary lookup for each of those and one gather.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that an encoder should get at once: the more, the fewer pieces are distinct.
SLICE_CHARS = 4_000_000
#: A cache beyond one of these keeps, before the next texts, only pieces that were met again, or nothing if these are
#: more than half as many.
CACHE_CHUNKS, CACHE_BYTES, CACHE_IDS = 900_000, 15_000_000, 4_500_000


class ChunkEncoder:
    """ids of texts. cut: all texts' pieces in order, as bytes, and where each text's pieces start (one more entry: the
    end); encode: the ids of several pieces (text_of), flat, and how many each has; room: the share of the cache's bounds."""

    def __init__(self, cut: Callable[[list[str]], tuple[pa.Array, np.ndarray]], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], room: float = 1):
        self.cut, self.encode, self.room = cut, encode, room
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.bytes = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.size = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)
        self.again = np.zeros(1 << 14, bool)  # pieces that were met again since they came or were kept

    def _full(self, share: float) -> bool:
        share *= self.room
        return len(self.index) > share * CACHE_CHUNKS or self.bytes > share * CACHE_BYTES or self.used > share * CACHE_IDS

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.again[: len(self.index)])
        names, ids, sizes = list(self.index), gather(self.flat, self.start[kept], self.size[kept]), self.size[kept]
        self._clear()
        self._store([names[i] for i in kept.tolist()], ids, sizes)
        if self._full(0.5):
            self._clear()

    def _grown(self, a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n - len(a), len(a)), a.dtype)])

    def _add(self, chunks: list[bytes]) -> None:
        self._store(chunks, *self.encode(chunks))

    def _store(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, k, m = len(ids), len(self.index), len(chunks)
        self.flat = self._grown(self.flat, self.used + n)
        self.start, self.size, self.again = (self._grown(x, k + m) for x in (self.start, self.size, self.again))
        self.again[k : k + m] = False
        self.size[k : k + m] = sizes
        self.start[k : k + m] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + n] = ids
        self.used += n
        self.bytes += sum(map(len, chunks))
        self.index.update(zip(chunks, range(k, k + m), strict=True))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids start (one more entry: the end)."""
        if self._full(1):
            self._shrink()
        pieces, ends = self.cut(texts)
        pieces = pieces.dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if len(missing):
            at[missing] = len(self.index) + np.arange(len(missing))
            self._add([names[i] for i in missing.tolist()])
        at = at[pieces.indices.to_numpy()]
        size = self.size[at].astype(np.int64)
        stop = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        return gather(self.flat, self.start[at], size), stop[ends]


def text_of(piece: bytes) -> str:
    return piece.decode("utf-8", "surrogatepass")


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def cut_at_spaces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces between spaces, for a ChunkEncoder."""
    pieces = pc.split_pattern(pa.array(map(utf8, texts), pa.large_binary()), " ")
    return pieces.flatten(), pieces.offsets.to_numpy()


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin at start, one after another."""
    stop = np.cumsum(size)
    return flat[np.repeat(start - stop + size, size) + np.arange(stop[-1])] if len(stop) else flat[:0]


def _ends_word(text: str) -> bool:
    """Whether text ends in what is a letter or digit, also after a tokenizer has normalised it."""
    last = text[-1:]
    return last.isalnum() if last.isascii() else normalize("NFC", last).lower().isalnum()


def cut_marks(text: str) -> str:
    """text with a space before each comma or full stop that ends a word before a space, so that words are pieces
    without them. Split patterns end a token between a letter or digit and such a mark; where something else stands
    before one, those marks stay as they are throughout the text."""
    for mark in (", ", ". "):
        if mark in text:
            parts = text.split(mark)
            if all(map(_ends_word, {p[-1:] for p in parts[:-1]})):
                text = f" {mark}".join(parts)
    return text
