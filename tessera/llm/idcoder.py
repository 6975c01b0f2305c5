"""Blocks of token ids under an adaptive context-mixing range coder.

A block is cut into lanes, stretches of equal length that are coded in step with one another: step t codes the t-th
id of every lane in a few array operations. All lanes share one model. It starts empty in each block and learns
from all ids before step t whenever t has doubled, the last time halfway, in the coder and the decoder alike:

* order 2: a table from the last two ids (hashed) to the id that mostly followed, with counts of its hits and misses;
* order 1: for each id all ids that have followed it, with their counts, and a share for any other;
* order 0: in how many contexts each id has occurred.

An id's interval is cut from the mixture: first the share of order 2, learned per pair of hits and misses; what is
left is dealt out by order 1; and its share for other ids by order 0. Each lane has a range coder of 48 bits, whose
carries are added to the words already put out; its quotients are exact in floating point. The words of all lanes
stand in the order in which the decoder asks for them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMB3"
#: Most lanes of a block, and the fewest ids a lane should have.
LANES, LANE_IDS = 4096, 64
#: Steps whose intervals the coder works out at once: few enough for a processor's cache.
STRETCH = 8
_HASH_BITS = 16
_HITS, _MISSES = 15, 7  # counts of order 2 end here
_K1, _K2 = np.int32(-2048144777), np.int32(-1640531535)
_MIX_BITS = 12
_MIX_MASK, _LOWER = (1 << _MIX_BITS) - 1, (1 << 32) - 1
_WORD, _TOP = 16, 48
_LOW_BITS = _TOP - _WORD
_LEAST, _REST = 1 << _LOW_BITS, (1 << _LOW_BITS) - 1
_AHEAD = _TOP // _WORD  # words of a lane that the decoder has read before the first id; as many end it
#: Least share of either outcome of order 2, of 2**_MIX_BITS, and most pairs that order 1 counts: a span of 2**32 can
#: be dealt out by both.
_LEAST_SHARE, _MOST_PAIRS = 16, 1 << 22
_HEADER = struct.Struct("<4sIIII")  # magic, ids, vocabulary, lanes, checksum of the ids
_CHECK = struct.Struct("<I")  # of the header and the body


class Corrupt(ValueError):
    """A block whose checksums do not hold."""


def _distinct(keys: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ascending distinct keys, how often each occurs and, if asked for, where: first the places of the first key. Keys
    are sorted with their places below them where both fit, as numpy sorts values far faster than places."""
    n, order = len(keys), None
    bits = (n - 1).bit_length()
    if not places:
        keys = np.sort(keys)
    elif int(keys.max()) >> 63 - bits:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
    else:
        keys = keys << bits
        keys |= np.arange(n)
        keys.sort()
        order = keys & ((1 << bits) - 1)
        keys >>= bits
    fresh = np.ones(n, bool)
    np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    return keys[first], np.diff(first, append=n), order


class _Model:
    """Frozen between two calls of learn. Fields that are looked up together share an integer: the one named first in
    its upper bits, the other in its lower 32 (order 2: _MIX_BITS). Only a decoder's model finds ids by their place."""

    def __init__(self, vocabulary: int, decodes: bool):
        if vocabulary > 1 << 24:
            raise ValueError("ids of more than 24 bits")
        self.vocabulary, self.decodes = vocabulary, decodes
        # order 2
        slots = 1 << _HASH_BITS
        self.guess = np.zeros(slots, np.int64)
        self.hits, self.misses = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        self.outcomes = np.ones(((_HITS + 1) * (_MISSES + 1), 2), np.int64)  # misses and hits by counts
        # order 1
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.heads = np.zeros(vocabulary, np.int64)  # contexts of each id
        self._lay_out()

    def slots(self, last2: np.ndarray, last1: np.ndarray) -> np.ndarray:
        """The places of two ids in order 2."""
        return (last2 * _K2 ^ last1 * _K1) >> (31 - _HASH_BITS) & ((1 << _HASH_BITS) - 1)

    def _lay_out(self) -> None:
        bucket = np.minimum(self.hits, _HITS) * (_MISSES + 1) + np.minimum(self.misses, _MISSES)
        share = _LEAST_SHARE + self.outcomes[:, 1] * ((1 << _MIX_BITS) - 2 * _LEAST_SHARE) // self.outcomes.sum(1)
        self.bucket, self.guess_share = bucket, self.guess << _MIX_BITS | share[bucket]
        # order 1: a context's entries lie together, that for other ids (-1) last; at the very end unknown contexts
        context = self.keys // self.vocabulary
        first = np.flatnonzero(np.diff(context, prepend=-1))
        kinds = np.diff(first, append=len(context))
        row = np.arange(len(first))
        n = len(self.keys) + len(first) + 1
        size = np.empty(n, np.int64)
        place, others = np.arange(len(self.keys)) + np.repeat(row, kinds), first + kinds + row
        size[place], size[others], size[-1] = 2 * self.counts - 1, kinds, 1
        ends = np.cumsum(size)
        base, total = ends[first + row] - size[first + row], 2 * np.add.reduceat(self.counts, first) if len(first) else kinds
        start = ends - size - np.append(np.repeat(base, kinds + 1), ends[-1] - 1)
        self.place, self.start_size = place, start << 32 | size
        self.others = np.full(self.vocabulary, n - 1, np.int64)
        self.others[context[first]] = others
        self.base_total = np.full(self.vocabulary, (ends[-1] - 1) << 32 | 1, np.int64)
        self.base_total[context[first]] = base << 32 | total
        size0 = 1 + 16 * self.heads
        ends0 = np.cumsum(size0)
        self.start_size0, self.total0 = (ends0 - size0) << 32 | size0, int(ends0[-1])
        if self.decodes:
            self.entry = np.empty((n, 2), np.int64)  # as start_size, and the id
            self.entry[:, 0], self.entry[:, 1] = self.start_size, -1
            self.entry[place, 1] = self.keys - context * self.vocabulary
            self.entry_at = np.repeat(np.arange(n, dtype=np.int32), size)
            self.id_at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), size0)

    def keys_of(self, last1: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return last1.astype(np.int64) * self.vocabulary + ids

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending keys stand, or would, among those of order 1, and which do."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def learn(self, slot: np.ndarray, hit: np.ndarray, ids: np.ndarray, keys: np.ndarray, times: np.ndarray, at: np.ndarray, known: np.ndarray) -> None:
        """The next ids, step by step, with their places in order 2 and whether it had them; their distinct keys and
        what find says of these."""
        n = len(self.hits)
        misses, hits = np.bincount(slot + n * hit, minlength=2 * n).reshape(2, n)
        for k, times_ in enumerate((misses, hits)):
            self.outcomes[:, k] += np.bincount(self.bucket, times_, len(self.outcomes)).astype(np.int64)
        full = self.outcomes.sum(1) > 1 << 16
        self.outcomes[full] = (self.outcomes[full] + 1) >> 1
        wrong = misses > self.hits + hits
        new = np.flatnonzero(wrong[slot] & ~hit)
        self.guess[slot[new]] = ids[new]  # the last of them
        self.misses = np.minimum(self.misses + misses >> (hits > 0), 255)
        self.hits = np.where(wrong, 0, np.minimum(self.hits + hits, 255))

        fresh = ~known
        self.counts[at[known]] += times[known]
        added, place = keys[fresh], at[fresh]
        place += np.arange(len(place))
        old = np.ones(len(self.keys) + len(added), bool)
        old[place] = False
        for name, more in (("keys", added), ("counts", times[fresh])):
            both = np.empty(len(old), np.int64)
            both[place], both[old] = more, getattr(self, name)
            setattr(self, name, both)
        while self.counts.sum() > _MOST_PAIRS:
            self.counts = (self.counts + 1) >> 1
        self.heads += np.bincount(added % self.vocabulary, minlength=self.vocabulary)
        self._lay_out()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def _rounds(steps: int) -> list[tuple[int, int]]:
    """First and last steps between which the model stays as it is: the second half, before it the second quarter and
    so on, so that what is learned, the dearest part, is never more than half."""
    out = []
    while steps:
        out.append((steps >> 1, steps))
        steps >>= 1
    return out[::-1]


def _sealed(header: bytes, body: bytes) -> bytes:
    return header + _CHECK.pack(zlib.crc32(body, zlib.crc32(header))) + body


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """ids (each below vocabulary) as one block."""
    n = len(ids)
    checksum = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return _sealed(_HEADER.pack(MAGIC, 0, vocabulary, 0, checksum), b"")
    lanes, steps = _shape(n)
    grid = np.zeros((steps + 2, lanes), np.int32)  # two steps of zeros stand before the first
    flat = np.zeros(lanes * steps, np.int32)
    flat[:n] = ids
    grid[2:] = flat.reshape(lanes, steps).T
    model = _Model(vocabulary, False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _TOP, np.int64)
    everyone = np.arange(lanes)
    out_lane: list[np.ndarray] = []
    out_word: list[np.ndarray] = []

    def put(who: np.ndarray, count: int = 1) -> None:
        for _ in range(count):
            held = low[who]
            out_lane.append(who.astype(np.uint16))
            out_word.append((held >> _LOW_BITS).astype(np.int32))
            low[who] = (held & _REST) << _WORD

    def widen(who: np.ndarray) -> None:
        while len(who):
            put(who)
            wide = span[who] << _WORD
            span[who] = wide
            who = who[wide < _LEAST]

    for first, stop in _rounds(steps):
        last1, x = (grid[first + k : stop + k].reshape(-1) for k in (1, 2))
        slot, hit = np.empty(len(x), np.int32), np.empty(len(x), bool)
        keys, times, order = _distinct(model.keys_of(last1, x), True)
        at, known = model.find(keys)
        # order 1: start and size of each id, inverted where it is not known and those for other ids stand instead
        found = np.empty(len(keys), np.int64)
        found[known] = model.start_size[model.place[at[known]]]
        found[~known] = ~model.start_size[model.others[keys[~known] // vocabulary]]
        start_size = np.empty(len(x), np.int64)
        start_size[order] = np.repeat(found, times)
        for t in range(first, stop, STRETCH):
            end = min(t + STRETCH, stop)
            these = slice((t - first) * lanes, (end - first) * lanes)
            slot[these] = place = model.slots(grid[t:end].reshape(-1), last1[these])
            held = model.guess_share[place]
            hit[these] = has = held >> _MIX_BITS == x[these]
            share = held & _MIX_MASK
            start, size = np.where(has, 0, share), np.where(has, share, (1 << _MIX_BITS) - share)
            held, total1 = start_size[these], (model.base_total[last1[these]] & _LOWER).astype(np.float64)
            held[has], total1[has] = 1, 1  # the whole for those that order 2 has
            strange = np.flatnonzero(held < 0)
            held[strange] = ~held[strange]
            start1, size1 = held >> 32, held & _LOWER
            held = model.start_size0[x[these][strange]]
            start0, size0 = held >> 32, held & _LOWER
            step_of = np.searchsorted(strange, np.arange(end - t + 1) * lanes).tolist()
            for k in range(end - t):
                here = slice(k * lanes, (k + 1) * lanes)
                unit = span >> _MIX_BITS
                low += unit * start[here]
                unit *= size[here]
                unit = (unit / total1[here]).astype(np.int64)
                low += unit * start1[here]
                span = unit * size1[here]
                odd = slice(step_of[k], step_of[k + 1])
                if odd.start < odd.stop:
                    who = strange[odd] - k * lanes
                    widen(who[span[who] < _LEAST])
                    unit = (span[who] / model.total0).astype(np.int64)
                    low[who] += unit * start0[odd]
                    span[who] = unit * size0[odd]
                widen(np.flatnonzero(span < _LEAST))
        if stop < steps:
            model.learn(slot, hit, x, keys, times, at, known)
    put(everyone, _AHEAD)
    lane = np.concatenate(out_lane)
    order = np.argsort(lane, kind="stable")
    words = np.concatenate(out_word)[order]
    while (carry := words >> _WORD).any():
        words &= (1 << _WORD) - 1
        words[:-1] += carry[1:]
    # when a word was put out, the decoder asks for that _AHEAD places behind it
    asked = np.empty(len(words), "<u2")
    asked[order[:-_AHEAD]] = words[_AHEAD:]
    each = np.bincount(lane, minlength=lanes)
    start = np.cumsum(each) - each
    body = words[start + np.arange(_AHEAD)[:, None]].astype("<u2").tobytes() + asked[: len(words) - _AHEAD * lanes].tobytes()
    return _sealed(_HEADER.pack(MAGIC, n, vocabulary, lanes, checksum), body)


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; Corrupt if a checksum fails."""
    if len(block) < _HEADER.size + _CHECK.size:
        raise Corrupt("a block ends within its header")
    magic, n, vocabulary, lanes, checksum = _HEADER.unpack_from(block)
    body = memoryview(block)[_HEADER.size + _CHECK.size :]
    if magic != MAGIC or (zlib.crc32(body, zlib.crc32(block[: _HEADER.size])),) != _CHECK.unpack_from(block, _HEADER.size):
        raise Corrupt("a block's bytes are damaged")
    if not n:
        return np.empty(0, np.int32)
    steps = -(-n // lanes)
    words = np.frombuffer(body, "<u2").astype(np.int64)
    asked = _AHEAD * lanes
    code, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << _TOP, np.int64)
    for word in words[:asked].reshape(_AHEAD, lanes):
        code = code << _WORD | word
    model = _Model(vocabulary, True)
    grid = np.zeros((steps + 2, lanes), np.int32)

    def widen(who: np.ndarray) -> None:
        nonlocal asked
        while len(who):
            code[who] = code[who] << _WORD | words[asked : asked + len(who)]
            asked += len(who)
            wide = span[who] << _WORD
            span[who] = wide
            who = who[wide < _LEAST]

    for first, stop in _rounds(steps):
        slots, hits = np.empty((stop - first, lanes), np.int32), np.empty((stop - first, lanes), bool)
        for t in range(first, stop):
            last2, last1 = grid[t], grid[t + 1]
            slot = model.slots(last2, last1)
            held = model.guess_share[slot]
            unit = span >> _MIX_BITS
            bound = unit * (held & _MIX_MASK)
            hit = code < bound
            x = held >> _MIX_BITS
            rest = np.flatnonzero(~hit)
            if len(rest):
                context, share = last1[rest], bound[rest]
                held = model.base_total[context]
                total = held & _LOWER
                part = (((unit[rest] << _MIX_BITS) - share) / total).astype(np.int64)
                c = code[rest] - share
                entry = model.entry_at[np.minimum((c / part).astype(np.int64), total - 1) + (held >> 32)]
                held, y = model.entry.take(entry, axis=0).T
                code[rest] = c - part * (held >> 32)
                bound[rest] = part * (held & _LOWER)
                x[rest] = y
            span = bound
            who = rest[y < 0] if len(rest) else rest
            if len(who):
                widen(who[span[who] < _LEAST])
                part = (span[who] / model.total0).astype(np.int64)
                y = model.id_at[np.minimum((code[who] / part).astype(np.int64), model.total0 - 1)]
                held = model.start_size0[y]
                code[who] -= part * (held >> 32)
                span[who] = part * (held & _LOWER)
                x[who] = y
            widen(np.flatnonzero(span < _LEAST))
            grid[t + 2], slots[t - first], hits[t - first] = x, slot, hit
        if stop < steps:
            last1, x = grid[first + 1 : stop + 1].reshape(-1), grid[first + 2 : stop + 2].reshape(-1)
            keys, times, _ = _distinct(model.keys_of(last1, x))
            model.learn(slots.reshape(-1), hits.reshape(-1), x, keys, times, *model.find(keys))
    ids = grid[2:].T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != checksum:
        raise Corrupt("a block's ids do not match their checksum")
    return ids
