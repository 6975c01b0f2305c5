"""Hashed word shingles of many texts in a few array operations."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_NEWLINE, _SPACE = 10, 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' lower-case words, one after another, and how many each text has."""
    raw = np.frombuffer("\n".join([" ".join(t.lower().split()) for t in texts]).encode(), np.uint8)
    counts = np.zeros(len(texts), np.int64)
    if not len(raw):
        return np.empty(0, np.uint64), counts
    power, inverse = _grown(len(raw) + 1)
    gap = (raw == _SPACE) | (raw == _NEWLINE)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    inside = ~gap
    start = np.flatnonzero(inside & np.r_[True, gap[:-1]])
    stop = np.flatnonzero(inside & np.r_[gap[1:], True]) + 1
    line = np.cumsum(raw == _NEWLINE)
    counts += np.bincount(line[start], minlength=len(texts))
    return mix((total[stop] - total[start]) * inverse[start]), counts


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of WORDS words, ascending within a text; how often each occurs; where each text's start
    (one more entry: the end). A text of fewer words has one shingle of all of them, an empty text one of none."""
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    made = np.maximum(1, counts - WORDS + 1)
    owner = np.repeat(np.arange(len(texts)), made)
    at = np.repeat(first - np.cumsum(made) + made, made) + np.arange(len(owner))
    padded = np.append(words, np.zeros(WORDS, np.uint64))
    value = np.zeros(len(owner), np.uint64)
    short = counts[owner] < WORDS
    for k in range(WORDS):
        term = padded[at + k] * _STEPS[k]
        if short.any():
            term = np.where(counts[owner] > k, term, np.uint64(k + 1))
        value = (value ^ term) * _BASE + (value >> np.uint64(29))
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])][: len(value)]
    place = np.flatnonzero(fresh)
    times = np.diff(np.append(place, len(value)))
    return value[place], times, np.searchsorted(owner[place], np.arange(len(texts) + 1))
