"""Hashed words and word shingles of many whole texts at once.

A word's hash comes from a running polynomial sum over the bytes, brought back to the word's start
by the multiplier's inverse, so that it does not depend on the word's place; A-Z counts as a-z. Words
are what lies between \\x20 and \\x09-\\x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import buffers, mix64

WORDS = 5
STRETCH = 1 << 21  # bytes of texts that are taken at a time; a longer text is taken alone
CHUNK = 1 << 18  # bytes of a running sum
_BASE = 0x9E3779B97F4A7C15
#: Fixed odd multipliers, one for each place of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_value = mix64(np.arange(1, 257, dtype=np.uint64) * PLACES[1])
_value[65:91] = _value[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses, n of each at least."""
    size = max(CHUNK, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        both = []
        for m in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, m, np.uint64)
            t[0] = 1
            both.append(np.multiply.accumulate(t))
        if size > CHUNK + 1:  # of one very long word
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


def stretches(column: pa.Array, size: int = STRETCH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about size bytes."""
    data, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, z, data[off[a] : off[z]], off[a : z + 1] - off[a]
        a = z


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, line within the text) of each word of the texts data[off[i]:off[i + 1]]."""
    hashes, starts, lines = [], [], []
    a, n, line = 0, len(data), 0
    while a < n:
        z = min(n, a + CHUNK)
        if z < n:
            z = _cut(data, off, a, z)
        part = data[a:z]
        char = ~_space[part]
        edge = np.zeros(len(part) + 1, bool)
        here = off[np.searchsorted(off, a) : np.searchsorted(off, z)] - a
        edge[here] = True
        before = np.empty_like(char)
        before[0] = False
        before[1:] = char[:-1]
        start = np.flatnonzero(char & (~before | edge[:-1]))
        end = np.flatnonzero(before & (~char | edge[:-1]))
        if char[-1]:
            end = np.r_[end, len(part)]
        power, inverse = _tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_value[part] * power[: len(part)], out=total[1:])
        hashes.append(mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * PLACES[2]))
        starts.append(start + a)
        ends = np.flatnonzero(part == 10)
        lines.append(np.cumsum(np.bincount(np.searchsorted(start, ends), minlength=len(start) + 1)[: len(start)]) + line)
        line += len(ends)
        a = z
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate(starts)
    text = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(start, off)))
    base = np.searchsorted(np.flatnonzero(data == 10), off)  # line ends before each text
    return np.concatenate(hashes), text, np.concatenate(lines) - base[text]


def _cut(data: np.ndarray, off: np.ndarray, a: int, z: int) -> int:
    """A place at or before z, but after a, where no word goes on; else the next such place."""
    text = int(off[np.searchsorted(off, z, "right") - 1])
    for back in (256, z - a):
        blank = np.flatnonzero(_space[data[max(a, z - back) : z]])
        if len(blank):
            return max(text, max(a, z - back) + int(blank[-1]) + 1)
    if text > a:
        return text
    text = int(off[np.searchsorted(off, z, "right")])
    step = z
    while step < text:
        blank = np.flatnonzero(_space[data[step : min(text, step + CHUNK)]])
        if len(blank):
            return step + int(blank[0]) + 1
        step += CHUNK
    return text


def shingles(w: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, group) of the 5-word shingles within each run of equal group, in no order; a run of
    fewer words is one shingle."""
    if not len(w):
        return w, group
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(w)])
    parts, at = [], []
    if len(w) >= WORDS:
        size = len(w) - WORDS + 1
        h = np.full(size, WORDS, np.uint64)
        for k in range(WORDS):
            h += w[k : k + size] * PLACES[k]
        inside = group[WORDS - 1 :] == group[:size]
        parts.append(mix64(h[inside]))
        at.append(group[:size][inside])
    for k in range(1, WORDS):
        short = first[n == k]
        if len(short):
            h = np.full(len(short), k, np.uint64)
            for j in range(k):
                h += w[short + j] * PLACES[j]
            parts.append(mix64(h))
            at.append(group[short])
    return np.concatenate(parts), np.concatenate(at)


def text_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text by text and sorted; bounds of each text's)."""
    w, text, _ = words(data, off)
    h, at = shingles(w, text)
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    if len(h):
        new = np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])]
        h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(len(off)))


def exact_shingles(text: str) -> set[tuple[bytes, ...]]:
    """The set itself, unhashed, for confirmation."""
    w = text.encode().lower().split()
    n = min(WORDS, len(w))
    return set(zip(*(w[k:] for k in range(n)), strict=False)) if n else set()
