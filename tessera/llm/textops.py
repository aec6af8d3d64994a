"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of letters, marks and digits of any script; of the scripts in ``ALONE``,
which are written without blanks, every character is a word.  All else (blanks, punctuation of any
script, curly quotes, symbols, format characters) parts words.  Callers lower-case in the JVM
(``lower(text)``) before the column reaches Python, so case folding follows Unicode.  All work is done on slices of a few MB:
memory of a worker does not depend on the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)
_MASK = (1 << 64) - 1

_WORD = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        _WORD[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c

#: Scripts of which every character is a word.
ALONE = "".join(rf"\p{{{x}}}" for x in "Han Hiragana Katakana Hangul Thai Lao Khmer Myanmar".split())
#: The same words as a regular expression (RE2's and the ``regex`` module's).
WORD = rf"[{ALONE}]|(?:" + "|".join(rf"[^\P{{{x}}}{ALONE}]" for x in "LMN") + ")+"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of every code point: 0 between words, 1 part of a word, 2 a word alone."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *[0x20] * 0x800, *range(0xE000, 0x110000)]))
    out = np.zeros(len(points), np.uint8)
    for pattern, kind in ((r"[\p{L}\p{M}\p{N}]+", 1), (f"[{ALONE}]+", 2)):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for positions below n."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        pw = np.full(size, _MUL, np.uint64)
        iv = np.full(size, _INV, np.uint64)
        pw[0] = iv[0] = 1
        _powers[size] = np.multiply.accumulate(pw), np.multiply.accumulate(iv)
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, in place on a uint64 array."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words(NamedTuple):
    """Words of consecutive rows: row r owns words offsets[r]:offsets[r + 1]."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def _part_wide(raw: np.ndarray, x: np.ndarray, edge: np.ndarray) -> None:
    """Clear the bytes of non-ASCII characters that part words, and mark an edge around those that stand alone."""
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return
    last = len(raw) - 1
    b = [raw[np.minimum(lead + k, last)].astype(np.int32) & 0x3F for k in range(4)]
    size = np.where(raw[lead] < 0xE0, 2, np.where(raw[lead] < 0xF0, 3, 4))
    two, three = (b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
    point = np.where(size == 2, two, np.where(size == 3, three, (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    kind = _classes()[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        at = lead[(kind == 0) & (size > k)] + k
        x[at[at <= last]] = 0
    alone = kind == 2
    edge[lead[alone]] = True
    edge[np.minimum(lead[alone] + size[alone], last + 1)] = True


def scan_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Hash every word of the rows that ``offsets`` delimits in ``raw``."""
    base = int(offsets[0])
    x = _WORD[raw[base : int(offsets[-1])]]
    rel = offsets - base
    n = len(x)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), zero, zero)
    edge = np.zeros(n + 1, bool)
    edge[rel] = True
    _part_wide(raw[base : int(offsets[-1])], x, edge)
    w = x != 0
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:n]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    pw, iv = _power_table(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(pw[:n] * x, out=sums[1:])
    h = (sums[ends] - sums[starts]) * iv[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return Words(mix(h), np.searchsorted(starts, rel), starts, ends)


def gram_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words, for every position in the slice, and which
    positions lie wholly inside one row."""
    h = words.hashes
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = h[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xD1342543DE82EF95)
        g += h[j : j + n]
    inside = np.zeros(len(h) + 1, bool)
    counts = np.diff(words.offsets)
    row_end = np.repeat(words.offsets[1:], counts)
    inside = np.arange(n) + k <= row_end[:n]
    return mix(g), inside
