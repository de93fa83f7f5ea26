"""Words and their 64-bit hashes, found for many texts at once with numpy.

A word's hash depends only on its bytes.  Two words or shingles count as equal if
their 64-bit hashes are; the chance of any wrong pair among n is about n * n / 2**65.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 19  # bytes looked at together: bounds the memory, whatever the length of a text
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(20240301).integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of ASCII letters and digits and of all that is not ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 32
_LOWERED = _BYTES[_LOWER]
_FIND = {id(BLANKS): re.compile(rb"[\x20\x09-\x0d]"), id(MARKS): re.compile(rb"[^0-9A-Za-z\x80-\xff]")}
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, b))]) for b in (_BASE, _BACK)]
    return _powers[0], _powers[1]


def span_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTES) -> np.ndarray:
    """Hash of each span of the bytes a."""
    up, down = _power(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(values[a] * up[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def _piece(part: bytes, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(part, np.uint8)
    inside = np.concatenate([[False], ~apart[a], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, span_hashes(a, start, end, _LOWERED)


def words(data: bytes, apart: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in data; A-Z count as a-z."""
    if len(data) <= PIECE:
        return _piece(data, apart)
    found, at = [], 0
    while at < len(data):
        cut = _FIND[id(apart)].search(data, at + PIECE)
        to = cut.end() if cut else len(data)
        start, end, h = _piece(data[at:to], apart)
        found.append((start + at, end + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def in_pieces(texts: list[str | None], size: int = PIECE, mark: bytes = b"\n") -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about size bytes: first, behind the last, their bytes each with a mark behind it, where each starts."""
    at = 0
    while at < len(texts):
        part, n, to = [], 0, at
        while to < len(texts) and (to == at or n < size):
            b = (texts[to] or "").encode("utf-8", "surrogatepass")
            part.append(b)
            n += len(b) + 1
            to += 1
        starts = np.concatenate([[0], np.cumsum([len(b) + 1 for b in part])])
        yield at, to, mark.join(part) + mark, starts
        at = to


def text_words(texts: list[str | None], apart: np.ndarray = BLANKS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: index of the first, word hashes, and where each text's words start (with the end)."""
    for at, _, data, starts in in_pieces(texts):
        start, _, h = words(data, apart)
        yield at, h, np.searchsorted(start, starts)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as sorted hashes; a text with fewer words has its whole sequence as one."""
    for _, h, bound in text_words(texts):
        n = len(h)
        if n >= width:
            s = np.zeros(n - width + 1, np.uint64)
            for k in range(width):
                s += h[k : n - width + 1 + k] * _STEPS[k]
            s = mix(s)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                short = np.uint64(b - a)
                for x in h[a:b]:
                    short = mix(np.array([short * _BASE + x]))[0]
                yield np.array([short])
            else:
                yield np.zeros(0, np.uint64)
