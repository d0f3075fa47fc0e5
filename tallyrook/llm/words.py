"""Words of many texts at once, as numpy arrays over the texts' bytes.

A word is a longest run of bytes other than space and \\x09 to \\x0D. A word's hash is a
polynomial over 64-bit values of its bytes, mixed; equal words have equal hashes in any
run and on any machine, and different ones collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


_BASE = 0x5851F42D4C957F2D | 1
_UNDO = pow(_BASE, -1, 1 << 64)


#: Bytes whose prefix sums are made at once: memory does not follow the buffer's length.
_STEP = 1 << 18


@lru_cache(maxsize=2)
def _powers(base: int) -> np.ndarray:
    """base ** 0 to base ** _STEP."""
    out = np.full(_STEP + 1, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """starts, ends: byte places of all words; doc: the text of each; first: for each
    text the index of its first word, and behind the last one the number of words."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        self.buf, self.offsets = buf, offsets
        n, docs = len(buf), len(offsets) - 1
        solid = ~SEPARATOR[buf]
        edge = np.zeros(n + 1, bool)  # a text starts here
        edge[offsets] = True
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        end[:-1] &= ~solid[1:] | edge[1:n]
        self.solid = solid
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))
        self.lower = lower

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word."""
        return hash_ranges(self.buf, self.starts, self.ends, self.lower)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """One 64-bit hash of each range of bytes. The starts rise; ranges may touch, not overlap."""
    values, up, down = _byte_values()[LOWER] if lower else _byte_values(), _powers(_BASE), _powers(_UNDO)
    out = np.zeros(len(starts), U)
    sums = np.zeros(_STEP + 1, U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + _STEP - (_STEP >> 3)))  # what begins in the first seven eighths
        top = min(len(buf), base + _STEP)
        part = sums[1 : top - base + 1]
        np.take(values, buf[base:top], out=part)
        part *= up[: top - base]
        np.cumsum(part, out=part)
        s, e = starts[i:j] - base, ends[i:j] - base
        long = np.flatnonzero(e > top - base)
        out[i:j] = (sums[np.minimum(e, top - base)] - sums[s]) * down[s]
        for k in long.tolist():  # the rest of a range that goes on, piece by piece
            at, scale = top, pow(_BASE, top - base - int(s[k]), 1 << 64)
            while at < base + int(e[k]):
                to = min(at + _STEP, base + int(e[k]))
                piece = int((values[buf[at:to]] * up[: to - at]).sum(dtype=U))
                out[i + k] = U((int(out[i + k]) + piece * scale) % (1 << 64))
                at, scale = to, scale * int(up[-1]) % (1 << 64)
        i = j
    return mix(out)


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of all ranges, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word window, index of its first word); windows stay in one text."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    acc = np.zeros(n - k + 1, U)
    for i in range(k):
        acc = acc * U(_BASE) + hashes[i : n - k + 1 + i]
    last = np.repeat(first[1:], np.diff(first))[: n - k + 1]  # one past the text's last word
    at = np.flatnonzero(np.arange(n - k + 1) + k <= last)
    return mix(acc[at]), at


def chunks(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` bytes; a longer text is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
