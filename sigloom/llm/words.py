"""Vectorised views of a batch of texts: words and their 64-bit hashes, by whole-array numpy arithmetic.

Bytes are weighted by powers of an odd number, so that the hash of any stretch is a difference of two prefix sums times an
inverse power (mod 2**64); a finaliser then mixes the bits. Texts are taken in slices of about ``SLICE`` bytes, which bounds
memory; a longer text is a slice by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: ASCII letters and digits and every byte of a longer UTF-8 sequence belong to words.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... mod 2**64, of length n at least; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        table = np.full(max(n, SLICE + 1024), base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.multiply.accumulate(table)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stretches(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end] for many stretches; equal contents give equal hashes wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n + 1)[:n], out=total[1:])
    found = (total[end] - total[start]) * powers(_INVERSE, n + 1)[start]
    return mix(found + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


class Batch:
    """Words of some texts: ``doc`` (index of the text), ``start``, ``end`` (bytes), ``hash``; ``first[d]:first[d+1]`` are the words of text d."""

    def __init__(self, texts: list[bytes]) -> None:
        self.size = len(texts)
        self.length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum(self.length + 1, out=self.offset[1:])
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, dtype=np.uint8)
        inside = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        inside[1:-1] = WORD[self.bytes]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = stretches(self.bytes, self.start, self.end)
        self.doc = np.searchsorted(self.offset, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.size + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of each run of k words; a text of fewer words has one shingle of all of them, one of none has none."""
        n = len(self.hash)
        counts = np.diff(self.first)
        at = np.arange(max(0, n - k + 1))
        at = at[self.doc[at] == self.doc[at + k - 1]] if len(at) else at
        short = np.flatnonzero((counts > 0) & (counts < k))
        begin = np.concatenate([at, self.first[short]])
        until = np.concatenate([at + k, self.first[short] + counts[short]])
        if not len(begin):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        return self.doc[begin], stretches(self.hash, begin, until)
