"""Random vectors of terms: pure functions of the term, computed for many terms at once and kept in each worker.

Vectors are rows of signs (-1, 0, 1). Methods: TRADITIONAL, half plus and half minus signs at random places; SKIP, places by random
steps; OLD, each place by itself; MD5, dense signs from the term's MD5 (for widths up to 128), which SQL can express too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sigloom.functions.hashing import Isaac, term_seeds

METHODS = ("TRADITIONAL", "SKIP", "OLD", "MD5")
#: Terms whose generators run side by side; each has 2 KB of state.
SIDE_BY_SIDE = 2048
#: Pairs of a document and a term that are added up at once.
PAIRS = 40_000


@dataclass(frozen=True)
class Projection:
    """How terms become vectors. rng: 64 for the generator with 8-byte words, 32 for the published one; cache: vectors a worker keeps."""

    width: int = 1024
    density: int = 21
    seed: int = 0
    method: str = "TRADITIONAL"
    rng: int = 64
    cache: int = 400_000

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"no signature method {self.method!r}")
        if self.width <= 0 or self.width % 64:
            raise ValueError("the width must be a multiple of 64")
        if self.method == "MD5" and self.width > 128:
            raise ValueError("MD5 vectors have 128 bits at most")


def vectors(terms: list[str], p: Projection) -> np.ndarray:
    """len(terms) x width signs."""
    parts = [np.zeros((0, p.width), dtype=np.int8)]
    for i in range(0, len(terms), SIDE_BY_SIDE):
        parts.append(_block(terms[i : i + SIDE_BY_SIDE], p))
    return np.concatenate(parts)


def _block(terms: list[str], p: Projection) -> np.ndarray:
    n = len(terms)
    if p.method == "MD5":
        raw = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in terms), dtype=np.uint8).reshape(n, 16)
        return np.unpackbits(raw, axis=1)[:, : p.width].astype(np.int8) * 2 - 1
    generator = Isaac(term_seeds([t.encode() for t in terms], p.seed, p.rng), p.rng)
    out = np.zeros((n, p.width), dtype=np.int8)
    rows = np.arange(n)
    if p.method == "OLD":
        for i in range(p.width):
            r = generator.next() % generator.kind(2 * p.density)
            out[r == 0, i], out[r == 1, i] = -1, 1
    elif p.method == "TRADITIONAL":
        half = p.width // p.density // 2
        done = np.zeros(n, dtype=np.int64)
        # each term draws until it has all its signs; a draw that meets an occupied place is lost
        while (open_ := done < 2 * half).any():
            at = (generator.next() % generator.kind(p.width)).astype(np.int64)
            fresh = open_ & (out[rows, at] == 0)
            out[rows[fresh], at[fresh]] = np.where(done[fresh] < half, 1, -1)
            done += fresh
    else:
        span = 2 * p.density - 1
        at, done = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        # a step on to an occupied place is walked but sets nothing
        while (open_ := done < p.width // p.density).any():
            r = generator.next().astype(np.uint32).astype(np.int64)
            at = np.where(open_, (at + r % span + 1) % p.width, at)
            fresh = open_ & (out[rows, at] == 0)
            out[rows[fresh], at[fresh]] = np.where((r[fresh] // span) % 2 == 1, 1, -1)
            done += fresh
    return out


class Generation:
    """Vectors of some terms as the places of their signs: ``codes[first[i]:first[i + 1]]`` are 2 * place + (1 for minus) of term i."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.first, self.codes = np.zeros(1025, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)

    def add(self, terms: list[str], p: Projection) -> None:
        for i in range(0, len(terms), SIDE_BY_SIDE):
            part = terms[i : i + SIDE_BY_SIDE]
            signs = _block(part, p)
            row, at = np.nonzero(signs)
            n, size = len(self.place), int(self.first[len(self.place)])
            self.first, self.codes = _room(self.first, n + len(part) + 1), _room(self.codes, size + len(row))
            self.codes[size : size + len(row)] = 2 * at + (signs[row, at] < 0)
            self.first[n + 1 : n + len(part) + 1] = size + np.cumsum(np.bincount(row, minlength=len(part)))
            self.place.update(zip(part, range(n, n + len(part)), strict=True))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy of twice its length at least, with room for size numbers."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), dtype=array.dtype)])


class Cache:
    """Vectors of one worker process by projection. When the newer of two generations is half of the cache, the older one, which was not asked for since, goes."""

    _all: dict[Projection, Cache] = {}

    def __init__(self, p: Projection) -> None:
        self.p, self.new, self.old = p, Generation(), Generation()

    @classmethod
    def of(cls, p: Projection) -> Cache:
        return cls._all.setdefault(p, cls(p))

    def look(self, terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of different terms one after the other, and how many each has."""
        if len(self.new.place) + len(terms) > max(self.p.cache // 2, len(terms)):
            self.new, self.old = Generation(), self.new
        unknown = [t for t in terms if t not in self.new.place]
        if unknown:
            known = [t for t in unknown if t in self.old.place]
            self._move(known)
            self.new.add([t for t in unknown if t not in self.old.place], self.p)
        at = np.fromiter(map(self.new.place.__getitem__, terms), dtype=np.int64, count=len(terms))
        return _take(self.new, at)

    def _move(self, terms: list[str]) -> None:
        """Terms of the older generation into the newer one."""
        if terms:
            codes, sizes = _take(self.old, np.fromiter(map(self.old.place.__getitem__, terms), dtype=np.int64, count=len(terms)))
            g = self.new
            n, size = len(g.place), int(g.first[len(g.place)])
            g.first, g.codes = _room(g.first, n + len(terms) + 1), _room(g.codes, size + len(codes))
            g.codes[size : size + len(codes)] = codes
            g.first[n + 1 : n + len(terms) + 1] = size + np.cumsum(sizes)
            g.place.update(zip(terms, range(n, n + len(terms)), strict=True))


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... for sizes[0] numbers, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _take(g: Generation, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = g.first[at + 1] - g.first[at]
    return g.codes[_spread(g.first[at], sizes)], sizes


def accumulated(terms: list[list[str]], weights: list[np.ndarray], p: Projection) -> np.ndarray:
    """Of each document the sum of its terms' vectors times their weights, in 64 bits. Different terms of a part of the batch are looked up together."""
    out = np.zeros((len(terms), p.width), dtype=np.int64)
    cache = Cache.of(p)
    sizes = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
    flat_terms = [t for own in terms for t in own]
    flat_weights = np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(w, dtype=np.int64) for w in weights)])
    doc = np.repeat(np.arange(len(terms)), sizes)
    for a in range(0, len(flat_terms), PAIRS):
        part, w, d = flat_terms[a : a + PAIRS], flat_weights[a : a + PAIRS], doc[a : a + PAIRS]
        place: dict[str, int] = {}
        which = np.fromiter((place.setdefault(t, len(place)) for t in part), dtype=np.int64, count=len(part))
        codes, many = cache.look(list(place))
        begins = np.cumsum(many) - many
        code = codes[_spread(begins[which], many[which])]
        w, low = np.repeat(w, many[which]), d[0]
        cell = np.repeat((d - low) * p.width, many[which]) + (code >> 1)
        signed = np.where(code & 1, -w, w)
        rows = d[-1] + 1 - low
        if np.abs(w).sum(dtype=float) < 2**52:  # sums of doubles are exact
            out[low : low + rows] += np.bincount(cell, signed, rows * p.width).astype(np.int64).reshape(rows, p.width)
        else:
            np.add.at(out.ravel(), low * p.width + cell, signed)
    return out


def term_vectors(terms: DataFrame, p: Projection) -> DataFrame:
    """(term, pos, neg) of each different term: the places of its plus and minus signs, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signs = vectors(list(pdf["term"]), p)
            yield pd.DataFrame({"term": pdf["term"], "pos": [np.flatnonzero(r > 0) for r in signs], "neg": [np.flatnonzero(r < 0) for r in signs]})

    return terms.select("term").where("term is not null").distinct().mapInPandas(run, "term string, pos array<int>, neg array<int>")
