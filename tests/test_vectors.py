"""Random signatures against a second implementation: one term at a time, in plain numbers."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.operators import signatures
from sigloom.operators.vectors import Cache, Projection, accumulated, vectors
from sigloom.plans.search import _random

SMALL = "/root/testdata/sf0.001"


class PlainIsaac:
    """The generator over bytes of its memory: a look-up reads a word at a byte offset, as pointer arithmetic does."""

    def __init__(self, seed: bytes, bits: int) -> None:
        self.size, self.m = bits // 8, (1 << bits) - 1
        word = lambda i: int.from_bytes(seed[i * self.size : (i + 1) * self.size], "little")
        self.results = [word(i) for i in range(256)]
        self.memory, self.a, self.b, self.c = [0] * 256, 0, 0, 0
        v = [0x9E3779B9] * 8
        for _ in range(4):
            v = self.stir(v)
        for source in (self.results, self.memory):
            for i in range(0, 256, 8):
                v = self.stir([(x + y) & self.m for x, y in zip(v, source[i : i + 8], strict=True)])
                self.memory[i : i + 8] = v
        self.fill()

    def stir(self, v):
        a, b, c, d, e, f, g, h = v
        m = self.m
        a = (a ^ (b << 11)) & m; d = (d + a) & m; b = (b + c) & m  # noqa: E702
        b ^= c >> 2; e = (e + b) & m; c = (c + d) & m  # noqa: E702
        c = (c ^ (d << 8)) & m; f = (f + c) & m; d = (d + e) & m  # noqa: E702
        d ^= e >> 16; g = (g + d) & m; e = (e + f) & m  # noqa: E702
        e = (e ^ (f << 10)) & m; h = (h + e) & m; f = (f + g) & m  # noqa: E702
        f ^= g >> 4; a = (a + f) & m; g = (g + h) & m  # noqa: E702
        g = (g ^ (h << 8)) & m; b = (b + g) & m; h = (h + a) & m  # noqa: E702
        h ^= a >> 9; c = (c + h) & m; a = (a + b) & m  # noqa: E702
        return [a, b, c, d, e, f, g, h]

    def at(self, x):
        if self.size == 4:
            return self.memory[(x >> 2) & 255]
        raw = b"".join(w.to_bytes(8, "little") for w in self.memory)
        return int.from_bytes(raw[x & 1020 : (x & 1020) + 8], "little")

    def fill(self):
        m = self.m
        self.c += 1
        self.b = (self.b + self.c) & m
        for i in range(256):
            x = self.memory[i]
            self.a ^= (self.a << 13, self.a >> 6, self.a << 2, self.a >> 16)[i % 4]
            self.a = ((self.a & m) + self.memory[(i + 128) % 256]) & m
            y = self.memory[i] = (self.at(x) + self.a + self.b) & m
            self.b = self.results[i] = (self.at(y >> 8) + x) & m
        self.waiting = list(self.results)

    def next(self):
        if not self.waiting:
            self.fill()
        return self.waiting.pop()


def plain_vector(term: str, p: Projection) -> list[int]:
    size = p.rng // 8
    seed = bytearray(256 * size)
    seed[:4] = p.seed.to_bytes(4, "little")
    seed[size : size + len(term)] = term.encode()
    r = PlainIsaac(bytes(seed), p.rng)
    out = [0] * p.width
    if p.method == "OLD":
        return [{0: -1, 1: 1}.get(r.next() % (2 * p.density), 0) for _ in out]
    if p.method == "TRADITIONAL":
        for sign in (1, -1):
            left = p.width // p.density // 2
            while left:
                i = r.next() % p.width
                if not out[i]:
                    out[i], left = sign, left - 1
        return out
    at, left = 0, p.width // p.density
    while left:
        n = r.next() & 0xFFFFFFFF
        at = (at + n % (2 * p.density - 1) + 1) % p.width
        if not out[at]:
            out[at], left = (1 if n // (2 * p.density - 1) % 2 else -1), left - 1
    return out


@pytest.mark.parametrize("method", ["TRADITIONAL", "SKIP", "OLD"])
@pytest.mark.parametrize("bits", [32, 64])
def test_vectors_match_plain_numbers(method, bits):
    p = Projection(width=256, density=9, seed=12345, method=method, rng=bits)
    terms = ["a", "term", "thelongerterm", "x" * 100, "42"]
    assert vectors(terms, p).tolist() == [plain_vector(t, p) for t in terms]


@pytest.mark.parametrize("method", ["TRADITIONAL", "SKIP", "OLD"])
def test_registered_signatures_match_plain_numbers(spark, method):
    """Whole rows of the registered query, of the documents of fewest words."""
    p = Projection(method=method)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy(F.length("text"), "doc_id").limit(12).collect()
    rows = {r["doc_id"]: r for r in _random(method)[0](spark, SMALL).collect()}
    for d in docs:
        counts = Counter(t.lower() for t in re.findall("[A-Za-z0-9]+", d["text"]) if len(t) <= 127)
        if not counts:
            assert d["doc_id"] not in rows
            continue
        sums = sum(n * 1000 * np.array(plain_vector(t, p), dtype=object) for t, n in counts.items())
        bits = "".join("1" if s > 0 else "0" for s in sums)
        assert rows[d["doc_id"]]["bits"].lower() == f"{int(bits, 2):0{p.width // 4}x}"
        assert (rows[d["doc_id"]]["unique_terms"], rows[d["doc_id"]]["total_terms"]) == (len(counts), sum(counts.values()))


def test_sums_whatever_the_cache_holds():
    """Small caches, weights beyond the exact range of doubles, empty documents; terms come back after they have gone."""
    rnd = np.random.default_rng(3)
    terms = [[f"t{i}" for i in rnd.integers(0, 300, n)] for n in (50, 0, 400, 3, 120)] * 3
    weights = [rnd.integers(-(2**50), 2**50, len(t)) for t in terms]
    for cache in (10, 200, 100_000):
        p = Projection(width=128, cache=cache, seed=cache)
        signs = {t: vectors([t], p)[0].astype(object) for own in terms for t in own}
        wanted = [sum((int(x) * signs[t] for t, x in zip(own, w, strict=True)), np.zeros(128, dtype=object)) for own, w in zip(terms, weights, strict=True)]
        assert accumulated(terms, weights, p).tolist() == [w.tolist() for w in wanted]
        small = [np.ones(len(w), dtype=np.int64) for w in weights]
        assert accumulated(terms, small, p).tolist() == [sum((signs[t] for t in own), np.zeros(128, dtype=object)).tolist() for own in terms]
        assert len(Cache.of(p).new.place) <= max(cache, 300)


def test_counted_documents_match_the_scan(spark):
    """Unsplit documents are counted without the scan; markup, stems, stopwords and overlong runs give the same."""
    texts = ["<b>Ponies</b> eat&amp;drink the " + "x" * 200 + " the end.", "", "the", "é Äpfel ties 12 12", "y" * 2000 + " a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from sigloom.functions.tokenizer import segment_rows

    meta = ["doc_id", "seg", "terms", "counts", "unique_terms", "total_terms", "doc_char_length", "offset_begin", "offset_end"]
    for options in ({}, {"mask": "alpha", "markup": True}, {"stemmer": "s", "stopwords": ["the"]}, {"mask": "all", "stopwords": ["end."]}):
        a, b = (segment_rows(docs, places=x, **options).select(*meta).orderBy("doc_id").collect() for x in (True, False))
        assert a == b
    assert signatures.build(docs, Projection(width=64, method="MD5")).count() == 4
