"""Public hash and random number functions, vectorised over many terms."""

from __future__ import annotations

import numpy as np

GOLDEN = 0x9E3779B9
WORDS = 256


def super_fast_hash(data: bytes) -> int:
    """Hsieh's 32-bit hash; bytes of the tail are signed."""
    if not data:
        return 0
    m = 0xFFFFFFFF
    h = len(data)
    signed = lambda b: b - 256 if b > 127 else b
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        low, high = int.from_bytes(data[i : i + 2], "little"), int.from_bytes(data[i + 2 : i + 4], "little")
        h = (h + low) & m
        h = ((h << 16) ^ ((high << 11) ^ h)) & m
        h = (h + (h >> 11)) & m
    rest = data[whole:]
    if len(rest) == 3:
        h = (h + int.from_bytes(rest[:2], "little")) & m
        h = (h ^ (h << 16)) & m
        h = (h ^ (signed(rest[2]) << 18)) & m
        h = (h + (h >> 11)) & m
    elif len(rest) == 2:
        h = (h + int.from_bytes(rest, "little")) & m
        h = (h ^ (h << 11)) & m
        h = (h + (h >> 17)) & m
    elif len(rest) == 1:
        h = (h + signed(rest[0])) & m
        h = (h ^ (h << 10)) & m
        h = (h + (h >> 1)) & m
    for left, right in ((3, 5), (4, 17), (25, 6)):
        h = (h ^ (h << left)) & m
        h = (h + (h >> right)) & m
    return h


class Isaac:
    """Jenkins' ISAAC for a batch of seeds at once.

    bits 32 is the published generator. bits 64 is what its reference code computes where its word type has 8 bytes: the same
    shifts, and look-ups at byte offsets of the 4-byte layout, which may straddle two words.
    """

    def __init__(self, seeds: np.ndarray, bits: int = 32) -> None:
        self.kind = {32: np.uint32, 64: np.uint64}[bits]
        self.bits = bits
        self.out = np.ascontiguousarray(seeds.T.astype(self.kind))  # word by seed
        count = self.out.shape[1]
        self.lanes = np.arange(count)
        self.state = np.zeros((WORDS, count), dtype=self.kind)
        self.a, self.b, self.c = (np.zeros(count, dtype=self.kind) for _ in range(3))
        v = [np.full(count, GOLDEN, dtype=self.kind) for _ in range(8)]
        for _ in range(4):
            self._stir(v)
        for source in (self.out, self.state):
            for i in range(0, WORDS, 8):
                for j in range(8):
                    v[j] = v[j] + source[i + j]
                self._stir(v)
                for j in range(8):
                    self.state[i + j] = v[j]
        self._refill()
        self.left = WORDS

    def _stir(self, v: list[np.ndarray]) -> None:
        k = self.kind
        for i, shift in enumerate((-11, 2, -8, 16, -10, 4, -8, 9)):
            turned = v[(i + 1) % 8] << k(-shift) if shift < 0 else v[(i + 1) % 8] >> k(shift)
            v[i] = v[i] ^ turned
            v[(i + 3) % 8] = v[(i + 3) % 8] + v[i]
            v[(i + 1) % 8] = v[(i + 1) % 8] + v[(i + 2) % 8]

    def _look(self, x: np.ndarray) -> np.ndarray:
        if self.bits == 32:
            return self.state[((x >> np.uint32(2)) & np.uint32(WORDS - 1)).astype(np.int64), self.lanes]
        offset = (x & np.uint64(1020)).astype(np.int64)
        low = self.state[offset >> 3, self.lanes]
        high = self.state[(offset >> 3) + 1, self.lanes]
        split = (low >> np.uint64(32)) | (high << np.uint64(32))
        return np.where(offset & 4, split, low)

    def _refill(self) -> None:
        k = self.kind
        self.c = self.c + k(1)
        a, b = self.a, self.b + self.c
        for i in range(WORDS):
            x = self.state[i].copy()
            shift = (13, -6, 2, -16)[i % 4]
            a = (a ^ (a << k(shift) if shift > 0 else a >> k(-shift))) + self.state[(i + WORDS // 2) % WORDS]
            y = self._look(x) + a + b
            self.state[i] = y
            b = self._look(y >> k(8)) + x
            self.out[i] = b
        self.a, self.b = a, b

    def next(self) -> np.ndarray:
        """The next number of every seed; numbers of a block come from its end."""
        if not self.left:
            self._refill()
            self.left = WORDS
        self.left -= 1
        return self.out[self.left].copy()


def term_seeds(terms: list[bytes], seed: int = 0, bits: int = 32) -> np.ndarray:
    """Seed words of terms: the signature seed in the first word's low 4 bytes, the term's bytes from the second word on."""
    width = bits // 8
    raw = np.zeros((len(terms), WORDS * width), dtype=np.uint8)
    raw[:, :4] = np.frombuffer(int(seed & 0xFFFFFFFF).to_bytes(4, "little"), dtype=np.uint8)
    for i, term in enumerate(terms):
        raw[i, width : width + len(term)] = np.frombuffer(term, dtype=np.uint8)
    return raw.view("<u4" if bits == 32 else "<u8")
