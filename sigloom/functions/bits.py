"""Signatures as columns: W / 64 BIGINTs w0, w1, ...; bit i is the (i % 64)-th of its word, counted from the most significant."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def words(width: int, prefix: str = "w") -> list[str]:
    """Names of the word columns of a width, which must be a multiple of 64."""
    if width <= 0 or width % WORD:
        raise ValueError(f"width {width} is no multiple of {WORD}")
    return [f"{prefix}{i}" for i in range(width // WORD)]


def word_columns(columns: list[str], prefix: str = "w") -> list[str]:
    """The word columns among some columns, in order."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def signed(x: int) -> int:
    """A 64-bit pattern as a BIGINT has it."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def balanced_sum(terms: list[Column]) -> Column:
    """A sum as a tree of little depth."""
    while len(terms) > 1:
        terms = [reduce(Column.__add__, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def hamming(left: list[Column], right: list[Column], mask: list[Column] | None = None) -> Column:
    """Different bits of two signatures, of those in the mask; plain arithmetic, so it stays in generated code."""
    differ = [a.bitwiseXOR(b) for a, b in zip(left, right, strict=True)]
    if mask is not None:
        differ = [d.bitwiseAND(m) for d, m in zip(differ, mask, strict=True)]
    return balanced_sum([F.bit_count(d) for d in differ])


def positive_words(values: Column, width: int) -> list[Column]:
    """Word columns of an array of numbers: a bit is set where the number is above 0; missing and null numbers are not."""
    one = F.lit(1).cast("bigint")

    def word(i: int) -> Column:
        def step(acc: Column, j: Column) -> Column:
            bit = F.call_function("shiftleft", one, F.lit(WORD - 1) - j)
            return acc.bitwiseOR(F.when(F.get(values, j + i * WORD) > 0, bit).otherwise(F.lit(0).cast("bigint")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("bigint"), step)

    return [word(i) for i in range(width // WORD)]


def bit_string(columns: list[Column]) -> Column:
    """A signature as 0s and 1s."""
    return F.concat(*[F.lpad(F.bin(c), WORD, "0") for c in columns])


def hex_string(columns: list[Column]) -> Column:
    """A signature as hexadecimal digits in lower case."""
    return F.lower(F.concat(*[F.lpad(F.hex(c), WORD // 4, "0") for c in columns]))


def from_hex(text: Column, width: int) -> list[Column]:
    """Word columns of hexadecimal digits."""
    half = lambda start: F.conv(F.substring(text, start, 8), 16, 10).cast("bigint")
    return [F.shiftleft(half(16 * i + 1), 32).bitwiseOR(half(16 * i + 9)) for i in range(width // WORD)]


def layout(width: int, slice_width: int = 16) -> list[tuple[int, int]]:
    """Bits [begin, end) of each slice: ceil(width / slice_width) slices, as even as can be."""
    if not 1 <= slice_width <= 30:
        raise ValueError("slices must have 1 to 30 bits")
    count = -(-width // slice_width)
    return [(width * i // count, width * (i + 1) // count) for i in range(count)]


def slice_value(columns: list[Column], begin: int, end: int) -> Column:
    """The bits [begin, end) as a number, the first bit the most significant."""
    parts = []
    at = begin
    while at < end:
        word, upto = at // WORD, min(end, (at // WORD + 1) * WORD)
        bits = F.shiftrightunsigned(columns[word], (word + 1) * WORD - upto).bitwiseAND(F.lit((1 << (upto - at)) - 1).cast("bigint"))
        parts.append(F.shiftleft(bits, end - upto))
        at = upto
    return reduce(Column.bitwiseOR, parts).cast("int")


def bytes_of(columns: list[Column]) -> Column:
    """The bytes of a signature as an array of numbers from 0 to 255."""
    return F.array(*[F.shiftrightunsigned(c, s).bitwiseAND(F.lit(255).cast("bigint")).cast("int") for c in columns for s in range(56, -1, -8)])


def from_bytes(values: Column, width: int) -> list[Column]:
    """Word columns of an array of bytes."""
    out = []
    for i in range(width // WORD):
        each = [F.shiftleft(F.get(values, F.lit(8 * i + j)).cast("bigint").bitwiseAND(F.lit(255).cast("bigint")), 56 - 8 * j) for j in range(8)]
        out.append(reduce(Column.bitwiseOR, each))
    return out


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans to rows of int64 words."""
    return np.packbits(bits, axis=1).reshape(len(bits), -1, 8).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)


def unpack(packed: np.ndarray) -> np.ndarray:
    """Rows of int64 words to rows of booleans."""
    raw = np.ascontiguousarray(packed).view(np.uint64).astype(">u8").view(np.uint8).reshape(len(packed), -1)
    return np.unpackbits(raw, axis=1).astype(bool)
