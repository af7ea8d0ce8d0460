"""The binary file formats of signatures, term statistics and slice indexes, for exchange; tables are the working format.

A signature file has a header of 88 bytes (six 32-bit numbers and the method) and a record of one length for each signature: the
name, eight 32-bit numbers and the bits. Term statistics are records of hash, df and ctf. All numbers are little-endian.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions.bits import WORD, layout, pack, unpack, word_columns, words
from sigloom.functions.text import term_hash
from sigloom.operators.signatures import META


@dataclass(frozen=True)
class Header:
    """What a signature file says of itself; version 1 has no seed."""

    name_length: int = 255
    width: int = 1024
    density: int = 21
    seed: int = 0
    method: str = "TRADITIONAL"
    version: int = 2

    @property
    def size(self) -> int:
        return 88 if self.version >= 2 else 84

    @property
    def record(self) -> int:
        return self.name_length + 1 + 32 + self.width // 8

    def pack(self) -> bytes:
        numbers = [self.size, self.version, self.name_length, self.width, self.density] + ([self.seed] if self.version >= 2 else [])
        return struct.pack(f"<{len(numbers)}i", *numbers) + self.method.encode()[:64].ljust(64, b"\0")

    @classmethod
    def unpack(cls, data: bytes) -> Header:
        _, version, name_length, width, density = struct.unpack("<5i", data[:20])
        seed = struct.unpack("<i", data[20:24])[0] if version >= 2 else 0
        method = data[24 if version >= 2 else 20 :][:64].split(b"\0")[0].decode()
        return cls(name_length, width, density, seed, method, version)


def to_bytes(rows: pd.DataFrame, header: Header) -> bytes:
    """Records of rows with doc_id, META and words; names are clipped."""
    names = word_columns(list(rows.columns))
    raw = np.packbits(unpack(rows[names].to_numpy(dtype=np.int64)), axis=1) if len(rows) else np.zeros((0, header.width // 8), dtype=np.uint8)
    out = []
    for i, row in enumerate(rows[["doc_id", *META]].itertuples(index=False)):
        name = str(row[0]).encode()[: header.name_length].ljust(header.name_length + 1, b"\0")
        out.append(name + struct.pack("<8i", *(int(x) for x in row[1:])) + raw[i].tobytes())
    return b"".join(out)


def from_bytes(data: bytes, header: Header) -> pd.DataFrame:
    """Rows of records; an incomplete last one is left out."""
    count = len(data) // header.record
    table = np.frombuffer(data, dtype=np.uint8, count=count * header.record).reshape(count, header.record)
    n = header.name_length + 1
    meta = np.ascontiguousarray(table[:, n : n + 32]).view("<i4").reshape(count, 8)
    bits = pack(np.unpackbits(table[:, n + 32 :], axis=1).astype(bool)) if count else np.zeros((0, header.width // WORD), dtype=np.int64)
    names = [bytes(r[:n]).split(b"\0")[0].decode(errors="replace") for r in table]
    columns = {"doc_id": names} | {m: meta[:, i] for i, m in enumerate(META)} | {w: bits[:, i] for i, w in enumerate(words(header.width))}
    return pd.DataFrame(columns)


def write_signatures(table: DataFrame, path: str, header: Header) -> int:
    """One binary file in the order of doc_num; rows come by partitions, so the driver holds one at a time. Returns how many there were."""
    columns = ["doc_id", *META, *words(header.width)]
    count, part = 0, []
    with open(path, "wb") as out:
        out.write(header.pack())
        for row in table.orderBy("doc_num").select(*columns).toLocalIterator():
            part.append(row)
            count += 1
            if len(part) == 10_000:
                out.write(to_bytes(pd.DataFrame(part, columns=columns), header))
                part = []
        if part:
            out.write(to_bytes(pd.DataFrame(part, columns=columns), header))
    return count


def read_signatures(spark: SparkSession, path: str) -> tuple[DataFrame, Header]:
    """A signature file as a table with doc_num, and its header, which overrides settings. Records are split by Spark."""
    with open(path, "rb") as f:
        header = Header.unpack(f.read(96))
    kinds = ", ".join(["doc_num long", "doc_id string", *[f"{m} int" for m in META], *[f"{w} long" for w in words(header.width)]])
    count = (os.path.getsize(path) - header.size) // header.record
    step = max(1, (64 << 20) // header.record)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in pdf["first"]:
                with open(path, "rb") as f:
                    f.seek(header.size + first * header.record)
                    rows = from_bytes(f.read(min(step, count - first) * header.record), header)
                rows.insert(0, "doc_num", np.arange(first, first + len(rows)))
                yield rows

    starts = spark.range(0, max(count, 0), step).select(F.col("id").alias("first"))
    return starts.mapInPandas(run, kinds), header


def write_stats(stats: DataFrame, path: str) -> int:
    """Records of (hash of the term, df, ctf), in the order of the hash."""
    rows = stats.select(term_hash("term").alias("h"), "df", "ctf").orderBy("h", "df", "ctf")
    count = 0
    with open(path, "wb") as out:
        for r in rows.toLocalIterator():
            out.write(struct.pack("<Iii", r["h"], r["df"], r["ctf"]))
            count += 1
    return count


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(term_hash, df, ctf) of a file of term statistics."""
    with open(path, "rb") as f:
        rows = np.frombuffer(f.read(), dtype=[("h", "<u4"), ("df", "<i4"), ("ctf", "<i4")])
    return spark.createDataFrame(pd.DataFrame({"term_hash": rows["h"].astype(np.int64), "df": rows["df"], "ctf": rows["ctf"]}))


def write_index(index: DataFrame, path: str, width: int, slice_width: int, signatures: int) -> None:
    """A slice index (slice, val, postings, n): header, counts of all values of all slices, posting lists."""
    slices = layout(width, slice_width)
    with open(path, "wb") as out:
        out.write(struct.pack("<6i", len(slices), 0, 2, signatures, slice_width, width))
        counts = {(r["slice"], r["val"]): r["n"] for r in index.select("slice", "val", "n").toLocalIterator()}
        for i, (a, b) in enumerate(slices):
            out.write(np.array([counts.get((i, v), 0) for v in range(1 << (b - a))], dtype="<i4").tobytes())
        for r in index.orderBy("slice", "val").toLocalIterator():
            out.write(np.asarray(r["postings"], dtype="<i4").tobytes())


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """write_index() read back."""
    with open(path, "rb") as f:
        n, _, _, _, slice_width, width = struct.unpack("<6i", f.read(24))
        counts = [np.frombuffer(f.read(4 << (b - a)), dtype="<i4") for a, b in layout(width, slice_width)]
        rows = [(i, v, np.frombuffer(f.read(4 * int(c)), dtype="<i4").tolist(), int(c)) for i in range(n) for v, c in enumerate(counts[i].tolist()) if c]
    return spark.createDataFrame(rows, "slice int, val int, postings array<bigint>, n int")
