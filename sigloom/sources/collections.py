"""Readers of document collections: (doc_id, text, path), one row a document, from files of many formats.

Formats that are lines or have a closing mark are split by Spark's text source, so large files are read by many tasks; archives are
read file by file. Bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.config import EngineConfig
from sigloom.functions.text import basename, field_id, mapped_ids
from sigloom.operators.sequences import parse_fasta

SCHEMA = "doc_id string, text string, path string"


def targets(config: EngineConfig) -> list[str]:
    """TARGET-PATH, TARGET-PATH-2, ...: up to the first that is missing; empty values are skipped."""
    found = [config.get("TARGET-PATH")]
    n = 2
    while found[-1] is not None:
        found.append(config.get(f"TARGET-PATH-{n}"))
        n += 1
    return [p for p in found if p]


def files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths, on any file system that Spark reads, with folders replaced by the files in them; folders inside of folders are left alone."""
    out: list[str] = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(path) and system.getFileStatus(path).isDirectory():
            out += sorted(str(s.getPath().toString()) for s in system.listStatus(path) if s.isFile())
        else:
            out.append(p)
    return out


def unpacked(data: bytes, compression: str = "none") -> bytes:
    """Bytes of a file that is compressed as said, whatever its name."""
    return {"none": lambda x: x, "gz": gzip.decompress, "gzip": gzip.decompress, "bz2": bz2.decompress, "bzip2": bz2.decompress}[compression.lower()](data)


def _text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def _each_file(spark: SparkSession, paths: list[str], compression: str, read: Callable[[str, bytes], Iterator[tuple[str, str]]]) -> DataFrame:
    """Documents of whole files."""
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(files(spark, paths)).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                plain = path.removeprefix("file:")
                rows = [(i, t, plain) for i, t in read(plain, unpacked(content, compression))]
                yield pd.DataFrame(rows, columns=["doc_id", "text", "path"])

    return data.mapInPandas(run, SCHEMA)


def _pieces(spark: SparkSession, paths: list[str], compression: str, end: str) -> DataFrame:
    """(value, path): what stands before each closing mark; compressed files are read whole."""
    if compression.lower() != "none":
        found = _each_file(spark, paths, compression, lambda p, d: ((p, piece) for piece in _text(d).split(end)))
        return found.select(F.col("text").alias("value"), "path")
    rows = spark.read.option("lineSep", end).text(files(spark, paths))
    return rows.select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"))


def read_files(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """A file is a document, named by its path."""
    return _each_file(spark, paths, compression, lambda p, d: iter([(p, _text(d))]))


def tar_members(path: str, data: bytes) -> Iterator[tuple[str, str]]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as archive:
        for member in archive:
            if member.isfile() and member.name != "NULL":
                yield member.name, _text(archive.extractfile(member).read())


def read_tar(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """A member of an archive is a document, named by its path there; those named NULL are skipped."""
    return _each_file(spark, paths, compression, tar_members)


def read_sgml(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """<DOC> ... </DOC> is a document, tags included, named by its <DOCNO> without one character of white space on either side."""
    rows = _pieces(spark, paths, compression, "</DOC>").where(F.col("value").contains("<DOC>"))
    whole = F.concat(F.regexp_extract("value", r"(?s)(<DOC>.*)", 1), F.lit("</DOC>"))
    name = F.regexp_extract("value", r"(?s)<DOCNO>\s?(.*?)\s?</DOCNO>", 1)
    return rows.select(name.alias("doc_id"), whole.alias("text"), "path")


def warc_records(path: str, data: bytes) -> Iterator[tuple[str, str]]:
    """(record id, body) of the responses; header names in any case; NULs become _. A record that is cut short is an error."""
    at = 0
    while at < len(data):
        gap = data.find(b"\r\n\r\n", at), data.find(b"\n\n", at)
        wide = gap[0] >= 0 and (gap[1] < 0 or gap[0] < gap[1])
        head_end = gap[0] if wide else gap[1]
        if head_end < 0:
            if data[at:].strip():
                raise ValueError(f"{path}: a header without end at byte {at}")
            return
        head = {}
        for line in data[at:head_end].replace(b"\r", b"").split(b"\n"):
            key, mark, value = line.partition(b":")
            if mark:
                head[key.strip().lower()] = value.strip()
        begin = head_end + (4 if wide else 2)
        size = int(head.get(b"content-length", b"0"))
        if begin + size > len(data):
            raise ValueError(f"{path}: a record is cut short at byte {at}")
        if head.get(b"warc-type", b"").lower() == b"response":
            yield _text(head.get(b"warc-trec-id", head.get(b"warc-record-id", b""))), _text(data[begin : begin + size].replace(b"\0", b"_"))
        at = begin + size
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1


def read_warc(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """A response record of a web archive is a document."""
    return _each_file(spark, paths, compression, warc_records)


def newline_documents(text: str, start_at: int = 1, divide_by: int = 1, strict: bool = False) -> list[tuple[str, str]]:
    """A line is a document, named by (its number / divide_by + start_at) with four digits. strict leaves out the text before the first
    line break and an unterminated last line."""
    lines = text.split("\n")
    lines = lines[1:-1] if strict else lines[:-1] if lines[-1] == "" else lines
    return [(f"{n // divide_by + start_at:04d}", line) for n, line in enumerate(lines)]


def read_newline(spark: SparkSession, paths: list[str], compression: str = "none", start_at: int = 1, divide_by: int = 1, strict: bool = False) -> DataFrame:
    """Lines of files; each file is numbered by itself."""
    return _each_file(spark, paths, compression, lambda p, d: iter(newline_documents(_text(d), start_at, divide_by, strict)))


def read_records(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """Records ``#UID:id``, ``#CONTENT:text``, ended by a line #EOR."""
    rows = _pieces(spark, paths, compression, "\n#EOR").where(F.col("value").contains("#UID:"))
    name = F.trim(F.regexp_extract("value", r"#UID:([^\n]*)", 1))
    return rows.select(name.alias("doc_id"), F.regexp_extract("value", r"(?s)#CONTENT:(.*)", 1).alias("text"), "path")


def read_photos(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """<photo ... id="X" ...>...</photo>: the document X is what stands behind ``<photo``."""
    rows = _pieces(spark, paths, compression, "</photo>").where(F.col("value").contains("<photo"))
    return rows.select(F.regexp_extract("value", r'<photo[^>]*?\bid="([^"]*)"', 1).alias("doc_id"), F.regexp_extract("value", r"(?s)<photo(.*)", 1).alias("text"), "path")


READERS: dict[str, Callable[..., DataFrame]] = {
    "file": read_files, "tar": read_tar, "wsj": read_sgml, "warc": read_warc, "newline": read_newline, "khresmoi": read_records, "mediaeval": read_photos,
}


def named(docs: DataFrame, style: str = "path", field: str = "") -> DataFrame:
    """doc_id by a style: path (as the reader says), basename.ext, basename, xmlfield (between <field> and </field>, else as it was)."""
    found = {
        "path": F.col("doc_id"),
        "basename.ext": basename(F.col("doc_id")),
        "basename": basename(F.col("doc_id"), extension=False),
        "xmlfield": field_id(F.col("text"), field, F.col("doc_id")),
    }[style.lower()]
    return docs.withColumn("doc_id", found)


def read_collection(spark: SparkSession, config: EngineConfig) -> DataFrame:
    """The documents that the settings name."""
    kind = config.get("TARGET-FORMAT", "file").lower()
    if kind not in READERS:
        raise ValueError(f"no collection format {kind!r}")
    options = {"compression": config.get("TARGET-FORMAT-COMPRESSION", "none")}
    if kind == "newline":
        options |= {"start_at": config.integer("TARGET-INDEX-NEWLINE-STARTAT", 1), "divide_by": config.integer("TARGET-INDEX-NEWLINE-DIVBY", 1)}
    docs = named(READERS[kind](spark, targets(config), **options), config.get("DOCID-FORMAT", "path"), config.get("XML-DOCID-FIELD", ""))
    mapping = config.get("MEDTRACK-MAPPING-FILE")
    if mapping:
        parts = F.split("value", r"\s+")
        rows = spark.read.text(mapping).select(parts[0].alias("from"), parts[1].alias("type"), parts[2].alias("to"))
        docs = mapped_ids(docs, rows, config.get("MEDTRACK-MAPPING-TYPE", "")).where("doc_id != 'NULL'")
    return docs


def read_features(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, bits): local image features of binary feature files as signatures; ids are name_x,y; bits are binary."""

    def parse(data: bytes) -> list[tuple[str, bytes]]:
        view, at = memoryview(data), 16
        number = lambda a, n: int.from_bytes(view[a : a + n], "little")
        size, count, out = number(4, 4), number(12, 4), []
        pictures = []
        for _ in range(count):
            n = view[at]
            pictures.append((bytes(view[at + 1 : at + 1 + n]).decode(), number(at + 1 + n, 4)))
            at += 1 + n + 8
        for name, points in pictures:
            places = [(number(at + 4 * i, 2), number(at + 4 * i + 2, 2)) for i in range(points)]
            at += 4 * points
            out += [(f"{name}_{x},{y}", bytes(view[at + i * size : at + (i + 1) * size])) for i, (x, y) in enumerate(places)]
            at += points * size
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield pd.DataFrame(parse(content), columns=["doc_id", "bits"])

    return spark.read.format("binaryFile").load(files(spark, paths)).select("content").mapInPandas(run, "doc_id string, bits binary")


def read_fasta(spark: SparkSession, paths: list[str], compression: str = "none") -> DataFrame:
    """(doc_id, residues) of FASTA files."""
    found = _each_file(spark, paths, compression, lambda p, d: iter(parse_fasta(_text(d))))
    return found.select("doc_id", F.col("text").alias("residues"))
