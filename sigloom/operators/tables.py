"""Maintenance of signature tables: concatenation, cutting, dealing, filtering, trimming, merging and views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import WORD, bit_string, bytes_of, from_bytes, from_hex, hex_string, word_columns, words


def _words(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in word_columns(df.columns)]


def concatenated(tables: list[DataFrame]) -> DataFrame:
    """Tables one behind the other; they must have the same width."""
    widths = {len(word_columns(t.columns)) * WORD for t in tables}
    if len(widths) != 1:
        raise ValueError(f"tables of different widths {sorted(widths)}")
    return reduce(DataFrame.unionByName, tables)


def first(table: DataFrame, n: int) -> DataFrame:
    """The rows numbered below n; one at least."""
    return table.where(F.col("doc_num") < max(1, n))


def dealt(table: DataFrame, parts: int, seed: int = 0, key: str = "doc_num") -> DataFrame:
    """With ``part``, 0 to parts - 1, at random by the key and seed."""
    return table.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(parts)).cast("int"))


def filtered(table: DataFrame, ids: DataFrame, mode: str) -> DataFrame:
    """The rows whose doc_id is among ids (mode include), or is not (exclude)."""
    kind = {"include": "left_semi", "exclude": "left_anti"}[mode]
    return table.join(ids.select("doc_id").distinct(), "doc_id", kind)


def name_length(table: DataFrame) -> DataFrame:
    """(longest, shrunk): the longest id, and the field that would hold it: a multiple of 8, less one."""
    longest = F.coalesce(F.max(F.octet_length(F.col("doc_id").cast("string"))), F.lit(0))
    return table.agg(longest.alias("longest")).withColumn("shrunk", (F.floor(F.col("longest") / 8) * 8 + 7).cast("int"))


def shuffled(table: DataFrame, seed: int = 0, key: str = "doc_num") -> DataFrame:
    """In random order, by the key and seed."""
    return table.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def split(table: DataFrame, n: int) -> DataFrame:
    """With ``chunk``: n rows each, in order of doc_num."""
    return table.withColumn("chunk", F.floor(F.col("doc_num") / n).cast("bigint"))


def trimmed(table: DataFrame, width: int) -> DataFrame:
    """The first ``width`` bits; a rest of the last word is 0."""
    names = word_columns(table.columns)
    keep = -(-width // WORD)
    rest = [c for c in table.columns if c not in names]
    out = [F.col(n) for n in names[:keep]]
    if width % WORD:
        out[-1] = out[-1].bitwiseAND(F.shiftleft(F.lit(-1).cast("bigint"), WORD - width % WORD)).alias(names[keep - 1])
    return table.select(*rest, *out)


def merged(table: DataFrame, n: int) -> DataFrame:
    """(chunk, doc_id, bits): n rows in a row as one, whose bits are theirs in ascending order, as hexadecimal digits; of the last chunk those there are."""
    rows = split(table, n).select("chunk", "doc_num", "doc_id", hex_string(_words(table)).alias("h"))
    return rows.groupBy("chunk").agg(F.min_by("doc_id", "doc_num").alias("doc_id"), F.array_join(F.sort_array(F.collect_list("h")), "").alias("bits"))


def merged_words(chunks: DataFrame, width: int) -> DataFrame:
    """merged() with words instead of digits, for chunks of ``width`` bits in all."""
    return chunks.select("chunk", "doc_id", *[w.alias(n) for w, n in zip(from_hex(F.col("bits"), width), words(width), strict=True)])


def viewed(table: DataFrame, ids: list | None = None) -> DataFrame:
    """(doc_num, doc_id, bits, changed): bits as 0s and 1s, and where they differ from the row before among those viewed."""
    rows = table if ids is None else table.where(F.col("doc_id").isin(ids))
    rows = rows.select("doc_num", "doc_id", bit_string(_words(table)).alias("bits"))
    ranges = rows.withColumn("range", F.floor(F.col("doc_num") / 65536))
    own = F.lag("bits").over(Window.partitionBy("range").orderBy("doc_num"))
    ends = ranges.groupBy("range").agg(F.max_by("bits", "doc_num").alias("end"))
    ends = ends.select(F.col("range").alias("r"), F.lag("end").over(Window.orderBy("range")).alias("end"))  # a row for 65,536 numbers
    met = ranges.withColumn("own", own).join(F.broadcast(ends), F.col("range") == F.col("r"))
    before = F.coalesce("own", "end")
    places = F.sequence(F.lit(1), F.length("bits"))
    mark = F.array_join(F.transform(places, lambda i: F.when(F.substring("bits", i, F.lit(1)) == F.substring(before, i, F.lit(1)), ".").otherwise("x")), "")
    return met.select("doc_num", "doc_id", "bits", F.when(before.isNotNull(), mark).alias("changed"))


def decimal_bytes(table: DataFrame) -> DataFrame:
    """(doc_num, value): bytes as decimal numbers between spaces."""
    return table.select("doc_num", F.array_join(bytes_of(_words(table)).cast("array<string>"), " ").alias("value"))


def from_decimal_bytes(lines: DataFrame, width: int) -> DataFrame:
    """(doc_num, doc_id, words): decimal_bytes() read back; ids are the numbers of the rows."""
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))
    return lines.select("doc_num", F.col("doc_num").cast("string").alias("doc_id"), *[w.alias(n) for w, n in zip(from_bytes(numbers, width), words(width), strict=True)])


def texthash(table: DataFrame) -> DataFrame:
    """(doc_num, value): hexadecimal digits and the id."""
    return table.select("doc_num", F.concat(hex_string(_words(table)), F.lit(" "), F.col("doc_id").cast("string")).alias("value"))


def short_words(table: DataFrame) -> DataFrame:
    """(doc_num, value): pairs of bytes as little-endian numbers, between spaces."""
    raw = bytes_of(_words(table))
    pairs = F.transform(F.sequence(F.lit(0), F.size(raw) - 2, F.lit(2)), lambda i: F.get(raw, i) + F.get(raw, i + 1) * 256)
    return table.select("doc_num", F.array_join(pairs.cast("array<string>"), " ").alias("value"))


def tree_ids(table: DataFrame, meta: list[str]) -> DataFrame:
    """(doc_num, value, bits): id and metadata joined by _, and the raw bits as binary."""
    return table.select("doc_num", F.concat_ws("_", F.col("doc_id").cast("string"), *[F.col(m).cast("string") for m in meta]).alias("value"), F.unhex(hex_string(_words(table))).alias("bits"))


def statistics(table: DataFrame, column: str = "total_terms") -> DataFrame:
    """(n, total, mean, stdev, least, most) of a column; the deviation is the population's."""
    c = F.col(column)
    return table.agg(
        F.count(c).alias("n"), F.sum(c).cast("bigint").alias("total"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stdev"), F.min(c).alias("least"), F.max(c).alias("most")
    )
