"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, compared between versions.

A fingerprint has three parts of ``cells / 3`` cells; each paragraph digest is added to one cell of each part: a count, an xor of
digests and an xor of their checks. The difference of two fingerprints, cell by cell, holds only the paragraphs in which they
differ, whatever the length of the documents, and is peeled: a cell with one digest gives it away, and taking it out of its other
cells may bare more. If cells remain, the pair is compared again with fingerprints four times as large, until none is left.

A document is compared with its version before: the earlier document, by doc_id, that shares most paragraphs with it, wherever they
stand. The documents last before it, and the shortest before it, with each of its paragraphs and with all of them, bound the overlap
from below; a document with more has a paragraph outside of that many of the commonest ones, so that paragraphs of many documents
are rarely joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.words import mix
from sigloom.session import cut, table

CELLS, GROWTH, PARTS = 24, 4, 3


def digest(paragraph: Column) -> Column:
    """60 bits of a paragraph's MD5."""
    return F.conv(F.substring(F.md5(paragraph), 1, 15), 16, 10).cast("long")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, digests) of the documents that have a paragraph: a line that isn't blank."""
    text = F.col("text").cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    digests = F.array_distinct(F.transform(lines, digest))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), digests.alias("digests")).where(F.size("digests") > 0).distinct()


def sketch(lists: list[np.ndarray], cells: int) -> np.ndarray:
    """Fingerprints of lists of digests: len(lists) x cells x (count, digests, checks)."""
    part = cells // PARTS
    out = np.zeros((len(lists) * cells, 3), dtype=np.int64)
    sizes = [len(x) for x in lists]
    if sum(sizes):
        row = np.repeat(np.arange(len(lists)), sizes)
        key = np.concatenate([np.asarray(x, dtype=np.int64) for x in lists])
        for p in range(PARTS):
            at = row * cells + p * part + place(key, p, cells)
            np.add.at(out[:, 0], at, 1)
            np.bitwise_xor.at(out[:, 1], at, key)
            np.bitwise_xor.at(out[:, 2], at, check(key))
    return out.reshape(len(lists), cells * 3)


def place(key: np.ndarray, part: int, cells: int) -> np.ndarray:
    h = mix(key.astype(np.uint64) + np.uint64((part + 1) * 0x9E3779B97F4A7C15 + cells & 0xFFFFFFFFFFFFFFFF))
    return (h % np.uint64(cells // PARTS)).astype(np.int64)


def check(key: np.ndarray) -> np.ndarray:
    return (mix(key.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)).astype(np.int64)


def peel(new: np.ndarray, old: np.ndarray, cells: int) -> tuple[list[int], list[int], bool]:
    """Digests that only the new fingerprint has, those that only the old has, and whether that is all."""
    a, b = new.reshape(cells, 3), old.reshape(cells, 3)
    count, keys, checks = a[:, 0] - b[:, 0], a[:, 1] ^ b[:, 1], a[:, 2] ^ b[:, 2]
    found: tuple[list[int], list[int]] = ([], [])
    while True:
        pure = np.flatnonzero((np.abs(count) == 1) & (check(keys) == checks))
        if not len(pure):
            break
        key, first = np.unique(keys[pure], return_index=True)
        sign = count[pure][first]
        for s, out in ((1, found[0]), (-1, found[1])):
            out.extend(key[sign == s].tolist())
        for p in range(PARTS):
            at = p * (cells // PARTS) + place(key, p, cells)
            np.subtract.at(count, at, sign)
            np.bitwise_xor.at(keys, at, key)
            np.bitwise_xor.at(checks, at, check(key))
        if len(found[0]) + len(found[1]) > 4 * cells:  # a false pure cell can run in circles
            return [], [], False
    done = not (count.any() or keys.any() or checks.any())
    return sorted(found[0]), sorted(found[1]), done


def shared(rows: DataFrame) -> DataFrame:
    """(v, size, shared): the number of paragraphs of each document, and those that others have too, the rarest first."""
    each = rows.select(F.struct("doc_id", "th").alias("v"), F.size("digests").alias("size"), F.explode("digests").alias("digest"))
    often = each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = each.join(often, "digest").groupBy("v", "size").agg(F.sort_array(F.collect_list(F.struct("n", "digest"))).alias("s"))
    return lists.select("v", "size", F.col("s.digest").alias("shared"))


def before(slim: DataFrame) -> DataFrame:
    """(v, p) of slim (key, v, size, range): each document with the last and with the shortest before it that have the same key. Documents of a
    range are ordered in one task for each key; ranges are linked by their ends."""
    short, past = F.struct("size", "v"), (Window.unboundedPreceding, -1)
    ends = slim.groupBy("key", "range").agg(F.max("v").alias("end"), F.min(short).alias("low"))
    ranges = Window.partitionBy("key").orderBy("range")
    ends = ends.select("key", F.col("range").alias("r"), F.lag("end").over(ranges).alias("end"), F.min("low").over(ranges.rowsBetween(*past)).alias("low"))
    own = Window.partitionBy("key", "range").orderBy("v")
    slim = slim.withColumns({"own": F.lag("v").over(own), "least": F.min(short).over(own.rowsBetween(*past))})
    met = slim.alias("s").join(ends.alias("e"), (F.col("s.key") == F.col("e.key")) & (F.col("range") == F.col("r")))
    both = F.array(F.coalesce("own", "end"), F.least("least", "low")["v"])
    return met.select("v", F.explode(both).alias("p")).where("p is not null").distinct()


def ranked(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(v, best: struct<n, size, p>): of the documents p of each v the one with most shared paragraphs; of equals the shortest, then the latest. size is negative."""
    same = lambda x, m: (F.col(f"{x}.th") == F.col(f"{m}.v.th")) & F.col(f"{x}.doc_id").eqNullSafe(F.col(f"{m}.v.doc_id"))
    met = pairs.join(lists.alias("a"), same("pairs.v", "a")).join(lists.alias("b"), same("pairs.p", "b"))
    n = F.size(F.array_intersect("a.shared", "b.shared")).alias("n")
    return met.select("pairs.v", n, (-F.col("b.size")).alias("size"), "pairs.p").groupBy("v").agg(F.max(F.struct("n", "size", "p")).alias("best"))


def versions(rows: DataFrame) -> DataFrame:
    """(doc_id, th, previous_id, previous_th): each document with the earlier one that shares most paragraphs, of those that share any."""
    # ranges of equal numbers of documents in the order of their ids, whatever these are
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = cut(shared(rows).repartitionByRange(ranges, "v").withColumn("range", F.spark_partition_id()), "shared")
    keys = F.array_append("shared", F.xxhash64("shared"))
    near = cut(ranked(before(lists.select(F.explode(keys).alias("key"), "v", "size", "range")).alias("pairs"), lists), "near")
    # more than best.n in common: the first common paragraph has best.n others behind it in both lists
    each = lists.select("v", F.size("shared").alias("size"), F.posexplode("shared").alias("pos", "digest"))
    bound = near.select(F.col("v").alias("w"), F.col("best.n").alias("least"))
    same = (F.col("v.th") == F.col("w.th")) & F.col("v.doc_id").eqNullSafe(F.col("w.doc_id"))
    asked = each.join(bound, same).where("pos + least < size").select("v", "least", "digest")
    others = each.select(F.col("v").alias("p"), (F.col("size") - F.col("pos")).alias("left"), "digest")
    more = asked.join(others, "digest").where((F.col("v") > F.col("p")) & (F.col("left") > F.col("least"))).select("v", "p").distinct()
    found = near.unionByName(ranked(more.alias("pairs"), lists)).groupBy("v").agg(F.max("best").alias("best"))
    return found.select("v.doc_id", "v.th", F.col("best.p.doc_id").alias("previous_id"), F.col("best.p.th").alias("previous_th"))


def fingerprints(rows: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, th, cells): one fingerprint of fixed size for each document of paragraphs()."""
    build = F.pandas_udf(lambda lists: pd.Series(list(sketch([np.asarray(x) for x in lists], cells))), "array<long>")
    return rows.select("doc_id", "th", build("digests").alias("cells"))


def compared(pairs: DataFrame, rows: DataFrame, cells: int) -> DataFrame:
    """pairs with added, removed and done."""
    marks = fingerprints(rows, cells)
    result = "struct<added: array<long>, removed: array<long>, done: boolean>"

    @F.pandas_udf(result)
    def run(new: pd.Series, old: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([peel(np.asarray(a), np.asarray(b), cells) for a, b in zip(new, old, strict=True)], columns=["added", "removed", "done"])

    same = lambda i, t, m: F.col(i).eqNullSafe(F.col(f"{m}.doc_id")) & (F.col(t) == F.col(f"{m}.th"))
    met = pairs.alias("p").join(marks.alias("a"), same("p.doc_id", "p.th", "a")).join(marks.alias("b"), same("p.previous_id", "p.previous_th", "b"))
    found = met.select("p.doc_id", "p.th", "p.previous_id", "p.previous_th", run("a.cells", "b.cells").alias("x"))
    return found.select("doc_id", "th", "previous_id", "previous_th", "x.added", "x.removed", "x.done")


def differences(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, previous_id, added, removed): sorted digests of the paragraphs that only this, or only the previous, version has.

    The previous version is the earlier document that shares most paragraphs; of several with as many, the shortest that
    versions() meets, then the latest. Documents that share no paragraph with an earlier one have no row; so null texts and texts of blank lines. A paragraph counts once in a
    document. Rows of equal id and text are one document; null ids come first. Ids of any type are in their own order.
    """
    if cells % PARTS:
        raise ValueError("cells must be a multiple of 3")
    rows = cut(paragraphs(docs), "paragraphs")
    pairs = cut(versions(rows), "versions")
    out = None
    while True:
        ids = pairs.select("doc_id", "th").union(pairs.select("previous_id", "previous_th")).distinct()
        same = F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("r.th") == F.col("i.th"))
        rows = cut(rows.alias("r").join(ids.alias("i"), same, "left_semi"), "paragraphs")
        found = cut(compared(pairs, rows, cells), "compared")
        out = found.where("done") if out is None else out.unionByName(found.where("done"))
        pairs = found.where("not done").select(*pairs.columns)
        if not pairs.take(1):
            return out.select("doc_id", "previous_id", "added", "removed")
        cells *= GROWTH


def op10_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = differences(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("doc_id", "previous_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"), text("added"), text("removed"))
