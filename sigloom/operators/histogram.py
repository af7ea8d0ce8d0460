"""Histograms of distances: over pairs of documents, or of one query to all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.bits import hamming, word_columns
from sigloom.operators.search import BLOCK, blocks
from sigloom.session import cut


def _bins(distances: DataFrame, width: int) -> DataFrame:
    """_filled() of distances."""
    return _filled(distances.groupBy("dist").agg(F.count(F.lit(1)).alias("c")), width)


def _filled(counts: DataFrame, width: int) -> DataFrame:
    """(hd, n, fraction) of counts (dist, c) for 0 to width, also where there are none; fractions are 0 where there are no distances at all."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    all_ = spark.range(width + 1).select(F.col("id").cast("int").alias("hd"))
    met = all_.join(F.broadcast(counts), F.col("hd") == F.col("dist"), "left").crossJoin(F.broadcast(total))
    n = F.coalesce("c", F.lit(0).cast("bigint"))
    return met.select("hd", n.alias("n"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("fraction"))


def _pair_counts(signatures: DataFrame, source: int | None) -> DataFrame:
    """(dist, c) of pairs a < b, a among the first ``source`` numbers. Rows are packed into blocks; a pair of blocks is one vectorised step that gives its counts."""
    names = word_columns(signatures.columns)
    width = 64 * len(names)
    rows = signatures.select("doc_num", F.array(*names).alias("w"))
    sides = [cut(blocks(part, ["doc_num"], [F.col("doc_num")], ["doc_num", "w"], ["id", "w"], BLOCK, x), f"{x}blocks") for x, part in (("a_", rows if source is None else rows.where(F.col("doc_num") < source)), ("b_", rows))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = np.zeros(width + 1, dtype=np.int64)
            for row in pdf.itertuples(index=False):
                a, b, i, j = np.stack(row.a_w), np.stack(row.b_w), np.asarray(row.a_id), np.asarray(row.b_id)
                for at in range(0, len(a), 256):
                    x = np.bitwise_count((a[at : at + 256, None, :] ^ b[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)
                    counts += np.bincount(x[i[at : at + 256, None] < j[None, :]], minlength=width + 1)
            yield pd.DataFrame({"dist": np.arange(width + 1, dtype=np.int32), "c": counts})

    met = sides[0].crossJoin(sides[1]).mapInPandas(run, "dist int, c long")
    return met.groupBy("dist").agg(F.sum("c").alias("c")).where("c > 0")


def of_pairs(signatures: DataFrame, source: int | None = None) -> DataFrame:
    """Over all pairs whose first has a number below ``source`` (all, if null)."""
    return _filled(_pair_counts(signatures, source), 64 * len(word_columns(signatures.columns)))


def of_relevant_pairs(signatures: DataFrame, relevant: DataFrame, source: int | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Over pairs that are relevant to the same topic. relevant: (topic, doc_id, rel); a document's first row for a topic is enough."""
    kept = relevant.where("rel != 0").select("topic", "doc_id").distinct()
    kept = kept if begin is None else kept.where(F.col("topic") >= begin)
    kept = kept if end is None else kept.where(F.col("topic") <= end)
    names = word_columns(signatures.columns)
    own = kept.join(signatures.select("doc_id", "doc_num", *names), "doc_id")
    left = own.select("topic", F.col("doc_num").alias("a"), *[F.col(n).alias(f"a{n}") for n in names])
    left = left if source is None else left.where(F.col("a") < source)
    right = own.select(F.col("topic").alias("other"), F.col("doc_num").alias("b"), *[F.col(n).alias(f"b{n}") for n in names])
    dist = hamming([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])
    return _bins(left.join(right, (F.col("topic") == F.col("other")) & (F.col("a") < F.col("b"))).select(dist.alias("dist")), 64 * len(names))


def of_category(signatures: DataFrame, categories: DataFrame, category: object, source: int | None = None) -> DataFrame:
    """Over pairs of documents that are both of one category. categories: (doc_id, category)."""
    own = categories.where(F.col("category") == category).select("doc_id").distinct()
    return of_pairs(signatures.join(own, "doc_id", "left_semi"), source)


def of_query(signatures: DataFrame, query: DataFrame, relevant: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The histogram of one query's (one row, w*, m*) masked distances, and (doc_id, hd, fraction) of the relevant documents, at their least."""
    names = word_columns(signatures.columns)
    asked = query.select(*[F.col(n).alias(n.replace("w", "v")) for n in names], *[n.replace("w", "m") for n in names]).limit(1)
    dist = hamming([F.col(n) for n in names], [F.col(n.replace("w", "v")) for n in names], [F.col(n.replace("w", "m")) for n in names])
    met = signatures.crossJoin(F.broadcast(asked)).select("doc_id", dist.alias("dist"))
    met = met if relevant is None else met.join(relevant.where("rel != 0").select("doc_id").distinct(), "doc_id", "left_semi")
    bins = _bins(met, 64 * len(names))
    least = met.groupBy("doc_id").agg(F.min("dist").alias("hd"))
    return bins, least.join(F.broadcast(bins), "hd").select("doc_id", "hd", "fraction")
