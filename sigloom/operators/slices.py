"""The inverted slice index: approximate nearest signatures by votes of equal slices, then exact distances.

A signature is cut into slices; a posting list holds the signatures with a value in a slice. A query's slices, and all their variants
within a radius, look up posting lists; a found signature gets slice width - different bits for each, and those with most votes
are compared exactly. A search cuts posting lists into blocks of signatures; a task takes a block of queries and reads the lists block by
block, so that votes, of which there are as many as pairs, are counted in place and only the best of each query go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import hamming, layout, slice_value, word_columns
from sigloom.operators.search import blocks, in_parts
from sigloom.session import cut, stored

#: Signatures whose posting lists a task reads at once, queries of a task, and votes that it holds.
LISTED, ASKED, HELD = 65_536, 512, 1_000_000


def slice_rows(signatures: DataFrame, slice_width: int = 16) -> DataFrame:
    """(doc_num, slice, val, bits) for each slice of each signature."""
    names = word_columns(signatures.columns)
    cols = [F.col(n) for n in names]
    each = [
        F.struct(F.lit(i).alias("slice"), slice_value(cols, a, b).alias("val"), F.lit(b - a).alias("bits"))
        for i, (a, b) in enumerate(layout(64 * len(names), slice_width))
    ]
    return signatures.select("doc_num", F.inline(F.array(*each)))


def build(signatures: DataFrame, slice_width: int = 16) -> DataFrame:
    """(slice, val, postings, n): posting lists in the order of doc_num."""
    rows = slice_rows(signatures, slice_width)
    return rows.groupBy("slice", "val").agg(F.sort_array(F.collect_list("doc_num")).alias("postings"), F.count(F.lit(1)).cast("int").alias("n"))


def write(index: DataFrame, path: str) -> None:
    """Posting lists as Parquet, a folder for each slice, in the order of values."""
    index.repartition("slice").sortWithinPartitions("slice", "val").write.partitionBy("slice").parquet(path)


def variants(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits of a slice, those of fewer bits first."""
    return [sum(1 << i for i in c) for r in range(min(radius, bits) + 1) for c in combinations(range(bits), r)]


def probes(signatures: DataFrame, slice_width: int = 16, radius: int = 1) -> DataFrame:
    """(doc_num, slice, val, score): all variants of all slices, with the votes that a match gives."""
    rows = slice_rows(signatures, slice_width)
    widths = sorted({b - a for a, b in layout(64 * len(word_columns(signatures.columns)), slice_width)})

    def masks(n: int) -> Column:
        found = variants(n, radius)
        return F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n - m.bit_count()).alias("score")) for m in found])

    each = F.coalesce(*[F.when(F.col("bits") == n, masks(n)) for n in widths])
    found = rows.select("doc_num", "slice", "val", F.inline(each))
    return found.select("doc_num", "slice", F.col("val").bitwiseXOR(F.col("mask")).alias("val"), "score")


def votes(
    signatures: DataFrame, slice_width: int = 16, radius: int = 1, first: int | None = None, last: int | None = None, queries: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """(query, found, votes) for each pair with any; queries are those given, or the signatures, numbered first to last. A signature finds itself.

    With ``index``, posting lists of build() with the same slice_width, lists are looked up there; else signatures are cut into slices.
    """
    asked = signatures if queries is None else queries
    asked = asked.where(F.col("doc_num") >= first) if first is not None else asked
    asked = asked.where(F.col("doc_num") <= last) if last is not None else asked
    q = probes(asked, slice_width, radius).withColumnRenamed("doc_num", "query")
    if index is None:
        met = q.join(slice_rows(signatures, slice_width).select(F.col("doc_num").alias("found"), "slice", "val"), ["slice", "val"])
    else:
        met = q.join(index.select("slice", "val", "postings"), ["slice", "val"]).select("query", "score", F.explode("postings").alias("found"))
    return met.groupBy("query", "found").agg(F.sum("score").cast("bigint").alias("votes"))


class _Most:
    """The k of most votes of each query so far, of equal ones those of the least numbers."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.zeros(queries, dtype=np.int64)
        self.query, self.votes, self.found = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Rows (query, votes, numbers) of a block."""
        query = np.concatenate([self.query, *(np.full(len(v), q) for q, v, _ in rows)])
        votes, found = (np.concatenate([own, *(r[i] for r in rows)]) for own, i in ((self.votes, 1), (self.found, 2)))
        by = np.lexsort((found, -votes, query))
        query = query[by]
        first = np.searchsorted(query, np.arange(len(self.least)))
        nth = np.arange(len(query)) - first[query]
        by = by[nth < self.k]
        self.query, self.votes, self.found = query[nth < self.k], votes[by], found[by]
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.least)) == self.k)
        self.least[full] = self.votes[np.searchsorted(self.query, full, "right") - 1]


def most_votes(
    signatures: DataFrame, k: int, slice_width: int = 16, radius: int = 1, first: int | None = None, last: int | None = None, queries: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """(query, found, votes) of votes(), the k of most votes of each query, equal ones by number; made without a row for each pair."""
    asked = signatures if queries is None else queries
    asked = asked.where(F.col("doc_num") >= first) if first is not None else asked
    asked = asked.where(F.col("doc_num") <= last) if last is not None else asked
    words, spark = word_columns(signatures.columns), signatures.sparkSession
    cuts, cores = layout(64 * len(words), slice_width), signatures.sparkSession.sparkContext.defaultParallelism
    masks = [[(m, b - a - m.bit_count()) for m in variants(b - a, radius)] for a, b in cuts]
    values = F.array(*[slice_value([F.col(n) for n in words], a, b) for a, b in cuts])
    q = asked.select(F.col("doc_num").cast("long").alias("id"), values.alias("v"))
    most = max(1, min(ASKED, HELD // k, max(32, -(-q.count() // (4 * cores)))))
    q = cut(blocks(q, ["id"], [F.col("id")], ["id", "v"], ["id", "v"], most, "q_"), "queries")
    count = q.count()
    parts = max(1, -(-cores // max(1, count)))
    if index is None:
        rows = slice_rows(signatures, slice_width).select(F.col("doc_num").alias("found"), "slice", "val")
    else:
        rows = index.select("slice", "val", F.explode("postings").alias("found"))
    block = F.pmod(F.xxhash64(F.lit(17), "found"), F.lit(max(1, -(-signatures.count() // LISTED)))).alias("block")
    lists = rows.select(block, F.col("slice").cast("int").alias("slice"), F.struct(F.col("val"), F.col("found").cast("long").alias("found")).alias("x"))
    lists = lists.groupBy("block", "slice").agg(F.sort_array(F.collect_list("x")).alias("x"))
    lists = lists.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", F.col("x.val").alias("val"), F.col("x.found").alias("found")))).alias("x"))
    path, there = in_parts(lists.select("block", "x.slice", "x.val", "x.found"), "block", parts)

    def met(asks: np.ndarray, best: _Most, numbers: list[np.ndarray], vals: list[np.ndarray], at: list[int]) -> None:
        known = np.unique(np.concatenate(numbers))
        places = [np.searchsorted(known, n) for n in numbers]
        spans = []
        for i, v in zip(at, vals, strict=True):
            looked = asks[:, i, None] ^ np.array([m for m, _ in masks[i]])
            spans.append((np.searchsorted(v, looked).tolist(), np.searchsorted(v, looked, "right").tolist(), [x + (1 << 32) for _, x in masks[i]]))
        rows = []
        for n in range(len(asks)):
            votes = np.zeros(len(known), dtype=np.int64)  # and above 32 bits how often a signature was met
            for place, (a, b, scores) in zip(places, spans, strict=True):
                for x, y, score in zip(a[n], b[n], scores, strict=True):
                    if x < y:
                        votes[place[x:y]] += score
            own = np.flatnonzero(votes)
            votes = votes[own] & 0xFFFFFFFF
            upto = np.cumsum(np.bincount(votes, minlength=1)[::-1])[::-1]  # how many have so many votes at least
            least = max(int(best.least[n]), int(np.searchsorted(-upto, -k, "right")) - 1)
            over, even = np.flatnonzero(votes > least), np.flatnonzero(votes == least)[:k]
            kept = np.concatenate([over, even])
            rows.append((n, votes[kept], known[own[kept]]))
        best.add(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                asks, ids = np.stack(row.q_v).astype(np.int64), np.asarray(row.q_id)
                best = _Most(len(asks), k)
                for batch in stored(f"{path}/part={row.part}", ["slice", "val", "found"], 1):
                    for i in range(len(batch)):
                        at, vals, numbers = (batch.column(c).slice(i, 1).flatten() for c in ("slice", "val", "found"))
                        met(asks, best, [x.values.to_numpy() for x in numbers], [x.values.to_numpy().astype(np.int64) for x in vals], at.to_pylist())
                yield pd.DataFrame({"query": ids[best.query], "found": best.found, "votes": best.votes})

    return q.crossJoin(F.broadcast(there)).repartition(count * parts or 1).mapInPandas(run, "query long, found long, votes long")


def search(
    signatures: DataFrame, k: int = 10, rerank_k: int | None = None, slice_width: int = 16, radius: int = 1, first: int | None = None, last: int | None = None,
    queries: DataFrame | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """(doc_num, found_num, dist, rank): of the rerank_k signatures with most votes (k, if more) the k nearest of each query.

    Equal votes and equal distances go by number. A query has at most as many rows as signatures got votes.
    """
    rerank_k = max(k, rerank_k or k)
    most = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("votes"), "found"))  # tasks give as many for each part of the lists
    kept = most_votes(signatures, rerank_k, slice_width, radius, first, last, queries, index).withColumn("place", most).where(F.col("place") <= rerank_k)
    names = word_columns(signatures.columns)
    a = (signatures if queries is None else queries).select(F.col("doc_num").alias("query"), *[F.col(n).alias(f"a{n}") for n in names])
    b = signatures.select(F.col("doc_num").alias("found"), *[F.col(n).alias(f"b{n}") for n in names])
    met = kept.join(b, "found").join(a, "query")
    dist = hamming([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "found"))
    found = met.select("query", "found", dist.alias("dist")).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("query").alias("doc_num"), F.col("found").alias("found_num"), "dist", "rank")
