"""Signatures of documents, of queries and of dense vectors.

A signature table has a row for each segment: doc_id, seg, unique_terms, doc_char_length, total_terms, quality, offset_begin,
offset_end, unused7, unused8 and the words w0, w1, ... of bits. numbered() adds doc_num, the row's number in the order of the ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import pack, positive_words, unpack, words
from sigloom.functions.text import clipped, stemmed, tokens
from sigloom.functions.tokenizer import Splitting, segment_rows
from sigloom.operators.terms import weight
from sigloom.operators.vectors import Projection, accumulated
from sigloom.session import cut

#: Terms whose statistics are broadcast.
COMMON = 100_000
META = ["unique_terms", "doc_char_length", "total_terms", "quality", "offset_begin", "offset_end", "unused7", "unused8"]


def _signed(terms: Column, weights: Column, p: Projection, mask: bool = False) -> Column:
    """struct<w: array<long>, m: array<long>>: signs of the weighted sum of the terms' vectors, and which of its numbers aren't 0."""

    @F.pandas_udf("struct<w: array<long>, m: array<long>>")
    def run(t: pd.Series, w: pd.Series) -> pd.DataFrame:
        sums = accumulated(list(t), list(w), p)
        return pd.DataFrame({"w": list(pack(sums > 0)), "m": list(pack(sums != 0)) if mask else None})

    return run(terms, weights)


def spread(df: DataFrame, array: str, names: list[str]) -> DataFrame:
    """The numbers of an array as columns."""
    return df.select(*[c for c in df.columns if c != array], *[F.get(array, F.lit(i)).alias(n) for i, n in enumerate(names)])


def collection_totals(stats: DataFrame) -> DataFrame:
    """One row: ``tokens``, the sum of all ctf."""
    return stats.agg(F.coalesce(F.sum("ctf"), F.lit(0)).alias("tokens"))


def with_stats(each: DataFrame, stats: DataFrame) -> DataFrame:
    """Rows of terms with their df and ctf, null where there are none. The COMMON terms of largest df meet them where they stand, so that only
    rows of rarer ones are shuffled by term, and no term's rows are many in one task."""
    known = stats.select("term", "df", "ctf")
    common = cut(known.orderBy(F.desc("df"), "term").limit(COMMON), "common")
    met = each.join(F.broadcast(common), "term", "left")
    rest = met.where("df IS NULL").drop("df", "ctf").join(known, "term", "left")
    return met.where("df IS NOT NULL").unionByName(rest)


def build(
    docs: DataFrame,
    projection: Projection = Projection(),
    stats: DataFrame | None = None,
    scheme: str = "loglik",
    multiplier: bool = False,
    splitting: Splitting = Splitting(),
    longest_name: int = 255,
    overlap: bool = False,
    **options: object,
) -> DataFrame:
    """Signatures of documents (doc_id, text); options as of the tokenizer.

    Without term statistics (term, df, ctf) each term weighs its count, and nothing is shuffled. With them terms join statistics by
    term and come back by segment; the vectors themselves are made in the workers, not moved. multiplier: terms like ``word:3.5`` are
    weighted by their number. overlap: segments also have the terms of the one before. Ids that are strings are clipped to longest_name. Documents without terms have no row.
    """
    rows = segment_rows(docs, splitting=splitting, places=False, overlap=overlap, **options)
    meta = ["doc_id", "seg", "unique_terms", "total_terms", "doc_char_length", "offset_begin", "offset_end"]
    factor = lambda t: F.coalesce(F.get(F.split(t, ":", 2), F.lit(1)).try_cast("double"), F.lit(1.0)) if multiplier else F.lit(1.0)
    name = lambda t: F.split(t, ":", 2)[0] if multiplier else t
    if stats is None:
        weights = F.zip_with("terms", "counts", lambda t, c: (c * 1000 * factor(t)).cast("bigint"))
        given = rows.select(*meta, F.transform("terms", name).alias("terms"), weights.alias("weights"))
    else:
        rows = cut(rows, "segments")  # else texts are scanned twice
        each = rows.select("doc_id", "seg", F.inline(F.arrays_zip("terms", "counts", "totals")).alias("raw", "cnt", "total"))
        each = each.select("doc_id", "seg", "total", "cnt", name(F.col("raw")).alias("term"), factor(F.col("raw")).alias("factor"))
        documents = rows.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("signatures")) if scheme in ("tfidf", "bm25") else None
        met = with_stats(each, stats).crossJoin(F.broadcast(collection_totals(stats)))
        met = met.withColumn("signatures", F.lit(None).cast("bigint")) if documents is None else met.crossJoin(F.broadcast(documents))
        base = weight(scheme, F.col("cnt"), F.col("total"), F.col("ctf"), F.col("df"), F.col("tokens"), F.col("signatures"))
        met = met.select("doc_id", "seg", F.struct("term", (base * F.col("factor")).cast("bigint").alias("weight")).alias("x"))
        found = met.groupBy("doc_id", "seg").agg(F.sort_array(F.collect_list("x")).alias("x"))
        found = found.select("doc_id", "seg", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
        given = rows.select(*meta).join(found, ["doc_id", "seg"])
    signed = given.select(*meta, _signed(F.col("terms"), F.col("weights"), projection)["w"].alias("w"))
    doc_id = clipped(F.col("doc_id"), longest_name).alias("doc_id") if dict(docs.dtypes)["doc_id"] == "string" else F.col("doc_id")
    zero = F.lit(0).alias("unused7"), F.lit(0).alias("unused8")
    columns = ["unique_terms", "doc_char_length", F.col("total_terms").cast("int").alias("total_terms"), F.col("doc_char_length").alias("quality")]
    return spread(signed.select(doc_id, "seg", *columns, "offset_begin", "offset_end", *zero, "w"), "w", words(projection.width))


def from_vectors(df: DataFrame, vector: str, width: int, keep: list[str]) -> DataFrame:
    """keep and the words of an array of numbers: bits are the signs of its first ``width`` numbers. A null vector has no bits."""
    return df.select(*keep, *[w.alias(n) for w, n in zip(positive_words(F.col(vector), width), words(width), strict=True)])


def numbered(signatures: DataFrame, *order: str) -> DataFrame:
    """With doc_num: 0, 1, ... in order. Ranges are numbered by themselves and get their start from the counts of those before."""
    order = order or ("doc_id", "seg")
    sorted_ = cut(signatures, "unnumbered").orderBy(*order)  # sorting takes a sample first, which would make the signatures twice
    sorted_ = sorted_.withColumn("__part", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id())
    kept = cut(sorted_, "numbered")
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__own").alias("first"))  # a row for each task
    starts = sizes.select("__part", "first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    met = kept.join(F.broadcast(starts), "__part")
    return met.select((F.col("before") + F.col("__own") - F.col("first")).cast("bigint").alias("doc_num"), *signatures.columns)


def query_signatures(
    topics: DataFrame, projection: Projection = Projection(), stats: DataFrame | None = None, scheme: str = "loglik", mask: str = "alnum",
    stemmer: str = "none", stopwords: list[str] | None = None, text: str = "text",
) -> DataFrame:
    """topics (topic_id, ...) with the words w* of their signatures and m* of their masks.

    Every occurrence of a token counts once, with a segment of three tokens in the weight; repeats add up. Markup is not filtered.
    A topic without known words has an empty mask, so everything is at distance 0.
    """
    kept = [c for c in topics.columns if c != text]
    rows = topics.select("topic_id", F.explode(tokens(F.col(text).cast("string"), mask, longest=1 << 30)).alias("term"))
    rows = stemmed(rows, stemmer)
    if stopwords:
        rows = rows.where(~F.col("term").isin(stopwords))
    counts = rows.groupBy("topic_id", "term").agg(F.count(F.lit(1)).alias("n"))
    if stats is None:
        weighed = counts.withColumn("weight", F.col("n") * 1000)
    else:
        met = counts.join(stats.select("term", "df", "ctf"), "term", "left").crossJoin(F.broadcast(collection_totals(stats)))
        one = weight(scheme, F.lit(1), F.lit(3), F.col("ctf"), F.col("df"), F.col("tokens"), F.lit(None).cast("bigint"))
        weighed = met.withColumn("weight", F.col("n") * one)
    lists = weighed.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x"))
    found = lists.select("topic_id", _signed(F.col("x.term"), F.col("x.weight"), projection, mask=True).alias("s"))
    names = words(projection.width)
    met = topics.select(*kept).join(found, "topic_id", "left")
    empty = lambda side, i: F.coalesce(F.get(F.col("s")[side], F.lit(i)), F.lit(0).cast("bigint"))
    bits = [empty("w", i).alias(n) for i, n in enumerate(names)]
    return met.select(*kept, *bits, *[empty("m", i).alias(n.replace("w", "m")) for i, n in enumerate(names)])


def random_bits(signatures: DataFrame, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """The same rows with random bits, which depend on the key and the seed only."""
    names = [c for c in signatures.columns if c.startswith("w") and c[1:].isdigit()]
    return signatures.withColumns({n: F.xxhash64(F.lit(seed), F.lit(n), F.col(key)) for n in names})


def dense(packed: np.ndarray) -> np.ndarray:
    """Words to -1 and 1."""
    return unpack(packed).astype(np.int8) * 2 - 1
