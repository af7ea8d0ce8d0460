"""Relevance feedback: results of a search, re-ranked by signatures of documents that are taken, or known, to be relevant.

Results have topic_id, rank, dist, doc_num, doc_id, quality, offset_begin; all topics go through at once. A new query signature is the
sign, bit by bit, of a weighted sum of the sample's bits (-1 or 1); sums are rounded to 9 digits, so that they don't depend on the
order of adding. Then distances are taken over all bits, and only the part of the list that is re-ranked changes places.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.bits import WORD, hamming, word_columns

SCALES = ("default", "1", "1_i", "1_sqrt_i", "1_hamming", "1_sqrt_hamming", "e_-i")
METHODS = ("default", "freezing", "residual")


def scale(name: str, i: Column, dist: Column, sample: int, w: float = 8) -> Column:
    """The weight of the i-th of the sample, from 0; a distance of 0 counts as 1."""
    near = F.greatest(dist, F.lit(1))
    return {
        "default": F.exp(-(i * i) / F.lit(float(sample * w))),
        "1": F.lit(1.0),
        "1_i": 1.0 / (i + 1),
        "1_sqrt_i": 1.0 / F.sqrt(i + 1),
        "1_hamming": 1.0 / near,
        "1_sqrt_hamming": 1.0 / F.sqrt(near),
        "e_-i": F.exp(-(i + 1.0)),
    }[name]


def weighted_bits(sample: DataFrame, weight: str = "weight", key: str = "topic_id") -> DataFrame:
    """key and new words v0, v1, ...: each bit is set where the weighted sum of -1 and 1 is above 0."""
    names = word_columns(sample.columns)
    bit = lambda n, j: F.shiftrightunsigned(F.col(n), WORD - 1 - j).bitwiseAND(F.lit(1).cast("bigint"))
    rows = F.array(*[F.struct(F.lit(WORD * k + j).alias("pos"), (F.col(weight) * (bit(n, j) * 2 - 1)).alias("v")) for k, n in enumerate(names) for j in range(WORD)])
    sums = sample.select(key, F.inline(rows)).groupBy(key, "pos").agg(F.round(F.sum("v"), 9).alias("v")).where("v > 0")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.lit(WORD - 1) - F.col("pos") % WORD).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("pos") / WORD) == k, one)), F.lit(0).cast("bigint")).alias(f"v{k}") for k in range(len(names))]
    found = sums.groupBy(key).agg(*words)
    return sample.select(key).distinct().join(found, key, "left").select(key, *[F.coalesce(f"v{k}", F.lit(0).cast("bigint")).alias(f"v{k}") for k in range(len(names))])


def _with_words(results: DataFrame, signatures: DataFrame) -> DataFrame:
    return results.join(signatures.select("doc_num", *word_columns(signatures.columns)), "doc_num")


def _rerank(results: DataFrame, signatures: DataFrame, queries: DataFrame, first: Column, last: Column) -> DataFrame:
    """results whose ranks first to last are sorted again by the distance to the topic's new words; topics without new words stay."""
    names = word_columns(signatures.columns)
    met = _with_words(results, signatures).join(queries, "topic_id", "left")
    new = hamming([F.col(n) for n in names], [F.col(n.replace("w", "v")) for n in names])
    moving = F.col("rank").between(first, last) & F.col("v0").isNotNull()
    met = met.withColumn("moving", moving).withColumn("dist", F.when(moving, new).otherwise(F.col("dist")))
    order = Window.partitionBy("topic_id", "moving").orderBy("dist", F.desc("quality"), "doc_id", "offset_begin", "doc_num")
    start = F.min("rank").over(Window.partitionBy("topic_id", "moving"))
    rank = F.when(F.col("moving"), start + F.row_number().over(order) - 1).otherwise(F.col("rank"))
    return met.withColumn("rank", rank.cast("int")).select(*results.columns)


def blind(
    results: DataFrame, signatures: DataFrame, sample: int, rerank: int, w: float = 8, scaling: str = "default", method: str = "default",
    iterations: int = 1, negative: int = 0, ignore_first: int = 0,
) -> DataFrame:
    """Results after feedback from their own ranks ignore_first + 1 to ignore_first + sample; the last ``negative`` ones count against.

    The ranks up to rerank + ignore_first are sorted again (none for rerank 0, which changes nothing). freezing: the sample keeps its
    ranks; residual: it is taken out, and ranks close up. Samples and ranks beyond a topic's results are those there are.
    """
    if method not in METHODS or scaling not in SCALES:
        raise ValueError(f"no method {method!r} or scale {scaling!r}")
    sampled = F.col("rank").between(ignore_first + 1, ignore_first + sample)
    for step in range(iterations):
        i = F.col("rank") - 1 - ignore_first
        plus = _with_words(results, signatures).where(sampled).withColumn("weight", scale(scaling, i, F.col("dist"), sample, w))
        if negative:
            size = F.max("rank").over(Window.partitionBy("topic_id"))
            tail = _with_words(results.withColumn("size", size), signatures).where(F.col("rank") > F.col("size") - negative)
            minus = tail.withColumn("weight", -scale(scaling, F.col("size") - F.col("rank"), F.col("dist"), negative, w)).drop("size")
            plus = plus.unionByName(minus)
        queries = weighted_bits(plus.select("topic_id", "weight", *word_columns(signatures.columns)))
        if method == "residual" and step == 0:
            close = F.row_number().over(Window.partitionBy("topic_id").orderBy("rank"))
            left = results.where(~sampled).withColumn("rank", close)
            results = _rerank(left, signatures, queries, F.lit(1), F.lit(max(0, rerank + ignore_first - sample)))
        elif method == "residual":
            results = _rerank(results, signatures, queries, F.lit(1), F.lit(max(0, rerank + ignore_first - sample)))
        else:
            first = ignore_first + sample + 1 if method == "freezing" else 1
            results = _rerank(results, signatures, queries, F.lit(first), F.lit(rerank + ignore_first))
    return results


def by_class(
    results: DataFrame, signatures: DataFrame, classes: DataFrame, topics: DataFrame, rerank: int, only_relevant: bool = False,
    most_relevant: int = 2**31 - 1, most_irrelevant: int = 2**31 - 1, scaling: str = "default", w: float = 8,
) -> DataFrame:
    """Results after feedback from known classes (doc_id, class); topics (topic_id, class) name each topic's own class.

    Results of the topic's class add their bits, all others subtract theirs (or nothing, with only_relevant), in the order of ranks up
    to the two bounds.
    """
    own = topics.select("topic_id", F.col("class").alias("own"))
    known = classes.groupBy("doc_id").agg(F.min("class").alias("class"))
    met = _with_words(results, signatures).join(own, "topic_id", "left").join(known, "doc_id", "left")
    met = met.withColumn("relevant", F.coalesce(F.col("class") == F.col("own"), F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("topic_id", "relevant").orderBy("rank"))
    met = met.withColumn("nth", nth).where(F.when(F.col("relevant"), F.col("nth") <= most_relevant).otherwise((F.col("nth") <= most_irrelevant) & (not only_relevant)))
    size = F.count(F.lit(1)).over(Window.partitionBy("topic_id", "relevant"))
    i = F.col("nth") - 1
    weight = F.exp(-(i * i) / (size * w)) if scaling == "default" else scale(scaling, i, F.col("dist"), 1, w)
    met = met.withColumn("weight", F.when(F.col("relevant"), weight).otherwise(-weight))
    queries = weighted_bits(met.select("topic_id", "weight", *word_columns(signatures.columns)))
    return _rerank(results, signatures, queries, F.lit(1), F.lit(rerank))


def by_text(results: DataFrame, signatures: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Results whose first k are sorted by the masked distance to other query signatures (topic_id, w*, m*)."""
    names = word_columns(signatures.columns)
    asked = queries.select("topic_id", *[F.col(n).alias(n.replace("w", "v")) for n in names], *[n.replace("w", "m") for n in names])
    met = _with_words(results, signatures).join(asked, "topic_id", "left")
    new = hamming([F.col(n) for n in names], [F.col(n.replace("w", "v")) for n in names], [F.col(n.replace("w", "m")) for n in names])
    moving = (F.col("rank") <= k) & F.col("v0").isNotNull()
    met = met.withColumn("moving", moving).withColumn("dist", F.when(moving, new).otherwise(F.col("dist")))
    order = Window.partitionBy("topic_id", "moving").orderBy("dist", F.desc("quality"), "doc_id", "offset_begin", "doc_num")
    return met.withColumn("rank", F.when(F.col("moving"), F.row_number().over(order)).otherwise(F.col("rank")).cast("int")).select(*results.columns)


def refined(topics: DataFrame, invert: bool = False) -> tuple[DataFrame, DataFrame]:
    """The queries and the refining queries of topics (topic_id, text, refine); inverted, the texts change places."""
    sides = [topics.select("topic_id", F.col(c).alias("text")) for c in ("text", "refine")]
    return tuple(reversed(sides)) if invert else tuple(sides)


def scaled_sample(results: DataFrame, sample: int, scaling: str = "default", w: float = 8) -> DataFrame:
    """(topic_id, doc_num, rank, weight) of the first ``sample`` results."""
    own = results.where(F.col("rank") <= sample)
    weight = F.round(scale(scaling, F.col("rank") - 1, F.col("dist"), sample, w), 9)
    return own.select("topic_id", "doc_num", "rank", weight.alias("weight"))


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Results of several searches, one behind the other."""
    return reduce(DataFrame.unionByName, parts)
