"""Ranked runs: merging, removal of duplicates, evaluation against a truth, detection of copied passages, annotation.

A run has a row for each result: topic_id, doc_id, rank, score, run, hd; some have offset_begin and offset_end.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import cut, saved, stored

#: Documents and terms of documents that cosine_pairs() holds, and queries that it takes at once.
DOCS, POSTINGS, ASKED = 4096, 4_000_000, 256
RUN_LINE = r"^(\S+)\s+(\S+)\s+(\S+)\s+(-?\d+)\s+(-?\d+)\s+(\S+)\s+(-?\d+)(?:\s+(-?\d+)\s+(-?\d+))?"


def parsed(lines: DataFrame) -> DataFrame:
    """Rows of text lines (value) ``topic Q0 doc rank score run hd [begin end]``; other lines are left out."""
    part = lambda i: F.regexp_extract("value", RUN_LINE, i)
    whole = lambda i: part(i).try_cast("int")
    rows = lines.where(F.col("value").rlike(RUN_LINE))
    return rows.select(
        part(1).alias("topic_id"), part(3).alias("doc_id"), whole(4).alias("rank"), whole(5).alias("score"), part(6).alias("run"), whole(7).alias("hd"),
        whole(8).alias("offset_begin"), whole(9).alias("offset_end"),
    )


def merged(run: DataFrame, k: int | None = None, hard: bool = False) -> DataFrame:
    """(topic_id, doc_id, rank, score, run, hd, count): a document once a topic, at its least distance.

    Ordered by distance, then how often it was found, most first. The first k stay, with all that tie with the k-th unless ``hard``.
    Ties are numbered by doc_id.
    """
    best = run.groupBy("topic_id", "doc_id").agg(F.min("hd").alias("hd"), F.count(F.lit(1)).alias("count"), F.min("run").alias("run"))
    order = Window.partitionBy("topic_id").orderBy("hd", F.desc("count"))
    rows = best.withColumn("rank", F.row_number().over(order.orderBy("hd", F.desc("count"), "doc_id"))).withColumn("tied", F.rank().over(order))
    if k is not None:
        rows = rows.where(F.col("rank" if hard else "tied") <= k)
    return rows.select("topic_id", "doc_id", "rank", (1_000_001 - F.col("rank")).alias("score"), "run", "hd", "count")


def percent_histogram(merged_run: DataFrame) -> DataFrame:
    """(pct, n): results named ``name_PCT`` whose name is that of their topic, by percentage, 1 to 100."""
    name, pct = F.split("doc_id", "_", 2)[0], F.regexp_extract("doc_id", r"_(\d+)", 1).try_cast("int")
    own = merged_run.where(F.col("doc_id").contains("_") & F.startswith(F.col("topic_id"), name))
    counts = own.groupBy(pct.alias("p")).agg(F.count(F.lit(1)).alias("c"))
    all_ = merged_run.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("pct"))
    return all_.join(counts, F.col("pct") == F.col("p"), "left").select("pct", F.coalesce("c", F.lit(0)).alias("n"))


def focused_histogram(run: DataFrame, k: int | None = None, hard: bool = False) -> DataFrame:
    """(pct, n) as percent_histogram(), where each percentage is ranked without the topic's results of all others."""
    name, pct = F.split("doc_id", "_", 2)[0], F.regexp_extract("doc_id", r"_(\d+)", 1).try_cast("int")
    own = F.col("doc_id").contains("_") & F.startswith(F.col("topic_id"), name)
    best = merged(run).withColumn("own", own).withColumn("pct", F.when(own, pct))
    # a result of percentage p ranks behind all that are no own results, and own results of p, before it
    order = Window.partitionBy("topic_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    others = F.sum((~F.col("own")).cast("int")).over(order)
    mine = F.sum("own1").over(Window.partitionBy("topic_id", "pct").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = best.withColumn("own1", F.col("own").cast("int")).withColumn("others", others).withColumn("place", F.col("others") + mine).where("own")
    if k is not None:
        rows = rows.where(F.col("place") <= k)
    counts = rows.groupBy(F.col("pct").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    all_ = run.sparkSession.range(1, 101).select(F.col("id").cast("int").alias("pct"))
    return all_.join(counts, F.col("pct") == F.col("p"), "left").select("pct", F.coalesce("c", F.lit(0)).alias("n"))


def without_duplicates(run: DataFrame, k: int | None = None) -> DataFrame:
    """(topic_id, doc_id, rank, score, run, hd): of each topic's documents the nearest row, ordered by distance and name, the first k."""
    best = run.groupBy("topic_id", "doc_id").agg(F.min(F.struct("hd", "rank", "run")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy("m.hd", "doc_id"))
    rows = best.withColumn("rank", rank)
    rows = rows if k is None else rows.where(F.col("rank") <= k)
    return rows.select("topic_id", "doc_id", "rank", (1_000_001 - F.col("rank")).alias("score"), F.col("m.run").alias("run"), F.col("m.hd").alias("hd"))


def distance_ratio(truth: DataFrame, found: DataFrame, ranks: int = 100) -> DataFrame:
    """(rank, ratio, topics): up to each rank, the sum of true distances over that of found ones, a mean over topics; 1 where the latter is 0.

    Rows are paired by topic and rank; a rank counts the topics that have it in both runs.
    """
    pairs = truth.select("topic_id", "rank", F.col("hd").alias("t")).join(found.select("topic_id", "rank", F.col("hd").alias("f")), ["topic_id", "rank"])
    upto = Window.partitionBy("topic_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = pairs.where(F.col("rank") <= ranks).select("topic_id", "rank", F.sum("t").over(upto).alias("t"), F.sum("f").over(upto).alias("f"))
    ratio = F.when(F.col("f") > 0, F.col("t") / F.col("f")).otherwise(F.lit(1.0))
    return sums.groupBy("rank").agg(F.avg(ratio).alias("ratio"), F.count(F.lit(1)).alias("topics"))


def cosine_distances(truth: DataFrame, width: int, cosine: str = "csim") -> DataFrame:
    """A run whose hd is the whole part of (1 - cosine) * width."""
    return truth.withColumn("hd", ((1.0 - F.col(cosine)) * width).cast("int"))


class _Postings:
    """Some documents' terms, turned round: for each term its documents and counts. Terms of more than an eighth of them are rows of a matrix."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.size = len(terms)
        keys, docs = np.concatenate(terms), np.repeat(np.arange(self.size), [len(t) for t in terms])
        order = np.argsort(keys, kind="stable")
        self.docs, self.counts = docs[order], np.concatenate(counts)[order].astype(np.float64)
        self.terms, self.first, self.n = np.unique(keys[order], return_index=True, return_counts=True)
        hot = np.flatnonzero(self.n * 8 > self.size)
        self.row = np.full(len(self.terms), -1)
        self.row[hot] = np.arange(len(hot))
        self.matrix = np.zeros((len(hot), self.size))
        for i, t in enumerate(hot):
            at = slice(self.first[t], self.first[t] + self.n[t])
            self.matrix[i, self.docs[at]] = self.counts[at]

    def dots(self, terms: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Products of other documents with these; of whole numbers, so exact in any order."""
        out, often = np.zeros((len(terms), self.size)), np.zeros((len(terms), len(self.matrix)))
        for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
            at = np.searchsorted(self.terms, t)
            met = np.flatnonzero(self.terms[np.minimum(at, len(self.terms) - 1)] == t)
            at, c = at[met], c[met].astype(np.float64)
            hot = self.row[at] >= 0
            often[i, self.row[at[hot]]] = c[hot]
            first, n, c = self.first[at[~hot]], self.n[at[~hot]], c[~hot]
            places = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[i] = np.bincount(self.docs[places], self.counts[places] * np.repeat(c, n), self.size)
        return out + often @ self.matrix


def _seed(terms: DataFrame) -> int:
    """A seed with which different terms have different hashes."""
    seed = 42
    while terms.groupBy(F.xxhash64(F.lit(seed), "term")).agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a != b").take(1):
        seed += 1
    return seed


def cosine_pairs(terms: DataFrame, every: int | None = None) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of documents that share a term; terms: (doc_id, term, cnt). With ``every``, a number, documents
    whose id is divisible by it are queries a against all others, on either side.

    Each task turns round the terms of up to DOCS documents and takes the queries, which it reads from the shared folder, ASKED at a time:
    what is held does not grow with the input, and no pair is shuffled; only the rows that are asked for, which are quadratic, are made."""
    spark, terms = terms.sparkSession, terms.where("doc_id IS NOT NULL AND term IS NOT NULL")
    each = F.struct(F.xxhash64(F.lit(_seed(terms)), "term").alias("h"), F.col("cnt").cast("long").alias("c"))
    own = terms.groupBy("doc_id").agg(F.collect_list(each).alias("x"), F.sqrt(F.sum(F.col("cnt") * F.col("cnt")).cast("double")).alias("norm"))
    docs = cut(own.select("doc_id", F.col("x.h").alias("terms"), F.col("x.c").alias("counts"), "norm"), "vectors")
    asked = saved(docs if every is None else docs.where(F.col("doc_id") % every == 0), "queries")
    n, kind, columns = docs.count(), dict(docs.dtypes)["doc_id"], ["doc_id", "terms", "counts", "norm"]
    parts = max(-(-n // DOCS), min(2 * spark.sparkContext.defaultParallelism, -(-n // 64)), 1)

    def lists(column: pa.Array) -> list[np.ndarray]:
        return np.split(column.flatten().to_numpy(), column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py())

    def met(block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        held, b, norms = _Postings(list(block["terms"]), list(block["counts"])), block["doc_id"].to_numpy(), block["norm"].to_numpy()
        for batch in stored(asked, columns, ASKED):
            a, own = batch["doc_id"].to_pandas().to_numpy(), batch["norm"].to_numpy()
            dots = held.dots(lists(batch["terms"]), lists(batch["counts"]))
            kept = dots > 0
            kept &= a[:, None] < b[None, :] if every is None else a[:, None] != b[None, :]
            i, j = np.nonzero(kept)
            yield pd.DataFrame({"a": a[i], "b": b[j], "cosine": dots[i, j] / (own[i] * norms[j])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[pd.DataFrame] = []
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                block.append(pdf.iloc[at : at + 256])
                if sum(map(len, block)) >= DOCS or sum(int(x["terms"].map(len).sum()) for x in block) >= POSTINGS:
                    yield from met(pd.concat(block))
                    block = []
        if block:
            yield from met(pd.concat(block))

    return docs.repartition(parts).mapInPandas(run, f"a {kind}, b {kind}, cosine double")


def _by_text(df: DataFrame, text: str | None) -> DataFrame:
    """df with the column ``__text``, which tells texts apart; all rows are of one without it."""
    return df.withColumn("__text", F.lit(0) if text is None else F.col(text))


def source_votes(run: DataFrame, res_threshold: int = 8, share: float = 0.02, run_length: int = 0, run_rank: int = 100, text: str | None = None) -> DataFrame:
    """(doc_id, votes, longest, source): how often a document is among the first res_threshold, in how many topics in a row it is among the
    first run_rank, and whether both are enough for a source of copies. Topics are one text's sentences, by their offsets (topic_num); with
    ``text``, a column of run, of each of its texts, and the result has it too."""
    run, key = _by_text(run, text), ["__text", "doc_id"]
    order = Window.partitionBy("__text").orderBy("topic_num")
    places = run.select("__text", "topic_num").distinct().withColumn("place", F.row_number().over(order))
    votes = run.groupBy(*key).agg(F.sum((F.col("rank") <= res_threshold).cast("int")).alias("votes"))
    total = votes.groupBy("__text").agg(F.sum("votes").alias("total"))
    seen = run.where(F.col("rank") <= run_rank).select("topic_num", *key).distinct().join(places, ["__text", "topic_num"])
    island = F.col("place") - F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    runs = seen.withColumn("island", island).groupBy(*key, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max("n").alias("longest"))
    met = votes.join(runs, key, "left").join(total, "__text").withColumn("longest", F.coalesce("longest", F.lit(0)))
    enough = (F.col("votes") >= F.col("total") * share) & (F.col("longest") >= run_length)
    return met.select(*([] if text is None else [F.col("__text").alias(text)]), "doc_id", "votes", "longest", enough.alias("source"))


def copied_spans(run: DataFrame, votes: DataFrame, vote_threshold: int = 8, text: str | None = None) -> DataFrame:
    """(source, begin, length, source_begin, source_length): neighbouring sentences whose first source among vote_threshold results is the same.

    Sentences without a source don't part neighbours. A sentence reaches to the next one; the last has no length. text as of source_votes().
    """
    run, votes = _by_text(run, text), _by_text(votes, text)
    order = Window.partitionBy("__text").orderBy("topic_num")
    texts = run.select("__text", "topic_num").distinct().withColumn("next", F.lead("topic_num").over(order))
    named = run.where(F.col("rank") <= vote_threshold).join(votes.where("source").select("__text", "doc_id"), ["__text", "doc_id"], "left_semi")
    first = named.groupBy("__text", "topic_num").agg(F.min(F.struct("rank", "doc_id", "offset_begin", "offset_end")).alias("m"))
    rows = first.join(texts, ["__text", "topic_num"])
    rows = rows.select("__text", "topic_num", F.coalesce("next", "topic_num").alias("upto"), "m.doc_id", "m.offset_begin", "m.offset_end")
    new = (F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))).cast("int")
    groups = rows.withColumn("new", 1 - new).withColumn("span", F.sum("new").over(order))
    spans = groups.groupBy("__text", "span", "doc_id").agg(
        F.min("topic_num").alias("begin"), F.max("upto").alias("upto"), F.min("offset_begin").alias("sb"), F.max("offset_end").alias("se")
    )
    return spans.select(
        *([] if text is None else [F.col("__text").alias(text)]), F.col("doc_id").alias("source"), "begin", (F.col("upto") - F.col("begin")).alias("length"),
        F.col("sb").alias("source_begin"), (F.col("se") - F.col("sb")).alias("source_length"),
    )


def span_lines(spans: DataFrame) -> DataFrame:
    """(begin, value): spans as XML elements."""
    text = F.format_string(
        '<feature name="detected-plagiarism" this_offset="%s" this_length="%s" source_reference="%s.txt" source_offset="%s" source_length="%s" />',
        *[F.col(c).cast("string") for c in ("begin", "length", "source", "source_begin", "source_length")],
    )
    return spans.select("begin", text.alias("value"))


def span_report(spans: list[tuple], title: str = "Copied passages") -> str:
    """An HTML table of collected spans."""
    heads = ("source", "begin", "length", "source begin", "source length")
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
    return f"<h1>{html.escape(title)}</h1>\n<table>\n" + "\n".join([row(heads, "th"), *(row(s, "td") for s in spans)]) + "\n</table>\n"


def vote_errors(votes: DataFrame, truth: DataFrame) -> DataFrame:
    """(true_positives, false_positives, false_negatives, true_negatives) of sources among the documents voted on; truth: (doc_id)."""
    met = votes.join(truth.select("doc_id").distinct().withColumn("real", F.lit(True)), "doc_id", "left")
    real, said = F.coalesce("real", F.lit(False)), F.col("source")
    count = lambda c, name: F.coalesce(F.sum(c.cast("int")), F.lit(0)).alias(name)
    return met.agg(count(said & real, "true_positives"), count(said & ~real, "false_positives"), count(~said & real, "false_negatives"), count(~said & ~real, "true_negatives"))


def cluster_pairs(clusters: DataFrame, is_source: Column) -> DataFrame:
    """(cluster, pairs): pairs of a source and another document in each cluster."""
    n = F.sum(is_source.cast("bigint"))
    return clusters.groupBy("cluster").agg((n * (F.count(F.lit(1)) - n)).alias("pairs"))


def category_tags(docs: DataFrame, column: str, least: int = 1000) -> DataFrame:
    """(doc_id, tag): parts of a column between commas and line breaks, from their first letter on, that are used ``least`` times at least."""
    part = F.regexp_extract("part", r"(?s)[A-Za-z].*", 0)
    rows = docs.select("doc_id", F.explode(F.split(column, r"[,\n]")).alias("part")).select("doc_id", part.alias("tag")).where("tag != ''")
    often = rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return rows.join(often.select("tag"), "tag", "left_semi").select("doc_id", "tag")


def titled(run: DataFrame, titles: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """A run with the documents' ``title`` and, if topics (topic_id, title) are given, ``topic_title``; (unknown) where there is none."""
    one = lambda df, key: df.groupBy(key).agg(F.min("title").alias("__title"))
    out = run.join(one(titles, "doc_id"), "doc_id", "left").withColumn("title", F.coalesce("__title", F.lit("(unknown)"))).drop("__title")
    if topics is not None:
        out = out.join(one(topics, "topic_id"), "topic_id", "left").withColumn("topic_title", F.coalesce("__title", F.lit("(unknown)"))).drop("__title")
    return out


def linked(run: DataFrame, address: str) -> DataFrame:
    """(topic_id, rank, value): HTML links to ``address`` with the id behind; ids that aren't numbers are skipped."""
    rows = run.where(F.col("doc_id").cast("string").rlike(r"^\d+$"))
    link = F.concat(F.lit(f'<a href="{address}'), F.col("doc_id").cast("string"), F.lit('">'), F.col("doc_id").cast("string"), F.lit("</a>"))
    return rows.select("topic_id", "rank", link.alias("value"))


def named_topics(run: DataFrame, names: DataFrame) -> DataFrame:
    """A run whose topic_id, the number of a row, is replaced by that row's doc_id; names: (doc_num, doc_id)."""
    sides = names.select(F.col("doc_num").cast("string").alias("__num"), F.col("doc_id").cast("string").alias("__name"))
    met = run.join(sides, F.col("topic_id").cast("string") == F.col("__num"), "left")
    return met.withColumn("topic_id", F.coalesce("__name", F.col("topic_id").cast("string"))).drop("__num", "__name")


def zipped(columns: list[DataFrame]) -> DataFrame:
    """(pos, value): tokens of several texts (value) side by side with commas, as far as the shortest goes."""
    rows = None
    for i, df in enumerate(columns):
        one = df.select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", f"c{i}"))
        rows = one if rows is None else rows.join(one, "pos")
    return rows.select("pos", F.concat_ws(",", *[f"c{i}" for i in range(len(columns))]).alias("value"))
