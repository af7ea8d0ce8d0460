"""Terms of documents, collection statistics and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.text import stemmed, tokens, without_markup, without_stopwords

AVERAGE_LENGTH, K1, B, SIGMA = 333.774137, 2.0, 0.75, -0.725
SCHEMES = ("count", "loglik", "tfidf", "bm25", "none")


def token_rows(docs: DataFrame, mask: str = "alnum", markup: bool = False, stemmer: str = "none", stopwords: DataFrame | None = None) -> DataFrame:
    """(doc_id, term), a row for each token that is no stopword; stays within code generation but for Porter's stems."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.explode(tokens(without_markup(text) if markup else text, mask)).alias("term"))
    rows = stemmed(rows, stemmer)
    return rows if stopwords is None else without_stopwords(rows, stopwords)


def doc_terms(docs: DataFrame, **options: object) -> DataFrame:
    """(doc_id, term, cnt); options as of token_rows(). Porter's stems are looked up for counted words, not for each occurrence."""
    stem = options.pop("stemmer", "none")
    if stem != "porter":
        return token_rows(docs, stemmer=stem, **options).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
    stopwords = options.pop("stopwords", None)
    rows = stemmed(token_rows(docs, **options).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt")), stem)
    rows = rows if stopwords is None else without_stopwords(rows, stopwords)
    return rows.groupBy("doc_id", "term").agg(F.sum("cnt").alias("cnt"))


def doc_totals(terms: DataFrame) -> DataFrame:
    """(doc_id, unique_terms, total_terms)."""
    return terms.groupBy("doc_id").agg(F.count(F.lit(1)).alias("unique_terms"), F.sum("cnt").alias("total_terms"))


def term_stats(terms: DataFrame) -> DataFrame:
    """(term, df, ctf) of terms in more than one document."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("cnt").alias("ctf")).where("df > 1")


def weight(scheme: str, cnt: Column, total: Column, ctf: Column, df: Column, tokens_: Column, signatures: Column) -> Column:
    """A term's weight before any multiplier, as a whole number.

    total: tokens of the segment; ctf and df null where the collection doesn't know the term; tokens_: sum of all ctf.
    """
    cut = lambda x: x.cast("bigint")
    if scheme == "count":
        return cut(cnt * 1000)
    if scheme == "none":
        return cut(cnt)
    if scheme == "loglik":
        ll = F.ln(cnt / total * tokens_ / F.coalesce(ctf, cnt))
        return F.when(ll > 0, cut(ll * (cnt - 0.5) * 1000)).otherwise(cut(cnt * 1000))
    rare = F.coalesce(df, F.lit(0))
    if scheme == "tfidf":
        return cut(cnt * F.greatest(F.lit(0.0), F.ln(signatures / (rare + 1))) * 1000)
    if scheme == "bm25":
        tf = cnt * (K1 + 1) / (cnt + K1 * (1 - B + B * total / AVERAGE_LENGTH)) + SIGMA
        idf = F.ln(F.greatest((signatures - rare + 0.5) / (rare + 0.5), F.lit(1e-300)))
        return cut(F.greatest(F.lit(0.0), tf) * F.greatest(F.lit(0.0), idf) * 1000)
    raise ValueError(f"no weighting {scheme!r}")


def weighed(terms: DataFrame, stats: DataFrame, scheme: str = "loglik") -> DataFrame:
    """terms (doc_id, term, cnt) with ``weight``.

    Statistics join by term, so that their number is no matter; the two sums over the collection are one row, which is broadcast.
    """
    totals = doc_totals(terms).select("doc_id", "total_terms")
    whole = stats.agg(F.coalesce(F.sum("ctf"), F.lit(0)).alias("__tokens")).crossJoin(totals.agg(F.count(F.lit(1)).alias("__docs")))
    met = terms.join(totals, "doc_id").join(stats, "term", "left").crossJoin(F.broadcast(whole))
    found = weight(scheme, F.col("cnt"), F.col("total_terms"), F.col("ctf"), F.col("df"), F.col("__tokens"), F.col("__docs"))
    return met.select("doc_id", "term", "cnt", found.alias("weight"))
