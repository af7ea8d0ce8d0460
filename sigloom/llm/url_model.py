"""URL filter by the ratio of two character language models.

One variable-order Markov model is counted on accepted URLs and one on rejected ones. The probability of a character after a
context of ``order`` characters is smoothed by that after the context without its first character, and so on (Witten and Bell): a
context takes part as far as its class has seen it. A URL's score is the log-likelihood under the rejected model minus that under
the accepted one, divided by its length; it is calibrated on labelled URLs that were kept out of counting.

Counts are of all labelled URLs and live in tables; URLs meet them in joins on their distinct contexts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.features import fit_logistic
from sigloom.session import cut, table

ORDER, ALPHABET = 5, 256
#: Words that reject a URL, for want of labels, whose host has one of them as a whole, between dots or hyphens.
SEEDS = ("spam", "casino", "bets", "pills", "adult", "porn", "xxx", "viagra", "escort", "ads", "warez")
#: Held-out labelled URLs that calibration uses at most.
HELD = 20_000
_START, _STOP = "\x02", "\x03"


def plain(url: Column) -> Column:
    """Lower case, without scheme."""
    return F.regexp_replace(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://", "")


def seeded(pages: DataFrame) -> DataFrame:
    """Labels (page_id, accepted) for want of others: a host with a word of SEEDS is rejected. The model learns no more than such words then; real labels are better."""
    words = F.split(F.split(plain(F.col("url")), "[/?#]")[0], r"[.\-]")
    return pages.select("page_id", (~F.arrays_overlap(words, F.array(*map(F.lit, SEEDS)))).cast("int").alias("accepted"))


def grams(urls: DataFrame) -> DataFrame:
    """Rows of urls with ``gram``: each character with the ``ORDER`` characters before it; the end counts as one."""
    padded = F.concat(F.lit(_START * ORDER), F.col("u"), F.lit(_STOP))
    places = F.sequence(F.lit(1), F.length("u") + 1)
    return urls.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def contexts(known: DataFrame) -> DataFrame:
    """(context, character, a, r): how often a character follows a context, of 0 to ORDER characters, in accepted and in rejected URLs.

    known: (u, side) with side 1 accepted, 0 rejected, null unknown; grams of unknown URLs are there with 0, so that every gram
    that will be scored has all its shorter ones.
    """
    side = lambda x: F.coalesce((F.col("side") == x).cast("long"), F.lit(0))
    whole = grams(known).groupBy("gram").agg(F.sum(side(1)).alias("a"), F.sum(side(0)).alias("r"))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(ORDER + 1)), lambda i: F.substring("gram", i, F.lit(ORDER + 1)))
    rows = whole.select(F.explode(suffixes).alias("g"), "a", "r").groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return rows.select(F.expr("left(g, length(g) - 1)").alias("context"), F.expr("right(g, 1)").alias("character"), "a", "r")


def gram_scores(known: DataFrame) -> DataFrame:
    """(gram, ratio): log P(character | context; rejected) - log P(...; accepted) for every gram of the URLs in known."""
    counts = cut(contexts(known), "contexts")
    totals = counts.groupBy("context").agg(
        *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ar"]
    )
    full = cut(counts.join(totals, "context").withColumn("k", F.length("context")), "counts")
    below = None
    for k in range(ORDER + 1):
        rows = full.where(F.col("k") == k)
        if below is None:
            lower = {c: F.lit(1.0 / ALPHABET) for c in "ar"}
        else:
            rows = rows.join(below, F.concat(F.substring("context", 2, ORDER), "character") == F.col("g"))
            lower = {c: F.col(f"p{c}") for c in "ar"}
        smooth = {c: F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * lower[c]) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(lower[c]) for c in "ar"}
        below = rows.select(F.concat("context", "character").alias("g"), smooth["a"].alias("pa"), smooth["r"].alias("pr"))
    return below.select(F.col("g").alias("gram"), (F.log("pr") - F.log("pa")).alias("ratio"))


def filtered(pages: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, url, score, rejected, keep) for each row of pages.

    score is the log-likelihood difference a character (with the end), rejected the calibrated probability, keep whether it is
    below 1/2. labels: (page_id, accepted); without them seeded() gives them. Null URLs count as empty, with only an end. Rows of
    equal page_id are counted each, repeated rows get equal results; a page with a null id has no label of its own, is scored and isn't
    counted. A page with contrary labels is rejected. Where held-out labels
    lack a class, rejected is 1/2 * (1 + tanh(score)), which keeps negative scores and 0 goes. Empty tables give an empty result.
    """
    known = seeded(pages) if labels is None else labels
    known = known.groupBy("page_id").agg(F.min("accepted").cast("int").alias("side"))
    rows = pages.select("page_id", "url", plain(F.col("url")).alias("u")).join(known, "page_id", "left")
    held = F.pmod(F.xxhash64(F.lit(3), "u"), F.lit(5)) == 0
    urls = cut(rows.withColumn("held", held & F.col("side").isNotNull()).withColumn("key", F.xxhash64("u")), "urls")
    scores = cut(gram_scores(urls.select("u", F.when(~F.col("held"), F.col("side")).alias("side"))), "ratios")
    sums = grams(urls.select("key", "u").distinct()).select("key", "gram").join(scores, "gram").groupBy("key").agg(F.sum("ratio").alias("sum"))
    met = cut(urls.join(sums, "key").withColumn("score", F.round(F.col("sum") / (F.length("u") + 1), 9)), "scores")
    sample = met.where("held").select("key", "page_id", "side", "score").orderBy("key", "page_id").limit(HELD).toPandas()
    x, y = sample["score"].to_numpy(dtype=float), 1 - sample["side"].to_numpy(dtype=float)
    slope, shift = (2.0, 0.0) if len(np.unique(y)) < 2 else map(float, fit_logistic(x[:, None], y, ridge=0.01))
    rejected = 1 / (1 + F.exp(-F.greatest(F.least(F.col("score") * slope + shift, F.lit(30.0)), F.lit(-30.0))))
    return met.select("page_id", "url", "score", rejected.alias("rejected")).withColumn("keep", F.col("rejected") < 0.5)


def op3_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"))
