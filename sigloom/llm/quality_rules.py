"""Quality rules with risk-controlled thresholds.

Rules compare signals of a text with cutoffs. The cutoffs of all rules tighten together over the levels 1, 2, ... of a grid that
is fixed beforehand, so each document has one level: the first that rejects it. Variety is the ratio of the logarithms of different
and of all words, which a text's length hardly moves. In each stratum (language) the labelled good
documents are a holdout for the sequence of hypotheses "level i rejects more than ``alpha`` of the good documents". A level passes
if the exact binomial tail P(Bin(n, alpha) <= rejected) is at most delta / strata, which is the same as an upper Clopper-Pearson
bound of at most alpha. Levels are tested from lenient to strict until the first that fails (fixed-sequence testing, which needs
no further correction); the division by the number of strata (Bonferroni) covers the strata. So with probability 1 - delta no
stratum loses more than alpha of its good documents.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.names import fresh
from sigloom.session import cut, table

ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#$%&*|<>{}[]~^_=+@!"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of each signal whether large values are bad, and its cutoffs from lenient to strict.
GRID: dict[str, tuple[bool, tuple[float, ...]]] = {
    "symbols": (True, (0.30, 0.25, 0.20, 0.16, 0.13, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "capitals": (True, (0.70, 0.60, 0.50, 0.40, 0.30, 0.25, 0.20, 0.16, 0.13, 0.10, 0.08, 0.06)),
    "variety": (False, (0.30, 0.41, 0.48, 0.53, 0.59, 0.63, 0.67, 0.70, 0.73, 0.75, 0.78, 0.80)),
    "word_length": (True, (60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0)),
}
LEVELS = len(GRID["symbols"][1])


def signals(text: Column) -> dict[str, Column]:
    """What the signals are made of: words (n, kinds), shares of symbols and of capitals, size."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    count = lambda words: F.struct(F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("kinds"))
    words = F.transform(F.array(F.split(text, r"\s+")), count)[0]
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / size
    return {
        "words": words,
        "symbols": share(SYMBOLS),
        "capitals": share(CAPITALS),
        "size": F.length(text),
    }


def leveled(docs: DataFrame, level: str = "level") -> DataFrame:
    """docs with ``level``: the first level that rejects the text; LEVELS + 1 if none does.

    The signals pass through a generator of one row: a filter on the level can't be pushed through that, where it would compute the
    signals again for each cutoff.
    """
    (bag,) = fresh([*docs.columns, level], "signals")
    bound = docs.select("*", F.explode(F.array(F.struct(*[value.alias(name) for name, value in signals(F.col("text")).items()]))).alias(bag))
    s, w = F.col(bag), F.col(f"{bag}.words")
    signal = {"symbols": s["symbols"], "capitals": s["capitals"], "variety": F.log1p(w["kinds"]) / F.log1p(w["n"]), "word_length": s["size"] / w["n"]}
    each = []
    for name, (high, cutoffs) in GRID.items():
        value = signal[name]
        broken = [((value > c) if high else (value < c)).cast("int") for c in cutoffs]
        each.append(F.lit(LEVELS + 1) - reduce(Column.__add__, broken))
    return bound.withColumn(level, F.least(*each)).drop(bag)


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    terms = (
        math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1)
    )
    return math.fsum(terms)


def strictest(counts: dict[int, int], allowed: float, alpha: float) -> int:
    """The last level of those that pass before the first that fails. counts: labelled good documents by level."""
    n, k = sum(counts.values()), 0
    for i in range(1, LEVELS + 1):
        k += counts.get(i, 0)
        if k > alpha * n or tail(n, k, alpha) > allowed:  # above the mean the tail is larger than any delta in use
            return i - 1
    return LEVELS


def _levels(docs: DataFrame) -> DataFrame:
    return leveled(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")).select("doc_id", "lang", "level")


def thresholds(levels: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(lang, chosen) for each stratum with labelled good documents. levels: (doc_id, lang, level)."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    counts = cut(levels.join(good, "doc_id").groupBy("lang", "level").agg(F.count(F.lit(1)).alias("n")), "counts")
    strata = counts.select(F.coalesce("lang", F.lit("")).alias("l")).distinct().agg(F.count(F.lit(1)).alias("strata"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed = delta / int(pdf["strata"].iloc[0])
        found = strictest(dict(zip(pdf["level"], pdf["n"], strict=True)), allowed, alpha)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "chosen": [found]})

    return counts.crossJoin(F.broadcast(strata)).groupBy("lang").applyInPandas(choose, "lang string, chosen int")


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, lang, level, chosen, keep) for each row of docs.

    A stratum without enough labels rejects nothing (chosen 0); so does an empty label table. Null and empty texts break no rule.
    A null language is a stratum of its own. A document with several labels is good if all are. Labelled rows that are repeated
    in docs count each time.
    """
    levels = cut(_levels(docs), "levels")
    chosen = thresholds(levels, labels.select("doc_id", "quality"), alpha, delta).withColumnRenamed("lang", "stratum")
    met = levels.join(chosen, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    bar = F.coalesce("chosen", F.lit(0))
    return met.select("doc_id", "lang", "level", bar.alias("chosen"), (F.col("level") > bar).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns.

    Signals are computed once: rows are written with their levels, of which the thresholds read three narrow columns. Texts are not
    shuffled: strata are few and their bars are joined to them.
    """
    level, stratum, bar = fresh(docs.columns, "level", "stratum", "bar")
    rows = cut(leveled(docs, level), "leveled")
    levels = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col(level).alias("level"))
    chosen = cut(thresholds(levels, labels.select("doc_id", "quality"), alpha, delta), "bars")
    chosen = chosen.select(F.col("lang").alias(stratum), F.col("chosen").alias(bar))
    met = rows.join(chosen, F.col("lang").cast("string").eqNullSafe(F.col(stratum)), "left")
    return met.where(F.col(level) > F.coalesce(bar, F.lit(0))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_risk_controlled_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _sql() -> str:
    value = {
        "symbols": f"(length(t) - length(translate(t, '{SYMBOLS}', ''))) / greatest(length(t), 1)",
        "capitals": f"(length(t) - length(translate(t, '{CAPITALS}', ''))) / greatest(length(t), 1)",
        "variety": "ln(1 + len(list_distinct(ws))) / ln(1 + len(ws))",
        "word_length": "length(t) / len(ws)",
    }
    each = []
    for name, (high, cutoffs) in GRID.items():
        broken = " + ".join(f"({name} {'>' if high else '<'} {c}::DOUBLE)::INT" for c in cutoffs)
        each.append(f"{LEVELS + 1} - ({broken})")
    return f"""
WITH cutup AS (SELECT doc_id, lang, coalesce(text, '') AS t, string_split_regex(coalesce(text, ''), '\\s+') AS ws FROM documents),
signals AS (SELECT doc_id, lang, {", ".join(f"{v} AS {k}" for k, v in value.items())} FROM cutup),
levels AS (SELECT doc_id, lang, least({", ".join(each)}) AS level FROM signals),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
counts AS (SELECT lang, level, count(*) AS n FROM levels JOIN good USING (doc_id) GROUP BY ALL),
steps AS (
  SELECT l.lang, i, (SELECT count(DISTINCT coalesce(lang, '')) FROM counts) AS strata,
    (SELECT sum(n) FROM counts c WHERE c.lang IS NOT DISTINCT FROM l.lang)::INT AS n,
    coalesce((SELECT sum(n) FROM counts c WHERE c.lang IS NOT DISTINCT FROM l.lang AND c.level <= i), 0)::INT AS k
  FROM (SELECT DISTINCT lang FROM counts) l, range(1, {LEVELS + 1}) r(i)),
tested AS (
  SELECT *, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) <= {DELTA} / strata AS passed
  FROM steps),
chosen AS (SELECT lang, (coalesce(min(i) FILTER (NOT passed), {LEVELS + 1}) - 1)::INT AS chosen FROM tested GROUP BY lang)
SELECT d.doc_id, d.lang, d.level::INT AS level, coalesce(c.chosen, 0)::INT AS chosen, d.level > coalesce(c.chosen, 0) AS keep
FROM levels d LEFT JOIN chosen c ON d.lang IS NOT DISTINCT FROM c.lang
"""


SQL = _sql()
