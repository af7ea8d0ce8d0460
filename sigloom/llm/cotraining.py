"""A quality classifier by co-training.

Two logistic regressions look at different views of a document: features of its text, and its metadata (language, source, size).
Both start from labelled documents. In each round either classifier scores all documents without a label, and the ones it is most
sure of, some of each class, become training rows of the other. Finally each view's score is calibrated on labelled documents that
were kept out of training, and a regression on both calibrated scores, fitted on the same, combines them for all documents.

The views have nothing in common: the text's features leave out its length, which is metadata. Texts are read once, into a table of
features; rounds and scoring are arithmetic on its columns. Only chosen rows come to the driver: a histogram of confidence, and one of
the hash keys of the last step of it, tell which they are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.features import TEXT_FEATURES, fit_logistic, with_features
from sigloom.session import cut, table

#: Labelled documents used at most (those of least hash); rounds; pseudo-labels of each class that a view gives to the other in a round.
LABELLED, ROUNDS, GIVEN = 20_000, 3, 500
#: Steps of confidence (log-odds) in which pseudo-labels are chosen; within a step the least hash keys come first.
STEP, KEY_BITS = 0.01, 10
#: Pseudo-labels need this much confidence, and weigh less than labels.
CONFIDENT, WEIGHT = 0.95, 0.3
HASHED, LANGUAGES = 32, 16
THRESHOLD = 0.5

LEAST_LOGIT = float(np.log(CONFIDENT / (1 - CONFIDENT)))
_N = len(TEXT_FEATURES)
#: Features of the text view: all but the length.
_OWN = [i for i, name in enumerate(TEXT_FEATURES) if name != "log_words"]
_ROW = ["key", "source_bucket", "lang_bucket", "n_chars", *(f"f{i}" for i in range(_N))]


def feature_table(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source_bucket, lang_bucket, n_chars, f0, ...): text features by Python, everything else by Spark; nulls have buckets of their own."""

    def bucket(name: str, n: int) -> Column:
        value = F.col(name).cast("string")
        return F.when(value.isNull(), n).otherwise(F.pmod(F.xxhash64(value), F.lit(n))).cast("int").alias(f"{name}_bucket")

    n_chars = F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))
    key = F.xxhash64(F.lit(11), "doc_id").alias("key")
    given = docs.select("doc_id", key, bucket("source", HASHED), bucket("lang", LANGUAGES), n_chars.alias("n_chars"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    columns = ", ".join(f"f{i} float" for i in range(_N))
    return given.mapInPandas(with_features, f"doc_id {kind}, key long, source_bucket int, lang_bucket int, n_chars double, {columns}")


def text_view(rows: pd.DataFrame) -> np.ndarray:
    """Features and their squares."""
    x = rows[[f"f{i}" for i in _OWN]].to_numpy(dtype=float)
    return np.concatenate([x, x * x], axis=1)


def meta_view(rows: pd.DataFrame) -> np.ndarray:
    """One column for each bucket, and the size on a log scale with its square."""
    size = np.log1p(rows["n_chars"].to_numpy(dtype=float))[:, None] / 10
    one = [np.eye(n + 1)[rows[f"{name}_bucket"].to_numpy(dtype=int)] for name, n in (("source", HASHED), ("lang", LANGUAGES))]
    return np.concatenate([*one, size, size * size], axis=1)


def text_column(w: np.ndarray) -> Column:
    n = len(_OWN)
    return reduce(Column.__add__, [F.col(f"f{i}").cast("double") * (F.col(f"f{i}") * float(w[n + k]) + float(w[k])) for k, i in enumerate(_OWN)])


def meta_column(w: np.ndarray) -> Column:
    size = F.log1p("n_chars") / 10
    look = lambda part, name: F.get(F.array(*[F.lit(float(x)) for x in part]), F.col(f"{name}_bucket"))
    return look(w[: HASHED + 1], "source") + look(w[HASHED + 1 : -2], "lang") + size * (size * float(w[-1]) + float(w[-2]))


VIEWS = {"text": (text_view, text_column), "meta": (meta_view, meta_column)}


class View:
    """A standardised logistic regression on one view, as numpy and as a Spark column."""

    def __init__(self, name: str, rows: pd.DataFrame, weight: np.ndarray) -> None:
        self.matrix, self.expression = VIEWS[name]
        x = self.matrix(rows)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.weights = fit_logistic((x - self.mean) / self.scale, rows["y"].to_numpy(dtype=float), weight)

    def logits(self, rows: pd.DataFrame) -> np.ndarray:
        return np.clip((self.matrix(rows) - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)

    def column(self) -> Column:
        flat = self.weights[:-1] / self.scale
        total = self.expression(flat) + F.lit(float(self.weights[-1] - flat @ self.mean))
        return F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _training(rows: pd.DataFrame, extra: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    return pd.concat([rows, extra], ignore_index=True), np.concatenate([np.ones(len(rows)), np.full(len(extra), WEIGHT)])


def surest(rows: DataFrame, n: int) -> pd.DataFrame:
    """Of rows (key, doc_id, logit, ...) without labels, the n that are surest of either class, with ``y``.

    Order: steps of confidence, then key and doc_id. Exact, and no more than the chosen rows, with those that share the last bucket of
    keys, come to the driver.
    """
    rows = rows.where(F.abs("logit") >= LEAST_LOGIT).withColumn("step", F.floor(F.abs("logit") / STEP)).withColumn("y", (F.col("logit") > 0).cast("double"))
    rows = rows.withColumn("slot", F.shiftright("key", 64 - KEY_BITS))

    def last(counts: pd.DataFrame, by: str, wanted: int, ascending: bool) -> tuple[int, int]:
        """The value up to which ``wanted`` rows are reached, and how many are before it."""
        counts = counts.sort_values(by, ascending=ascending)
        upto = counts["n"].cumsum()
        i = min(int((upto < wanted).sum()), len(counts) - 1)
        return int(counts[by].iloc[i]), int(upto.iloc[i] - counts["n"].iloc[i])

    steps = rows.groupBy("y", "step").agg(F.count(F.lit(1)).alias("n")).toPandas()
    if not len(steps):
        return rows.limit(0).toPandas()
    edge = {y: last(own, "step", n, False) for y, own in steps.groupby("y")}
    at_edge = reduce(Column.__or__, [(F.col("y") == y) & (F.col("step") == step) for y, (step, _) in edge.items()])
    slots = rows.where(at_edge).groupBy("y", "slot").agg(F.count(F.lit(1)).alias("n")).toPandas()
    taken = []
    for y, own in slots.groupby("y"):
        step, before = edge[y]
        slot, _ = last(own, "slot", n - before, True)
        taken.append((F.col("y") == y) & ((F.col("step") > step) | ((F.col("step") == step) & (F.col("slot") <= slot))))
    found = rows.where(reduce(Column.__or__, taken)).toPandas()
    return found.sort_values(["y", "step", "key", "doc_id"], ascending=[True, False, True, True]).groupby("y").head(n).reset_index(drop=True)


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for each row of docs: probabilities of good quality of either view, and of both.

    Null columns count as values of their own, null texts as empty ones; repeated rows get equal scores; rows with a null id are scored
    and may be given pseudo-labels, but have no label. Of a document with several
    labels the least counts. Labels of one class only, or none, give the scores of that class's share (1 without labels), and so an
    empty label table keeps everything. An empty table gives an empty result.
    """
    truth = labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("y")).where("y is not null")
    everything = cut(cut(feature_table(docs), "features").join(truth, "doc_id", "left"), "labelled")
    known = cut(everything.where("y is not null").orderBy("key", "doc_id").limit(labelled), "known").toPandas().sort_values(["key", "doc_id"])
    hold = (known["key"].to_numpy() % 10 < 3) if len(known) else np.zeros(0, dtype=bool)
    train, held = known[~hold], known[hold]
    if train["y"].nunique() < 2 or held["y"].nunique() < 2:
        rate = float(known["y"].mean()) if len(known) else 1.0
        flat = F.lit(rate)
        return everything.select("doc_id", flat.alias("text_score"), flat.alias("meta_score"), flat.alias("score"), (flat >= THRESHOLD).alias("keep"))
    pool = everything.where("y is null")
    extra = {"text": train.iloc[:0], "meta": train.iloc[:0]}
    for step in range(rounds + 1):
        models = {k: View(k, *_training(train, extra[k])) for k in VIEWS}
        if step == rounds:
            break
        for giver, taker in (("text", "meta"), ("meta", "text")):
            extra[taker] = surest(pool.select("doc_id", *_ROW, models[giver].column().alias("logit")), given * (step + 1))
    # Platt's scaling of each view, then a regression on both
    y = held["y"].to_numpy()
    platt = {k: fit_logistic(m.logits(held)[:, None] / 10, y, ridge=0.01) for k, m in models.items()}
    both = np.stack([m.logits(held) / 10 * platt[k][0] + platt[k][1] for k, m in models.items()], axis=1).clip(-20, 20)
    mix = fit_logistic(both / 10, y, ridge=0.01)
    logit = {k: F.least(F.greatest(m.column() / 10 * float(platt[k][0]) + float(platt[k][1]), F.lit(-20.0)), F.lit(20.0)) for k, m in models.items()}
    total = sum((c / 10 * float(w) for c, w in zip(logit.values(), mix[:-1], strict=True)), F.lit(float(mix[-1])))
    out = everything.select("doc_id", _sigmoid(logit["text"]).alias("text_score"), _sigmoid(logit["meta"]).alias("meta_score"), _sigmoid(total).alias("score"))
    return out.withColumn("keep", F.col("score") >= THRESHOLD)


def op1_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
