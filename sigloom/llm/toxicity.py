"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and beginnings of words, that labelled toxic documents use and others don't, so it follows the
languages of the labels. The features are densities and log-odds of the lexicon, also close to pronouns of the second person, and
rates of capitals, punctuation and obfuscation. Labelled documents are divided by a hash: of two folds each is described with the
lexicon of the other, the trees are fitted on both, and the calibration on the rest; all documents are scored in one pass over
their texts, with the lexicon of both folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.features import DIGIT, SYMBOL, UPPER, distinct, isotonic, share
from sigloom.llm.words import Batch, slices, stretches
from sigloom.session import cut, table

#: Labelled documents used at most, those of least hash of each class.
LABELLED = 10_000
#: A lexicon entry: so many toxic documents at least have it, and so much of all documents that have it are toxic (after weighing the classes).
LEAST, PURITY = 4, 0.9
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7)
NEAR = 5
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split()
TREES, DEPTH, RATE, BINS, RIDGE = 80, 3, 0.15, 32, 1.0
THRESHOLD = 0.5
FEATURES = ("word_density", "word_hits", "word_kinds", "start_density", "start_hits", "start_kinds", "word_odds", "start_odds", "near_person", "person", "capitals", "exclamations", "symbols", "digits", "mixed_words", "shouted_words", "log_words")

_MARKS = np.zeros(256, dtype=bool)
_MARKS[[33, 63]] = True


def _word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    return np.unique(Batch([b" ".join(data)]).hash)


PERSON = _word_hashes(SECOND_PERSON)


def _texts(texts: list[str | None]) -> Iterator[tuple[int, Batch, Batch]]:
    """Slices of texts, as written and in lower case."""
    raw = [(t or "").encode() for t in texts]
    for a, b in slices(raw):
        yield a, Batch(raw[a:b]), Batch([(t or "").lower().encode() for t in texts[a:b]])


def _beginnings(low: Batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, hash) of the beginnings of words that are longer."""
    for k in BEGINNINGS:
        longer = np.flatnonzero(low.end - low.start > k)
        yield longer, stretches(low.bytes, low.start[longer], low.start[longer] + k) ^ np.uint64(k)


def _inside(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


Lexicon = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
"""Sorted hashes of words with their log-odds, and of beginnings with theirs."""


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """FEATURES of each text. Texts without words have 0 everywhere."""
    words, word_odds, starts, start_odds = lexicon
    parts = [np.zeros((0, len(FEATURES)))]
    for _, raw, low in _texts(texts):
        n = raw.size
        count = np.diff(low.first)
        total = np.maximum(count, 1).astype(float)
        size = np.maximum(raw.length, 1).astype(float)
        hit = _inside(words, low.hash)
        start = np.zeros(len(low.hash), dtype=bool)
        which = np.zeros(len(low.hash), dtype=np.uint64)
        odds = np.zeros(len(low.hash))
        for at, h in _beginnings(low):
            found = _inside(starts, h)
            start[at[found]] = True
            which[at[found]] = h[found]
            odds[at[found]] = np.maximum(odds[at[found]], start_odds[np.searchsorted(starts, h[found])])
        person = _inside(PERSON, low.hash)
        run = np.concatenate([[0], np.cumsum(person)])
        any_ = np.flatnonzero(hit | start)
        left = np.maximum(any_ - NEAR, low.first[low.doc[any_]]) if len(any_) else any_
        right = np.minimum(any_ + NEAR + 1, low.first[low.doc[any_] + 1]) if len(any_) else any_
        near = any_[run[right] > run[left]]
        bits = np.concatenate([[0], np.cumsum(DIGIT[raw.bytes] | SYMBOL[raw.bytes])])
        caps = np.concatenate([[0], np.cumsum(UPPER[raw.bytes])])
        has = bits[raw.end] - bits[raw.start]
        upper = caps[raw.end] - caps[raw.start]
        long_ = raw.end - raw.start
        by = lambda doc: np.bincount(doc, minlength=n)
        columns = [
            by(low.doc[hit]) / total,
            np.log1p(by(low.doc[hit])),
            np.log1p(distinct(low.doc[hit], low.hash[hit], n)),
            by(low.doc[start]) / total,
            np.log1p(by(low.doc[start])),
            np.log1p(distinct(low.doc[start], which[start], n)),
            np.bincount(low.doc[hit], word_odds[np.searchsorted(words, low.hash[hit])], n),
            np.bincount(low.doc, odds, n),
            by(low.doc[near]) / total,
            by(low.doc[person]) / total,
            share(raw, UPPER, size),
            share(raw, _MARKS, size),
            share(raw, SYMBOL, size),
            share(raw, DIGIT, size),
            by(raw.doc[(has > 0) & (has < long_)]) / total,
            by(raw.doc[(upper == long_) & (long_ > 2)]) / total,
            np.log1p(count),
        ]
        block = np.stack(columns, axis=1)
        block[count == 0] = 0
        parts.append(block)
    return np.concatenate(parts)


def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(fold, kind, term, toxic, clean): in how many toxic and other documents of the batch a word (kind 0) or a beginning (1) occurs."""
    for pdf in batches:
        label, fold = pdf["toxic"].to_numpy(dtype=np.int64), pdf["fold"].to_numpy()
        found = []
        for a, _, low in _texts(list(pdf["text"])):
            for kind, (at, h) in [(0, (np.arange(len(low.hash)), low.hash)), *((1, x) for x in _beginnings(low))]:
                pair = np.unique(np.rec.fromarrays([h, low.doc[at] + a], names="h,d"))
                found.append(pd.DataFrame({"kind": kind, "term": pair.h.view(np.int64), "fold": fold[pair.d], "toxic": label[pair.d], "clean": 1 - label[pair.d]}))
        if found:
            yield pd.concat(found).groupby(["fold", "kind", "term"], as_index=False).sum()


@dataclass
class Trees:
    """Boosted regression trees on binned features, for the logistic loss. A tree is a full binary tree of DEPTH levels."""

    edges: list[np.ndarray] = field(default_factory=list)
    splits: list[list[tuple[int, float]]] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(y), dtype=np.int64), []
            for depth in range(DEPTH):
                level = []
                for k in range(1 << depth):
                    mine = np.flatnonzero(node == k)
                    f, b = self._best(binned[mine], g[mine], h[mine])
                    level.append((f, float(self.edges[f][b]) if b >= 0 else np.inf))
                    node[mine] = 2 * k + (binned[mine, f] > b if b >= 0 else 0)
                splits += level
            up, down = np.bincount(node, g, 1 << DEPTH), np.bincount(node, h, 1 << DEPTH)
            leaf = -RATE * up / (down + RIDGE)
            margin += leaf[node]
            self.splits.append(splits)
            self.leaves.append(leaf)
        return self

    def _best(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """Feature and bin of the split that gains most; bin -1: none does."""
        best, found = 1e-6, (0, -1)
        for f, edges in enumerate(self.edges):
            if not len(edges) or not len(x):
                continue
            left, weight = (np.cumsum(np.bincount(x[:, f], v, len(edges) + 1))[:-1] for v in (g, h))
            whole, mass = g.sum(), h.sum()
            gain = left**2 / (weight + RIDGE) + (whole - left) ** 2 / (mass - weight + RIDGE) - whole**2 / (mass + RIDGE)
            if gain.max() > best:
                best, found = gain.max(), (f, int(gain.argmax()))
        return found

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for splits, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for depth in range(DEPTH):
                first = (1 << depth) - 1
                f = np.array([s[0] for s in splits[first : 2 * first + 1]])
                t = np.array([s[1] for s in splits[first : 2 * first + 1]])
                node = 2 * node + (x[np.arange(len(x)), f[node]] > t[node])
            out += leaf[node]
        return out


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities; the knots' first probability where there are no trees."""
        if self.trees is None:
            return np.full(len(texts), float(self.knots[1][0]))
        return np.interp(self.trees.margins(features(texts, self.lexicon)), *self.knots)


def _lexicon(counts: pd.DataFrame, toxic: int, clean: int) -> Lexicon:
    """Entries that enough toxic documents have, and few others. counts: kind, term, toxic, clean."""
    counts = counts.groupby(["kind", "term"], as_index=False)[["toxic", "clean"]].sum()
    t, c = (counts["toxic"] + 0.5) / max(toxic, 1), (counts["clean"] + 0.5) / max(clean, 1)
    pure = counts.assign(odds=np.log(t / c))[(counts["toxic"] >= LEAST) & (t >= PURITY * (t + c))]
    out: list[np.ndarray] = []
    for kind in (0, 1):
        mine = pure[pure["kind"] == kind]
        key = mine["term"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.argsort(key)
        out += [key[order], mine["odds"].to_numpy()[order]]
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The model from ``labelled`` labelled documents of each class at most; without both classes it gives the toxic share to all."""
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(10)).cast("int")
    truth = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic is not null")
    chosen = truth.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    chosen = chosen.union(truth.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)).withColumn("part", part)
    chosen = cut(chosen, "chosen")
    sizes = {(r["toxic"], r["fold"]): r["n"] for r in chosen.groupBy("toxic", _fold().alias("fold")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {y: sum(n for (z, _), n in sizes.items() if z == y) for y in (0, 1)}
    nothing = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64), np.zeros(0))
    flat = Model(nothing, None, (np.array([0.0]), np.array([total[1] / max(1, sum(total.values()))])))
    if not all(total.values()):
        return flat
    # the labels of the bounded sample are few, however many rows one id has
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    known = cut(known.groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text")).withColumn("fold", _fold()), "known")
    counts = known.where("fold < 2").select("fold", "toxic", "text").mapInPandas(terms, "fold int, kind int, term long, toxic long, clean long")
    both = F.sum("toxic").over(Window.partitionBy("kind", "term"))
    sums = counts.groupBy("fold", "kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("all", both)
    balance = F.col("toxic") / max(total[1], 1) * 20 >= F.col("clean") / max(total[0], 1)  # far from any lexicon: not worth collecting
    found = sums.where((F.col("all") >= LEAST) & balance).toPandas()
    fold_sizes = [[sizes.get((y, f), 0) for y in (1, 0)] for f in (0, 1)]
    lexicons = [_lexicon(found[found["fold"] == 1 - f], *fold_sizes[1 - f]) for f in (0, 1)]
    lexicons.append(_lexicon(found, *(a + b for a, b in zip(*fold_sizes, strict=True))))
    names = [f"f{i}" for i in range(len(FEATURES))]

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, own in pdf.groupby("fold"):
                x = pd.DataFrame(features(list(own["text"]), lexicons[f]), columns=names)
                yield pd.concat([own[["key", "fold", "toxic"]].reset_index(drop=True), x], axis=1)

    rows = known.select(F.xxhash64("doc_id").alias("key"), "fold", "toxic", "text")
    rows = rows.mapInPandas(described, f"key long, fold int, toxic int, {', '.join(f'{n} double' for n in names)}").toPandas()
    rows = rows.sort_values(["key", *names])
    x, y, hold = rows[names].to_numpy(), rows["toxic"].to_numpy(dtype=float), rows["fold"].to_numpy() == 2
    if len(np.unique(y[~hold])) < 2 or not hold.any():
        return flat
    trees = Trees().fit(x[~hold], y[~hold])
    return Model(lexicons[2], trees, isotonic(trees.margins(x[hold]), y[hold]))


def _fold() -> Column:
    """Two folds of four tenths each, and the held-out rest."""
    return F.least(F.floor(F.col("part") / 4), F.lit(2)).cast("int")


def scored(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """(doc_id, score, toxic) for each row of docs.

    score is the calibrated probability, on a sample with as many documents of either class as the bound lets in. Null and empty
    texts have all features 0. Repeated rows get equal scores; of several labels of a document the highest counts; of several texts of one id the least is learned from; documents with a
    null id are scored but never labelled. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, labelled))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = shared.value.score(list(pdf["text"]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "toxic": score >= THRESHOLD})

    given = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return given.mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, toxic boolean")


def op5_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
