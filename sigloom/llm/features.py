"""Dense features of texts, by whole-array arithmetic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from sigloom.llm.words import Batch, slices

UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
BREAK = np.arange(256) == 10
PAUSE = np.zeros(256, dtype=bool)
PAUSE[[ord(c) for c in ".,;:?'\"()-"]] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SYMBOL &= ~PAUSE


def share(batch: Batch, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The share of bytes of a kind in each text."""
    total = np.concatenate([[0], np.cumsum(kind[batch.bytes], dtype=np.int64)])
    return (total[batch.offset[1:]] - total[batch.offset[:-1]]) / size


def distinct(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    """How many different values each group has."""
    if not len(group):
        return np.zeros(groups, dtype=np.int64)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(g[new], minlength=groups)


TEXT_FEATURES = ("log_words", "word_length", "word_length_spread", "capitals", "digits", "symbols", "pauses", "breaks", "variety", "repeated", "title_words", "long_words")


def text_features(texts: list[str | None]) -> np.ndarray:
    """TEXT_FEATURES of each text as floats; a null text counts as an empty one, whose features are 0."""
    parts = [np.zeros((0, len(TEXT_FEATURES)), dtype=np.float32)]
    data = [(x or "").encode() for x in texts]
    for a, b in slices(data):
        batch = Batch(data[a:b])
        size = np.maximum(batch.length, 1).astype(float)
        count = np.diff(batch.first)
        words = np.maximum(count, 1).astype(float)
        long_ = (batch.end - batch.start).astype(float)
        mean = np.bincount(batch.doc, long_, batch.size) / words
        square = np.bincount(batch.doc, long_**2, batch.size) / words
        same = np.zeros(len(batch.hash))
        same[1:] = (batch.hash[1:] == batch.hash[:-1]) & (batch.doc[1:] == batch.doc[:-1])
        initial = UPPER[batch.bytes[batch.start]] if len(batch.start) else np.zeros(0, dtype=bool)
        columns = [
            np.log1p(count),
            mean,
            np.sqrt(np.maximum(square - mean**2, 0)),
            share(batch, UPPER, size),
            share(batch, DIGIT, size),
            share(batch, SYMBOL, size),
            share(batch, PAUSE, size),
            np.maximum(share(batch, BREAK, size) - 1 / size, 0),
            np.log1p(distinct(batch.doc, batch.hash, batch.size)) / np.log1p(words),
            np.bincount(batch.doc, same, batch.size) / words,
            np.bincount(batch.doc, initial, batch.size) / words,
            np.bincount(batch.doc, long_ > 15, batch.size) / words,
        ]
        block = np.stack(columns, axis=1)
        block[count == 0] = 0
        parts.append(block.astype(np.float32))
    return np.concatenate(parts)


def with_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replaces the column ``text`` by f0, f1, ..."""
    for pdf in batches:
        found = text_features(list(pdf["text"]))
        rest = pdf.drop(columns="text").reset_index(drop=True)
        yield pd.concat([rest, pd.DataFrame(found, columns=[f"f{i}" for i in range(found.shape[1])])], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept last, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(float)
    s = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (s * (p - y)) + penalty * w
        hessian = (x * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the isotonic regression of y on score, by pooling adjacent violators; probabilities are Laplace-smoothed."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # least score, last score, positives, rows
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([s, s, v, 1.0])
        while len(blocks) > 1 and (blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3] or blocks[-2][1] == blocks[-1][0]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0], top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    knots = [(s, (k + 0.5) / (n + 1)) for a, b, k, n in blocks for s in ({a, b} if a == b else (a, b))]
    xs, ps = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])
    return xs, ps
