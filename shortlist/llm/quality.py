"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in features of its whole text. From pairs of a preferred and a
rejected document the weights are learned by logistic loss on the difference of their features, so
only the order within pairs counts. Documents are then kept by a quantile of the learned scores: the
quantile of the sample's scores at which keeping what lies above agrees best with the labels, each label
weighing the same. ``score`` maps strengths to 0..1 so that this quantile falls on ``cut``.

The weights come from a bounded sample of labelled documents (``rows`` ids, ``pairs`` pairs); every
document is scored, on its whole text.

Defined cases: null and empty texts have the features of a text without words and get a score like
any other; without labels of both kinds all strengths are equal, every score is 0.5 and is kept;
rows that repeat are scored like any other; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import per_row, text_of
from shortlist.llm.labelled import sample

#: Marks that end words in running text.
ENDS = frozenset(".,;:?)]}'\"»”’…")
MARKS = 32


def features(text: str) -> list[float]:
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    odd = shout = bare = capitals = upper = digits = letters = length = 0
    marks = [0.0] * MARKS
    for word, times in counts.items():
        last = word[-1]
        length += len(word) * times
        if not last.isalnum():
            marks[ord(last) % MARKS] += times
            if last == "!":
                shout += times
            elif last not in ENDS:
                odd += times
            if not any(map(str.isalnum, word)):
                bare += times
        if word.isupper() and len(word) > 1:
            upper += times
        if word[0].isupper():
            capitals += times
        if word.isalpha():
            letters += times
        elif any(map(str.isdigit, word)):
            digits += times
    lines = [line for line in text.split("\n") if line.strip()]
    common = counts.most_common(1)[0][1] if counts else 0
    return [
        odd / n, shout / n, bare / n, upper / n, capitals / n, letters / n, digits / n, length / n / 10,
        sum(map(eq, words, words[1:])) / n, common / n, len(counts) / n, math.log1p(len(counts)) / math.log1p(n + 1),
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(n) / 10, float(not words), *(m / n for m in marks),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Weights w that make w·(better - worse) large for every pair, by accelerated steps on the logistic loss."""
    difference = better - worse
    w = ahead = before = np.zeros(difference.shape[1])
    rate = 4 / (float((difference**2).sum(axis=1).mean()) + penalty)
    for step in range(steps):
        lost = 1 / (1 + np.exp(np.clip(difference @ ahead, -50, 50)))
        w = ahead + rate * (difference.T @ lost / len(difference) - penalty * ahead)
        ahead, before = w + (w - before) * step / (step + 3), w
    return w


def best_quantile(strengths: np.ndarray, labels: np.ndarray) -> float:
    """The score, half-way between neighbours, above which preferred and below which rejected rows are best told apart."""
    order = np.argsort(strengths, kind="stable")
    s, good = strengths[order], labels[order] == 1
    kept = 1 - np.concatenate([[0], np.cumsum(good)]) / max(1, good.sum())
    dropped = np.concatenate([[0], np.cumsum(~good)]) / max(1, (~good).sum())
    edges = np.concatenate([[True], s[1:] > s[:-1], [True]])  # equal scores stay together
    at = int(np.argmax(np.where(edges, kept + dropped, -1)))
    if at in (0, len(s)):
        return float(s[0] - 1 if at == 0 else s[-1] + 1)
    return float((s[at - 1] + s[at]) / 2)


def learn(
    docs: DataFrame, labels: DataFrame, learnable: Column, *, id_column: str = "doc_id", text: str = "text",
    label: str = "quality", rows: int = 20_000, pairs: int = 40_000, seed: int = 7,
) -> Model:
    """Fit on a bounded sample; only its features reach the driver."""
    chosen = sample(docs, labels, learnable, label, id_column=id_column, text=text, rows=rows)

    def vectors(batch):
        return {"label": batch["label"], "x": [np.array(features(t), np.float32).tobytes() for t in batch["text"]]}

    found = sorted((r["label"], bytes(r["x"])) for r in per_row(chosen, "label int, x binary", vectors).collect())
    y = np.array([a for a, _ in found], np.int64)
    width = len(features(""))
    x = np.array([np.frombuffer(b, np.float32) for _, b in found], np.float64).reshape(len(found), width)
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -math.log(0.5 / 0.5))
    draw = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-6] = 1.0
    z = np.clip((x - mean) / scale, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = bradley_terry(z[draw.choice(good, pairs)], z[draw.choice(bad, pairs)])
    return Model(mean, scale, weights, best_quantile(z @ weights, y))


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: its id, ``strength`` and ``score``, which reaches ``cut`` at the threshold's quantile."""
    offset = math.log(cut / (1 - cut)) if model.weights.any() else 0.0

    def rows(batch):
        strengths = model.strengths(np.array([features(t) for t in batch["text"]]).reshape(len(batch["text"]), len(model.mean)))
        scores = 1 / (1 + np.exp(-np.clip(strengths - model.threshold + offset, -500, 500)))
        return {"key": batch["key"], "strength": strengths.tolist(), "score": scores.tolist()}

    key_type = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("key"), text_of(text).alias("text"))
    return per_row(frame, f"key {key_type}, strength double, score double", rows).withColumnRenamed("key", id_column)
