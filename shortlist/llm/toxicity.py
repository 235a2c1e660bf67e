"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (lower-cased) and the beginnings of its words, hashed. Those that
tell labels apart best by the log-likelihood ratio, counted over the sample, become the inputs; an
input is 1 if the text holds the term. The machine adds to linear weights an interaction for
every pair of inputs, the product of their latent vectors, so a pair (an insult with the mention of a
group) can weigh more than its two terms.

Inputs and weights come from a bounded sample of labelled documents (``rows`` ids, ``terms``
inputs); every document is scored, on its whole text.

Defined cases: null and empty texts hold no term and get the score of the bias; without labels of
both kinds every score is the base rate of the one kind, kept within 0.01 and 0.99; rows that
repeat are scored like any other; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import per_row, text_of
from shortlist.llm.labelled import sample

WORD = re.compile(r"[^\W\d_]+")
SPACE, REMEMBERED = 1 << 26, 200_000
#: Lengths of the beginnings that are terms.
STEMS = (4, 5, 6)


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def terms_of_word(word: str) -> tuple[int, ...]:
    made = [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]
    return tuple(zlib.crc32(t.encode()) % SPACE for t in made)


def terms_of(text: str) -> set[int]:
    return {t for word in words_of(text) for t in terms_of_word(word)}


@dataclass(frozen=True)
class Model:
    inputs: dict[int, int]
    bias: float
    linear: np.ndarray
    latent: np.ndarray

    def held(self, text: str, memory: dict[str, tuple[int, ...]]) -> list[int]:
        """The inputs that are 1. ``memory`` keeps the inputs of words, within a bound."""
        found: set[int] = set()
        for word in words_of(text):
            own = memory.get(word)
            if own is None:
                own = tuple(self.inputs[t] for t in terms_of_word(word) if t in self.inputs)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[word] = own
            if own:
                found.update(own)
        return sorted(found)

    def logit(self, held: list[int]) -> float:
        if not held:
            return self.bias
        v = self.latent[held]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return self.bias + float(self.linear[held].sum()) + pairs


def fit(held: list[list[int]], y: np.ndarray, width: int, *, factors: int, epochs: int, seed: int, penalty: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and latent vectors by Adam on the logistic loss, in shuffled batches."""
    draw = np.random.default_rng(seed)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    bias = np.array([np.log(rate / (1 - rate))])
    linear, latent = np.zeros(width), draw.normal(0, 0.02, (width, factors))
    params = [bias, linear, latent]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = draw.permutation(len(y))
        for start in range(0, len(y), 256):
            batch, step = order[start : start + 256], step + 1
            x = np.zeros((len(batch), width))
            for i, row in enumerate(batch):
                x[i, held[row]] = 1.0
            sums = x @ latent
            logits = bias[0] + x @ linear + 0.5 * (sums**2 - x @ latent**2).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[batch]) / len(batch)
            pull = x.T @ error
            slopes = [
                np.array([error.sum()]),
                pull + penalty * linear,
                x.T @ (error[:, None] * sums) - latent * pull[:, None] + penalty * latent,
            ]
            for p, g, m, v in zip(params, slopes, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(bias[0]), linear, latent


def learn(
    docs: DataFrame, labels: DataFrame, learnable: Column, *, id_column: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = 20_000, terms: int = 1_500, least_documents: int = 4, factors: int = 6, epochs: int = 6, seed: int = 11,
) -> Model:
    """Fit on a bounded sample; per row only the numbers of its inputs reach the driver."""
    chosen = sample(docs, labels, learnable, label, id_column=id_column, text=text, rows=rows)

    def count(batch):
        every, bad = Counter(), Counter()
        for body, y in zip(batch["text"], batch["label"]):
            own = terms_of(body)
            every.update(own)
            if y:
                bad.update(own)
        return {"term": list(every), "docs": list(every.values()), "bad": [bad[t] for t in every]}

    totals = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    good, bad = totals.get(0, 0), totals.get(1, 0)
    if not good or not bad:
        rate = 0.01 if good or not bad else 0.99
        return Model({}, float(np.log(rate / (1 - rate))), np.zeros(0), np.zeros((0, factors)))

    sums = per_row(chosen, "term long, docs long, bad long", count, step=4096)
    sums = sums.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("bad").alias("bad")).filter(F.col("docs") >= least_documents)

    def part(seen: Column, of: Column) -> Column:
        """seen * log(seen / expected), 0 for none seen."""
        return F.when(seen > 0, seen * F.log(seen / of)).otherwise(0.0)

    n, share = float(good + bad), F.col("docs") / float(good + bad)
    ratio = (
        part(F.col("bad"), share * float(bad)) + part(F.col("docs") - F.col("bad"), share * float(good))
        + part(float(bad) - F.col("bad"), (n - F.col("docs")) / n * float(bad))
        + part(float(good) - F.col("docs") + F.col("bad"), (n - F.col("docs")) / n * float(good))
    )
    best = sums.select("term", F.round(2 * ratio, 6).alias("ratio")).orderBy(F.desc("ratio"), "term").limit(terms).collect()
    inputs = {r["term"]: i for i, r in enumerate(best)}
    empty = Model(inputs, 0.0, np.zeros(0), np.zeros((0, 0)))

    def vectors(batch):
        memory: dict = {}
        return {"label": batch["label"], "held": [empty.held(t, memory) for t in batch["text"]]}

    found = sorted((r["label"], list(r["held"])) for r in per_row(chosen, "label int, held array<int>", vectors).collect())
    y = np.array([a for a, _ in found], float)
    bias, linear, latent = fit([h for _, h in found], y, len(inputs), factors=factors, epochs=epochs, seed=seed)
    return Model(inputs, bias, linear, latent)


def score(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``score``."""

    def setup():
        memory: dict = {}

        def rows(batch):
            logits = np.array([model.logit(model.held(t, memory)) for t in batch["text"]])
            return {"key": batch["key"], "score": (1 / (1 + np.exp(-np.clip(logits, -500, 500)))).tolist()}

        return rows

    key_type = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("key"), text_of(text).alias("text"))
    return per_row(frame, f"key {key_type}, score double", setup=setup).withColumnRenamed("key", id_column)
