"""Language identification in two steps: the language family, then the language within it.

Texts become counts of hashed byte n-grams (one to three bytes of the lower-cased text, with
everything that is not a letter read as one space), damped by a logarithm and scaled to length
one. One-versus-one linear support vector machines (squared hinge loss) vote on the family; the
family's own machines, which separate closely related languages, vote on the language.

Machines are fitted on a bounded sample: of each language the ``per_language`` learnable documents
with the smallest hash of their id. Everything else covers all rows and whole texts.

Defined cases: a null text, and one without a letter, is ``und`` with score 0; a null language
teaches nothing; a language outside ``FAMILIES`` is a family of its own; if nothing can be learned
every text is ``und``; equal votes go to the larger sum of margins, then to the first name; rows
that repeat are predicted like any other; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import per_row

UNKNOWN = "und"
#: Families of related languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
WIDTH, PIECE = 1 << 12, 1 << 20
#: Deals that the documents of a language are drawn from first.
DEALS = 16
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams; a long text is read piece by piece, so memory does not grow with it."""
    data = text.lower().encode("utf-8", "replace").translate(_FOLD)
    counts = np.zeros(WIDTH, np.int64)
    for start in range(0, len(data), PIECE):
        codes = np.frombuffer(data[max(0, start - 2) : start + PIECE], np.uint8).astype(np.uint32)
        fresh = min(start, 2)  # bytes of the piece before, needed by longer n-grams only
        gram = codes.copy()
        for n in (1, 2, 3):
            if n > 1:
                gram = (gram[:-1] << np.uint32(8)) | codes[n - 1 :]
            own = gram[max(0, fresh - n + 1) :]
            own = own[(own & 255) != 32] if n == 1 else own
            hashed = ((own + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
            counts += np.bincount(hashed, minlength=WIDTH)
    return counts


def features(text: str) -> np.ndarray:
    damped = np.log1p(ngram_counts(text)).astype(np.float32)
    return damped / max(float(np.linalg.norm(damped)), 1e-9)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights and, last, the bias of a machine with squared hinge loss, by accelerated gradient steps. ``y`` is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, before, rate = w.copy(), w.copy(), 0.25
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * weight * slack * y
        slope = np.append(x.T @ pull, pull.sum()) + penalty * np.append(ahead[:-1], 0)
        w = ahead - rate * slope.astype(np.float32)
        ahead, before = w + (w - before) * step / (step + 3), w
    return w


@dataclass(frozen=True)
class Votes:
    """One machine for each pair of names; positive margins are for the first of the pair."""

    names: tuple[str, ...]
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> Votes:
        names = tuple(sorted(set(labels)))
        pairs = tuple(itertools.combinations(range(len(names)), 2))
        made = []
        for a, b in pairs:
            own = (labels == names[a]) | (labels == names[b])
            made.append(linear_svm(x[own], np.where(labels[own] == names[a], 1.0, -1.0).astype(np.float32)))
        return Votes(names, pairs, np.array(made, np.float32).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The winner, and the share of certainty of its closest decision (0.5 and more unless votes run in a circle)."""
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        votes, sums = np.zeros(len(self.names)), np.zeros(len(self.names))
        for (a, b), m in zip(self.pairs, margins):
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        best = max(range(len(self.names)), key=lambda i: (votes[i], sums[i], -i))
        closest = min(m if a == best else -m for (a, b), m in zip(self.pairs, margins) if best in (a, b))
        return self.names[best], float(1 / (1 + np.exp(-4 * np.clip(closest, -20, 20))))


@dataclass(frozen=True)
class Model:
    families: Votes | None
    languages: dict[str, Votes]

    def predict(self, text: str | None) -> tuple[str, float]:
        if self.families is None or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self.families.predict(x)
        language, within = self.languages[family].predict(x)
        return language, sure * within


def family_of(language: str, families: dict[str, tuple[str, ...]]) -> str:
    return next((name for name, members in families.items() if language in members), language)


def learn(
    docs: DataFrame, learnable: Column, *, id_column: str = "doc_id", text: str = "text", label: str = "lang",
    families: dict[str, tuple[str, ...]] = FAMILIES, per_language: int = 600,
) -> Model:
    """Fit on at most ``per_language`` documents of each language; their features reach the driver, not their texts."""
    rows = docs.filter(learnable & F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(label).cast("string").alias("lang"))
    # First the ids alone, then only the chosen texts: the window moves no text, and drops what is
    # beyond the bound before its shuffle. The chosen ids are bounded, so they can go to every task.
    # A first cut within ``DEALS`` deals of each language bounds what one language brings to one task, however many tasks read it.
    order = (F.xxhash64(F.col("id").cast("string")), "id", "hash")
    chosen = rows.select("id", "lang", F.xxhash64("text").alias("hash"), F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(DEALS)).alias("deal")).distinct()
    for keys in (("lang", "deal"), ("lang",)):
        draw = Window.partitionBy(*keys).orderBy(*order)
        chosen = chosen.withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= per_language).drop("n")
    chosen = chosen.drop("deal")
    rows = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(chosen), ["id", "lang", "hash"])
    rows = rows.groupBy("id", "lang", "hash").agg(F.min("text").alias("text"))  # rows that repeat teach once

    def vectors(batch):
        own = [(lang, t) for lang, t in zip(batch["lang"], batch["text"]) if has_letter(t)]
        return {"lang": [lang for lang, _ in own], "x": [features(t).astype(np.float16).tobytes() for _, t in own]}

    found = sorted(((r["lang"], bytes(r["x"])) for r in per_row(rows.select("lang", "text"), "lang string, x binary", vectors).collect()))
    if not found:
        return Model(None, {})
    labels = np.array([lang for lang, _ in found])
    x = np.stack([np.frombuffer(v, np.float16).astype(np.float32) for _, v in found])
    kin = np.array([family_of(lang, families) for lang in labels])
    return Model(Votes.fit(x, kin), {k: Votes.fit(x[kin == k], labels[kin == k]) for k in sorted(set(kin))})


def identify(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``lang_pred`` and ``score``."""

    def predict(batch):
        made = [model.predict(t) for t in batch["text"]]
        return {"key": batch["key"], "lang_pred": [m[0] for m in made], "score": [m[1] for m in made]}

    key_type = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("key"), F.col(text).cast("string").alias("text"))
    return per_row(frame, f"key {key_type}, lang_pred string, score double", predict).withColumnRenamed("key", id_column)
