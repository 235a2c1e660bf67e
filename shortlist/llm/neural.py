"""Text probabilities by a log-bilinear neural model, trained with noise-contrastive estimation.

The two words before a word, as vectors, each times the matrix of its position, add up to a prediction q; a word's score
is q · its own vector + its bias. Words outside the ``shortlist`` share one class, and within it have their smoothed
corpus frequency, so the probabilities of all known words and of one unknown word add up to 1.

**Counting.** All tokens of all training texts are counted: added up in tasks, then by word in a shuffle. Only the
commonest, of at most 64 bytes each, go to the driver and to every task: all whose count fewer than ``dictionary`` + 1 tokens
reach. Tokens outside this dictionary are written with their document and find their count by a join, so no vocabulary
has to fit anywhere.

**Training** reads every token of every training text once. Documents are dealt to ``rounds`` by their id; in a
round every task starts from the model so far, takes steps over its own texts, and writes what it has learned, word by
word, with the number of places it saw the word in. A shuffle averages by word with these weights. A model of fixed
size reaches the driver. In each step a batch of places is contrasted with noise words drawn from the word
frequencies and shared by the batch, so the work is matrix products (Mnih and Teh 2012).

**Scoring** needs the sum over all words of exp(score), for every pair of preceding words. As the scores of the two
positions add, exp(score) is a product, and the sums for all pairs of preceding words are one matrix product of two
tables, ``exp(first) @ exp(second).T``. With these normalisers a token's log-probability is three look-ups.

Defined cases: null and empty texts have one token, the end; a document's first words have the mark of a beginning
before them; without training documents the base is log10 of 1 and the model gives every class the same share; tokens of
more than 64 bytes are told apart by a digest of 128 bits; a null id counts as empty in the deal of rounds; rows that
repeat are each scored, and learned from again; extra columns are ignored; texts of any length are read whole; words of equal
count are in the dictionary together or not at all, in byte order; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import LOWER, UPPER, Stage, per_row, release, small_batches, text_of

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The token after the last word. No word holds a line end.
END = b"\n"
LONGEST = 64


def tokens_of(text: str | None) -> list[bytes]:
    """The words, parted at space and the characters 9 to 13, and the end; long ones by digest, marked by a byte no text holds."""
    found = (text or "").encode().translate(_FOLD).split()
    if found and len(max(found, key=len)) > LONGEST:
        found = [w if len(w) <= LONGEST else b"\xff" + hashlib.blake2b(w, digest_size=16).digest() for w in found]
    found.append(END)
    return found


def token_counts(texts: DataFrame, held: int = 400_000) -> DataFrame:
    """``token`` and its count ``c`` over all texts. A task adds up its tokens and sends them on when it holds ``held`` of them."""
    schema = pa.schema([("token", pa.binary()), ("c", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            tokens = list(found)
            for start in range(0, len(tokens), 1 << 16):
                part = tokens[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([found[t] for t in part], pa.int64())], schema=schema)
            found.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(start, 256).to_pylist():
                    found.update(tokens_of(text))
                if len(found) >= held:
                    yield from emit()
        yield from emit()
        release()

    small_batches(texts.sparkSession)
    return texts.mapInArrow(task, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Parameters:
    """Vectors of preceding words (the last row: a beginning), the matrices of their two positions, vectors and biases of words."""

    before: np.ndarray
    first: np.ndarray
    second: np.ndarray
    word: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(shares: np.ndarray, width: int, seed: int) -> Parameters:
        """Small random vectors; the biases make the model start as the word frequencies."""
        draw, size = np.random.default_rng(seed), len(shares)
        one = np.eye(width, dtype=np.float32)
        vectors = [draw.normal(0, 0.3, (n, width)).astype(np.float32) for n in (size + 1, size)]
        return Parameters(vectors[0], one, 0.5 * one, vectors[1] * np.float32(0.1), np.log(shares).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.before, self.first, self.second, self.word, self.bias]

    def copy(self) -> Parameters:
        return Parameters(*(a.copy() for a in self.arrays()))

    def log_probabilities(self) -> Tables:
        word = self.word.T.astype(np.float64)
        one = (self.before @ self.first) @ word + self.bias
        two = (self.before @ self.second) @ word
        # Taking each row's largest out keeps every product in range; it comes back after the logarithm.
        most_one, most_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        total = np.exp(one - most_one) @ np.exp(two - most_two).T
        return Tables(one, two, np.log(total, out=total) + most_one + most_two.T)


@dataclass
class Tables:
    """Scores by the word before and by the word before that, and the logarithm of the sum over all words for each pair."""

    one: np.ndarray
    two: np.ndarray
    total: np.ndarray

    def of(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural logarithms of probabilities."""
        return self.one[one, words] + self.two[two, words] - self.total[one, two]


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of every index."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    out[sorted_[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


def _contrast(model: Parameters, words: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray):
    """Vectors before, predictions, and the scores of the places and of the noise, less those that noise alone would have."""
    x, y = model.before[one], model.before[two]
    q = x @ model.first + y @ model.second
    shift = model.bias - (np.float32(math.log(len(noise))) + log_noise)
    data = np.einsum("ij,ij->i", q, model.word[words]) + shift[words]
    return x, y, q, data, q @ model.word[noise].T + shift[noise]


def objective(model: Parameters, *places: np.ndarray) -> float:
    """The noise-contrastive objective of a batch (arguments as for ``slopes``), in natural logarithms."""
    *_, data, fake = _contrast(model, *places)
    return -float(np.logaddexp(0, -data).sum() + np.logaddexp(0, fake).sum())


def slopes(model: Parameters, words: np.ndarray, one: np.ndarray, two: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> list[np.ndarray]:
    """The slopes of the objective by ``arrays()``.

    ``noise`` are words drawn with the probabilities whose logarithms ``log_noise`` holds; every place is told
    apart from all of them.
    """
    x, y, q, data, fake = _contrast(model, words, one, two, noise, log_noise)
    pull = 1 / (1 + np.exp(np.clip(data, -30, 30)))
    push = np.clip(fake, -30, 30, out=fake)
    np.exp(np.negative(push, out=push), out=push)
    push += 1
    np.divide(-1, push, out=push)
    dq = pull[:, None] * model.word[words] + push @ model.word[noise]
    size = len(model.bias)
    word = _sums(words, pull[:, None] * q, size)
    bias = np.bincount(words, pull, size).astype(q.dtype)
    np.add.at(word, noise, push.T @ q)
    np.add.at(bias, noise, push.sum(axis=0))
    before = _sums(np.concatenate([one, two]), np.concatenate([dq @ model.first.T, dq @ model.second.T]), size + 1)
    return [before, x.T @ dq, y.T @ dq, word, bias]


def learn_places(model: Parameters, words: np.ndarray, one: np.ndarray, two: np.ndarray, shares: np.ndarray, squares: list[np.ndarray],
                 draw: np.random.Generator, *, batch: int, noise: int, rate: float) -> None:
    """Steps over all places, in shuffled batches; ``squares`` holds the sums of squared slopes that scale the steps."""
    log_noise, order = np.log(shares).astype(np.float32), draw.permutation(len(words))
    edges, spaced = np.cumsum(shares), np.arange(noise) / noise
    for start in range(0, len(words), batch):
        at = order[start : start + batch]
        drawn = np.minimum(np.searchsorted(edges, (spaced + draw.random() / noise) * edges[-1]), len(shares) - 1)
        for p, s, slope in zip(model.arrays(), squares, slopes(model, words[at], one[at], two[at], drawn, log_noise)):
            s += slope * slope
            p += np.float32(rate) * slope / np.sqrt(s)


class Numbers:
    """Numbers of tokens: 0.. in the dictionary by falling count, the shortlist first; the class of all others is ``size - 1``."""

    def __init__(self, tokens: list[bytes], shortlist: int):
        self.at = {t: i for i, t in enumerate(tokens)}
        self.short = min(shortlist, len(tokens))
        self.size = self.short + 1

    def of(self, tokens: list[bytes]) -> np.ndarray:
        """Places in the dictionary, -1 outside it."""
        get = self.at.get
        return np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))

    def classes(self, places: np.ndarray) -> np.ndarray:
        return np.where((places >= 0) & (places < self.short), places, self.short)


def places_of(classes: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of some documents, the word before each, and the one before that."""
    words = np.concatenate(classes)
    one, two = np.full(len(words), begin), np.full(len(words), begin)
    one[1:], two[2:] = words[:-1], words[:-2]
    starts = np.cumsum([0, *(len(c) for c in classes[:-1])])
    one[starts] = begin
    two[starts] = begin
    second = starts[np.array([len(c) for c in classes]) > 1] + 1
    two[second] = begin
    return words, one, two


@dataclass
class Model:
    """What scoring needs: counts of the commonest tokens, corpus totals, and the neural part. Its size does not grow with the corpus."""

    tokens: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    numbers: Numbers
    parameters: Parameters

    @property
    def others(self) -> tuple[int, int]:
        """Tokens and distinct tokens outside the shortlist."""
        return self.total - int(self.counts[: self.numbers.short].sum()), self.distinct - self.numbers.short

    def base_logs(self, counts):
        """log10 of smoothed frequencies; takes an array of counts."""
        return np.log10((counts + 1) / (self.total + 1 * (self.distinct + 1)))

    def other_logs(self, counts):
        """log10 of the share that a token outside the shortlist has in their class."""
        tokens, distinct = self.others
        return np.log10((counts + 1) / (tokens + distinct + 1))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count that no more than ``most`` tokens reach. Only the numbers of tokens by count are sorted."""
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("tokens"))
    down = by_count.withColumn("held", F.sum("tokens").over(Window.orderBy(F.desc("c"))))
    found = down.filter(F.col("held") <= most).agg(F.min("c")).first()[0]
    return found if found is not None else 1 << 62


def learn(
    docs: DataFrame, learnable: Column, stage: Stage, *, id_column: str = "doc_id", text: str = "text", dictionary: int = 50_000, shortlist: int = 1023,
    width: int = 24, rounds: int = 2, batch: int = 1024, noise: int = 64, rate: float = 0.1, block: int = 1 << 20, seed: int = 5,
) -> tuple[Model, DataFrame]:
    """The model, and the table of all tokens of the training texts with their counts (``token``, ``c``)."""
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    known = docs.filter(learnable).select(text_of(text).alias("text"), F.pmod(F.xxhash64(key), F.lit(rounds)).alias("round"))
    counts = stage.write(token_counts(known.select("text")), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    common = sorted((-r["c"], bytes(r["token"])) for r in counts.filter(F.col("c") >= least_count(counts, dictionary)).collect())
    tokens, frequency = [t for _, t in common], np.array([-c for c, _ in common], np.int64)
    numbers = Numbers(tokens, shortlist)
    n = total["n"] or 0
    seen = np.append(frequency[: numbers.short], n - frequency[: numbers.short].sum())
    shares = (seen + 1) / (seen.sum() + len(seen))
    parameters = Parameters.start(shares, width, seed)
    for turn in range(rounds):
        told = known.filter(F.col("round") == turn).select("text")
        learned = _round(told, parameters, tokens, numbers, shares, block=block, batch=batch, noise=noise, rate=rate, seed=seed + turn)
        parameters = _averaged(parameters, stage.write(learned, f"round{turn}"))
    return Model(tokens, frequency, n, total["v"], numbers, parameters), counts


def _round(texts: DataFrame, start: Parameters, tokens: list[bytes], numbers: Numbers, shares: np.ndarray, *, block: int, batch: int, noise: int, rate: float, seed: int) -> DataFrame:
    """What every task learns from its texts: for each part and row of the parameters its ``weight`` and weighted ``sums``, added over tasks."""
    short = numbers.short

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, draw = Numbers(tokens, short), np.random.default_rng(seed)
        model, squares = start.copy(), [np.ones_like(a) for a in start.arrays()]
        size, begin = own.size, own.size
        seen, preceding, held, waiting = np.zeros(size), np.zeros(size + 1), 0, []

        def take() -> None:
            words, one, two = places_of(waiting, begin)
            learn_places(model, words, one, two, shares, squares, draw, batch=batch, noise=noise, rate=rate)
            seen.__iadd__(np.bincount(words, minlength=size))
            preceding.__iadd__(np.bincount(one, minlength=size + 1))
            waiting.clear()

        for part in batches:
            for first in range(0, part.num_rows, 256):
                for text in part.column(0).slice(first, 256).to_pylist():
                    waiting.append(own.classes(own.of(tokens_of(text))))
                    held += len(waiting[-1])
                if held >= block:
                    take()
                    held = 0
        if waiting:
            take()
        every = np.full(start.first.shape[0], seen.sum())
        for number, (array, weight) in enumerate(zip(model.arrays(), (preceding, every, every, seen, seen))):
            rows = array.reshape(len(array), -1).astype(np.float64)
            at = np.flatnonzero(weight > 0)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([number] * len(at), pa.int32()), "row": pa.array(at, pa.int32()), "weight": pa.array(weight[at], pa.float64()),
                "sums": pa.array(list(rows[at] * weight[at, None]), pa.list_(pa.float64())),
            })

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[tuple[int, int], float] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for rows in group:
            for part, row, weight, values in zip(*(rows.column(i).to_pylist() for i in range(4))):
                key = (part, row)
                weights[key] = weights.get(key, 0.0) + weight
                sums[key] = sums[key] + values if key in sums else np.array(values)
        keys = list(weights)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in keys], pa.int32()), "row": pa.array([r for _, r in keys], pa.int32()),
            "weight": pa.array([weights[k] for k in keys], pa.float64()), "sums": pa.array([sums[k] for k in keys], pa.list_(pa.float64())),
        })

    small_batches(texts.sparkSession)
    kind = "part int, row int, weight double, sums array<double>"
    return texts.mapInArrow(task, kind).repartition("part", "row").sortWithinPartitions("part", "row", "weight").mapInArrow(add, kind)


def _averaged(start: Parameters, learned: DataFrame) -> Parameters:
    """Rows that no task has met stay as they were."""
    made = start.copy()
    arrays = made.arrays()
    for r in learned.collect():
        arrays[r["part"]][r["row"]] = (np.array(r["sums"]) / r["weight"]).reshape(arrays[r["part"]][r["row"]].shape)
    return made


def score(docs: DataFrame, model: Model, counts: DataFrame, stage: Stage, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, both log10."""
    base, other = model.base_logs(model.counts), model.other_logs(model.counts[model.numbers.short :])

    def setup():
        tables, numbers, log = model.parameters.log_probabilities(), model.numbers, math.log(10)
        outside = np.append(np.concatenate([np.zeros(numbers.short), other]), 0.0)
        bases = np.append(base, 0.0)

        def rows(batch):
            found = [tokens_of(t) for t in batch["text"]]
            places = [numbers.of(tokens) for tokens in found]
            words, one, two = places_of([numbers.classes(p) for p in places], numbers.size)
            flat, starts = np.concatenate(places), np.cumsum([0, *(len(p) for p in places[:-1])])
            rare = [Counter(tokens[i] for i in np.flatnonzero(p < 0).tolist()) for tokens, p in zip(found, places)]
            return {
                "row": batch["row"], "key": batch["key"], "n_tokens": [len(p) for p in places],
                "n_known": np.add.reduceat((flat >= 0).astype(np.int64), starts).tolist(),
                "base": np.add.reduceat(bases[flat], starts).tolist(),
                "score": np.add.reduceat(tables.of(words, one, two) / log + outside[flat], starts).tolist(),
                "rare": [[{"token": t, "times": n} for t, n in c.items()] for c in rare],
            }

        return rows

    key_type = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("key"), text_of(text).alias("text"))
    schema = f"row long, key {key_type}, n_tokens long, n_known long, base double, score double, rare array<struct<token: binary, times: long>>"
    scored = stage.write(per_row(frame, schema, setup=setup, step=128), "scored")
    rare = scored.select("row", F.explode("rare").alias("one")).select("row", "one.token", "one.times").join(counts, "token", "left")
    c, (tokens, distinct) = F.coalesce("c", F.lit(0)), model.others
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(model.total + model.distinct + 1)))).alias("base_rare"),
        F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(tokens + distinct + 1)))).alias("score_rare"),
    )
    none = F.lit(0.0)
    found = scored.drop("rare").join(rare, "row", "left")
    return found.select(
        F.col("key").alias(id_column), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_rare", none)).alias("base_score"),
        (F.col("score") + F.coalesce("score_rare", none)).alias("score"),
    )
