"""Phrase collocations by best-first branch-and-bound growth over prefix counts.

A phrase of two or three words that occurs ``least`` times or more is a candidate. Cut after its first words it
scores ``scale * a * a / (l * r)``, rounded down, of its own count a and the counts l and r of the two parts; the
lowest cut counts. Phrases grow word by word:

* Words are counted, then all pairs of words that may reach ``least`` themselves. No part of a phrase is rarer
  than the phrase, so nothing that matters is left out.
* A pair is the prefix of the triples that begin with it. Such a triple has a <= f(pair), and at the cut after
  its first word r >= a, so its score is at most ``scale * f(pair) / f(first word)``. That bound is admissible,
  and known before a single triple is counted.
* Per language the frontier is expanded from the highest bound down to a level: all prefixes whose bound
  reaches it, and on either side all pairs whose own score reaches it, for these fall if a triple that holds them
  is frequent enough. Then every candidate at or above the level is known with its fate. If ``top`` of them
  survive, what lies below can't enter the list, ties at its end included, and the language is settled. If not,
  the level falls to that of the next twice as many pairs, and ends at 0, where all is expanded.

Levels come from the histogram of scores, never from a sorted list of all pairs. Whom to count is told to tasks by
bitmaps of fixed size (``bits`` positions each), which may name too many phrases but leave none out: a phrase that
is counted at all is counted in every text, so its count is exact. Counts are added up inside tasks first.

Defined cases: a null text is empty, a null language is ``und``; a language without candidates has no rows;
repeated rows count again; texts of any length are read whole, in slices that end between words; equal scores are
ordered by count, then by the phrase's UTF-8 bytes, and ranks are given after that, so ties never share a rank; extra
columns are ignored; an empty table gives an empty result. Arithmetic is in decimals of 38 digits, exact for counts
below 10^16.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import LOWER, UPPER, Stage, release, small_batches, text_of

_MARKS = b".,;:!?\n\x0b\x0c\r"
#: Stands for the end of a piece. No UTF-8 text holds this byte.
_BREAK = b"\xff"
_FOLD = bytes.maketrans(UPPER.encode() + _MARKS + b"\t", LOWER.encode() + _BREAK * len(_MARKS) + b" ")
_SLICE = 1 << 22
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def tokens_of(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The words of all texts in order, ``_BREAK`` between pieces and between texts, in lists of a few megabytes."""
    start, body = 0, _BREAK.join((t or "").encode().translate(_FOLD) for t in texts) + _BREAK
    while start < len(body):
        stop = len(body)
        if stop - start > _SLICE:
            found = min(x for x in (body.find(b" ", start + _SLICE), body.find(_BREAK, start + _SLICE)) if x >= 0)
            stop = found + 1
        yield body[start:stop].replace(_BREAK, b" \xff ").split()
        start = stop


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return (x ^ (x >> np.uint64(29))) * _MIX[0]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _spread(first * _MIX[0] + second)


@dataclass(frozen=True)
class Members:
    """A set of hashes in a bitmap of fixed size. It may answer yes for others, never no for its own."""

    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, 8 * len(self.bits)):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Two positions below ``size``, a power of two, for every hash."""
    mixed, last = _spread(hashes), np.uint64(size - 1)
    return [(mixed & last).astype(np.int64), (mixed >> np.uint64(32) & last).astype(np.int64)]


def members(phrases: DataFrame, bits: int) -> Members:
    """The words or pairs in column ``phrase`` of ``phrases``, by their language. Only bitmaps are shuffled and collected."""
    block = 1 << 12

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            groups: dict[str, list[list[bytes]]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups[lang].append(phrase.encode().split(b" "))
            for lang, found in groups.items():
                hashes = word_hashes(lang, [p[0] for p in found])
                if len(found[0]) > 1:
                    hashes = pair_hashes(hashes, word_hashes(lang, [p[1] for p in found]))
                for at in _places(hashes, bits):
                    np.bitwise_or.at(made, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = [(i, made[i : i + block]) for i in range(0, len(made), block)]
        parts = [(i, part.tobytes()) for i, part in parts if part.any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([i for i, _ in parts], pa.int64()), "part": pa.array([p for _, p in parts], pa.binary())})

    def either(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, np.uint8) for p in group.column("part").to_pylist()]
        return pa.table({"at": group.column("at")[:1], "part": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    kind = "at long, part binary"
    every = np.zeros(bits // 8, np.uint8)
    for row in phrases.select("lang", "phrase").mapInArrow(marks, kind).groupBy("at").applyInArrow(either, kind).collect():
        every[row["at"] : row["at"] + len(row["part"])] = np.frombuffer(row["part"], np.uint8)
    return Members(every)


@dataclass(frozen=True)
class Wanted:
    """Which phrases of ``length`` words a pass over the texts counts. Of triples both pairs must be in ``parts``, and the
    first in ``first`` or the second in ``second``; of pairs both words must be in ``parts``."""

    length: int
    parts: Members | None = None
    first: Members | None = None
    second: Members | None = None


def phrases_in(lang: str, words: list[bytes], sequence: np.ndarray, wanted: Wanted) -> tuple[list[np.ndarray], np.ndarray]:
    """The wanted phrases of a sequence of word numbers, 0 for a break, as a number array per word, and how often each stands there."""
    if wanted.length == 1:
        return [np.arange(1, len(words))], np.bincount(sequence, minlength=len(words))[1:]
    own = word_hashes(lang, words)
    size = np.int64(len(words))
    if wanted.length == 2:
        known = wanted.parts.has(own)
        known[0] = False
        open_ = known[sequence]
        open_ = open_[:-1] & open_[1:]
        keys, times = np.unique(sequence[:-1][open_] * size + sequence[1:][open_], return_counts=True)
        return [keys // size, keys % size], times
    inside = sequence != 0
    keys = np.where(inside[:-1] & inside[1:], sequence[:-1] * size + sequence[1:], -1)
    pairs, at = np.unique(keys, return_inverse=True)
    x, y = pairs // size, pairs % size
    hashes = pair_hashes(own[np.maximum(x, 0)], own[y])
    known = wanted.parts.has(hashes) & (pairs >= 0)
    left, right = known & wanted.first.has(hashes), known & wanted.second.has(hashes)
    open_ = known[at[:-1]] & known[at[1:]] & (left[at[:-1]] | right[at[1:]])
    keys, times = np.unique(at[:-1][open_] * size + sequence[2:][open_], return_counts=True)
    first = keys // size
    return [x[first], y[first], keys % size], times


def counted(docs: DataFrame, wanted: Wanted, block: int) -> DataFrame:
    """``lang``, ``phrase`` and its count ``f`` over all texts of ``docs`` (``lang``, ``text``).

    A task adds up the phrases of about ``block`` words at a time, so a phrase that is common everywhere sends one row
    per block and not one per place.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, defaultdict] = {}
        sequences: dict[str, list[np.ndarray]] = defaultdict(list)
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, made in sequences.items():
                words = list(number[lang])
                parts, times = phrases_in(lang, words, np.concatenate(made), wanted)
                made.clear()
                text = pa.array([b"", *words[1:]], pa.binary()).cast(pa.string())
                for start in range(0, len(times), 1 << 16):
                    piece = slice(start, start + (1 << 16))
                    phrase = pc.binary_join_element_wise(*(text.take(pa.array(p[piece])) for p in parts), " ")
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase, pa.array(times[piece], pa.int64())], schema=schema)
            number.clear()
            sequences.clear()

        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 256):
                groups: dict[str, list[str]] = defaultdict(list)
                for lang, text in zip(langs.slice(start, 256).to_pylist(), texts.slice(start, 256).to_pylist()):
                    groups[lang].append(text)
                for lang, own in groups.items():
                    if lang not in number:
                        number[lang] = defaultdict()
                        number[lang].default_factory = number[lang].__len__
                        number[lang][_BREAK]
                    for tokens in tokens_of(own):
                        sequences[lang].append(np.fromiter(map(number[lang].__getitem__, tokens), np.int64, len(tokens)))
                        held += len(tokens)
                if held >= block:
                    yield from emit()
                    held = 0
        yield from emit()
        release()

    small_batches(docs.sparkSession)
    rows = docs.mapInArrow(task, "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _score(a: str, left: str, right: str, scale: int) -> Column:
    wide = {name: f"cast({name} AS DECIMAL(19, 0))" for name in (a, left, right)}
    return F.expr(f"cast((cast({scale} AS DECIMAL(38, 0)) * ({wide[a]} * {wide[a]})) div cast({wide[left]} * {wide[right]} AS DECIMAL(38, 0)) AS long)")


def _part(phrase: str, at: int) -> Column:
    return F.split_part(F.col(phrase), F.lit(" "), F.lit(at))


def collocations(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = 10, cover: int = 50, top: int = 2000, scale: int = 1_000_000,
    bits: int = 1 << 25, block: int = 1 << 21,
) -> DataFrame:
    """Per language the first ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A candidate falls if a longer one that holds its words has ``cover`` percent of its count or more.
    """
    stage = Stage(docs.sparkSession, "collocations")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))

    words = stage.write(counted(texts, Wanted(1), block), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.filter(F.col("f") >= least)
    known = members(words, bits)
    pairs = counted(texts, Wanted(2, parts=known), block).filter(F.col("f") >= least)
    pairs = pairs.select("lang", "phrase", _part("phrase", 1).alias("x"), _part("phrase", 2).alias("y"), F.col("f").alias("a"))
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("x"), F.col("f").alias("fx")), ["lang", "x"])
    pairs = pairs.join(words.select("lang", F.col("phrase").alias("y"), F.col("f").alias("fy")), ["lang", "y"])
    # The bound of all triples that begin with the pair.
    bound = F.expr(f"cast((cast({scale} AS DECIMAL(38, 0)) * a) div cast(fx AS DECIMAL(38, 0)) AS long)")
    pairs = stage.write(pairs.withColumns({"score": _score("a", "fx", "fy", scale), "bound": bound}), "pairs")
    known = members(pairs, bits)

    languages = pairs.select("lang").distinct().withColumn("before", F.lit(None).cast("long"))
    triples, settled, turn = None, None, 0
    while True:
        level = _levels(pairs.join(languages, "lang"), top << turn)
        level = stage.write(level, f"level{turn}")
        own = pairs.join(level, "lang")
        fresh = F.col("before").isNull()
        prefixes = own.filter((F.col("bound") >= F.col("level")) & (fresh | (F.col("bound") < F.col("before"))))
        judged = own.filter((F.col("score") >= F.col("level")) & (fresh | (F.col("score") < F.col("before"))))
        wanted = Wanted(3, known, members(prefixes, bits), members(judged, bits))
        found = counted(texts.join(level, "lang", "left_semi"), wanted, block).filter(F.col("f") >= least)
        found = found.select("lang", "phrase", F.concat_ws(" ", _part("phrase", 1), _part("phrase", 2)).alias("head"),
                             F.concat_ws(" ", _part("phrase", 2), _part("phrase", 3)).alias("tail"), F.col("f").alias("a"))
        heads = pairs.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f_head"), "fx")
        tails = pairs.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f_tail"), F.col("fy").alias("fz"))
        found = found.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
        triples = stage.write(found if triples is None else triples.unionByName(found).dropDuplicates(["lang", "phrase"]), f"triples{turn}")

        good = stage.write(_survivors(pairs.join(level, "lang"), triples.join(level, "lang"), cover, scale), f"good{turn}")
        held = good.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
        state = level.join(held, "lang", "left").withColumn("open", (F.col("level") > 0) & (F.coalesce("held", F.lit(0)) < top))
        state = stage.write(state, f"state{turn}")
        done = good.join(state.filter(~F.col("open")), "lang", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        languages = state.filter("open").select("lang", F.col("level").alias("before"))
        if languages.isEmpty():
            break
        turn += 1

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = settled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _levels(pairs: DataFrame, count: int) -> DataFrame:
    """Per language the score that ``count`` pairs reach, 0 where there are fewer. At most ``scale`` + 1 rows a language are sorted."""
    histogram = pairs.groupBy("lang", "before", "score").agg(F.count(F.lit(1)).alias("pairs"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    reach = F.sum("pairs").over(down) >= count
    levels = histogram.select("lang", "before", F.when(reach, F.col("score")).alias("score"))
    # A level that does not fall would not end, so one that many pairs share falls by one point at least.
    before = F.first("before")
    level = F.least(F.coalesce(F.max("score"), F.lit(0)), F.when(before.isNotNull(), F.greatest(before - 1, F.lit(0))))
    return levels.groupBy("lang").agg(F.first("before").alias("before"), level.alias("level"))


def _survivors(pairs: DataFrame, triples: DataFrame, cover: int, scale: int) -> DataFrame:
    """The candidates at or above their language's level that no longer one covers."""
    longer = triples.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    two = pairs.filter(F.col("score") >= F.col("level")).join(longer, ["lang", "phrase"], "left")
    two = two.filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    two = two.select("lang", "phrase", "a", F.col("fx").alias("l"), F.col("fy").alias("r"), "score")
    three = triples.withColumns({"one": _score("a", "fx", "f_tail", scale), "other": _score("a", "f_head", "fz", scale)})
    early = F.col("one") <= F.col("other")
    three = three.withColumn("score", F.least("one", "other")).filter(F.col("score") >= F.col("level"))
    three = three.select("lang", "phrase", "a", F.when(early, F.col("fx")).otherwise(F.col("f_head")).alias("l"),
                         F.when(early, F.col("f_tail")).otherwise(F.col("fz")).alias("r"), "score")
    return two.unionByName(three)
