"""Spelling variants of words, found by permuterm rotations.

Words are the runs of letters of all texts, counted over the whole corpus. A word w with the terminator ``$`` has the
rotations of ``w$``. Turned so that the character c between a head and a tail comes last, the rotation reads
tail, ``$``, head, c. Two words that differ in that character alone share the prefix tail ``$`` head, and the word
without it has that very prefix as a whole rotation. So a sort of all rotations brings together, as ranges of equal
prefix that skip the edited character, the words one replacement, insertion or deletion apart. The sorted ranges
are scanned once. A range holds distinct words that differ in one character, so it is never longer than the alphabet, whatever the
corpus; the scan emits, for every member, how many neighbours it has there and the most frequent one, and no pairs.

A pair that differs by a replacement meets in one range. One that differs by a deletion inside a run of equal characters
would meet once for every character of the run, and counts for the first only.

A word's form is its neighbour of largest count if that is ``times`` the word's count or more. Forms are followed to
the last: counts at least double (for ``times`` of 2) on the way, so there are at most 63 steps, done by doubling.

Defined cases: a null text holds no words, a null id counts as empty text in the deletion rule; rows that
repeat count again, with the same deletions; a deletion may leave a word that is too short, which then is none;
neighbours of equal count are ordered by code points, the smallest first; texts of any length are read whole; of
words of any length too: a prefix of more than 64 characters is compared by a fingerprint of 122 bits, so a long word's
rotations take room in proportion to its length; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import LOWER, UPPER, Stage, release, small_batches, text_of

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: No letter of a word.
END = "$"
#: The longest prefix that is kept as it is.
PLAIN = 64
MODULUS, BASES = (1 << 61) - 1, (0x1B873593CC9E2D51, 0x0C2B2AE3D27D4EB5)


def runs_of(text: str | None) -> list[str]:
    return _RUN.findall((text or "").encode().translate(_FOLD).decode())


def words_in(doc_id, text: str | None, every: int) -> Iterator[tuple[str, int]]:
    """Distinct runs with their counts, after the deletion that the checksum of id and run calls for in one of ``every``."""
    start = zlib.crc32(b":", zlib.crc32(b"" if doc_id is None else str(doc_id).encode()))
    for run, times in Counter(runs_of(text)).items():
        mark = zlib.crc32(run.encode(), start)
        if mark % every == 0:
            at = mark % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, times


def vocabulary(docs: DataFrame, *, id_column: str, text: str, every: int, shortest: int, least: int, held: int = 400_000) -> DataFrame:
    """``word`` and its count ``n``. A task adds up its words and sends them on when it holds ``held`` of them."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def emit() -> Iterator[pa.RecordBatch]:
            words = [w for w in found if len(w) >= shortest]
            for start in range(0, len(words), 1 << 16):
                part = words[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], schema=schema)
            found.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for word, times in words_in(doc_id, body, every):
                        found[word] += times
                if len(found) >= held:
                    yield from emit()
        yield from emit()
        release()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("string").alias("id"), text_of(text).alias("text")).mapInArrow(task, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """All rotations of all words as ``prefix``, what comes before the edited character, with the word's ``id`` and ``n``.

    ``whole`` says that nothing was skipped, ``first`` that the skipped character is the first of its run, the one place
    that counts for deletions. Prefixes of more than ``PLAIN`` characters are fingerprints.
    """
    at, size = F.col("at"), F.length("word")
    head, tail = F.substring("word", 1, at), F.substring("word", at + 1, size)
    skipped = F.substring("word", at + 2, size)
    short = words.filter(size < PLAIN).select("id", "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("at"))
    kinds = F.array(
        F.struct(F.concat(tail, F.lit(END), head).alias("prefix"), F.lit(True).alias("whole"), F.lit(True).alias("first")),
        F.when(at < size, F.struct(
            F.concat(skipped, F.lit(END), head).alias("prefix"), F.lit(False).alias("whole"),
            ((at == 0) | (F.substring("word", at + 1, F.lit(1)) != F.substring("word", at, F.lit(1)))).alias("first"),
        )),
    )
    made = short.select("id", "n", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).select("id", "n", "kind.*")
    long = words.filter(size >= PLAIN).select("id", "word", "n").mapInArrow(long_rotations, made.schema)
    return made.unionByName(long)


def turned(word: str) -> Iterator[tuple[str, bool, bool]]:
    """``prefix``, ``whole`` and ``first`` of all rotations of a long word, in time that grows with its length.

    Fingerprints come from polynomial sums modulo 2^61 - 1 in two bases, taken of every beginning of the word.
    """
    size = len(word)
    sums, powers = [[0] * (size + 1) for _ in BASES], [[1] * (size + 2) for _ in BASES]
    for base, total, power in zip(BASES, sums, powers):
        for i, c in enumerate(word):
            total[i + 1] = (total[i] * base + ord(c)) % MODULUS
        for i in range(size + 1):
            power[i + 1] = power[i] * base % MODULUS

    def prefix(start: int, stop: int) -> str:
        """Of the characters from ``start``, the terminator and the characters before ``stop``."""
        if size - start + 1 + stop <= PLAIN:
            return word[start:] + END + word[:stop]
        found = []
        for total, power in zip(sums, powers):
            tail = total[size] - total[start] * power[size - start]
            found.append((tail * power[stop + 1] + ord(END) * power[stop] + total[stop]) % MODULUS)
        return "#{:x}.{:x}".format(*found)

    for at in range(size + 1):
        yield prefix(at, at), True, True
        if at < size:
            yield prefix(at + 1, at), False, at == 0 or word[at] != word[at - 1]


def long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            rows = turned(word)
            while part := list(islice(rows, 1 << 14)):
                prefix, whole, first = (list(x) for x in zip(*part))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([number] * len(part), pa.int64()), "n": pa.array([n] * len(part), pa.int64()),
                    "prefix": pa.array(prefix, pa.string()), "whole": pa.array(whole), "first": pa.array(first),
                })


def scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix to ``id``, ``near`` (neighbours in the range), ``best`` (its most frequent one's id) and ``best_n``."""
    out: dict[str, list[int]] = {"id": [], "near": [], "best": [], "best_n": []}

    def add(word: int, others: list[tuple[int, int]]) -> None:
        """``others``: count and id of the range's members that are neighbours, the best first, the word itself among them or not."""
        best = next((x for x in others[:2] if x[1] != word), None)
        if best:
            for name, value in zip(out, (word, len(others) - any(w == word for _, w in others), best[1], best[0])):
                out[name].append(value)

    def close(members: list[tuple[int, int, bool, bool]]) -> None:
        edited = sorted(((n, w) for w, n, whole, _ in members if not whole), key=lambda x: (-x[0], x[1]))
        bare = [(n, w) for w, n, whole, _ in members if whole]
        places = {w: first for w, _, whole, first in members if not whole}
        for word, first in places.items():
            if len(edited) > 1:
                add(word, edited)
            if first and bare:
                add(word, bare)
        for _, word in bare:
            add(word, [x for x in edited if places[x[1]]])

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in out.items()})
        for values in out.values():
            values.clear()
        return made

    last, members = None, []
    for batch in batches:
        for prefix, *rest in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("prefix", "id", "n", "whole", "first"))):
            if prefix != last:
                if len(members) > 1:
                    close(members)
                last, members = prefix, []
            members.append(tuple(rest))
        yield flush()
    if len(members) > 1:
        close(members)
    yield flush()


def variants(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", every: int = 97, shortest: int = 5, least: int = 3, times: int = 2,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    stage = Stage(docs.sparkSession, "spelling")
    words = vocabulary(docs, id_column=id_column, text=text, every=every, shortest=shortest, least=least)
    # Ids rise with the words, so the smallest id stands for the smallest word.
    words = stage.write(words.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    sorted_ = rotations(words).repartition("prefix").sortWithinPartitions("prefix")
    met = sorted_.mapInArrow(scan_ranges, "id long, near long, best long, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best"))).alias("best")
    near = met.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", "best.best", (-F.col("best.order")).alias("best_n"))
    has = F.col("best_n") >= times * F.col("n")
    forms = words.select("id", "n").join(near, "id")
    forms = forms.select("id", "n_near", F.when(has, F.col("best")).alias("form_id"), F.when(has, F.col("best_n")).alias("form_n"))
    forms = stage.write(forms, "forms")
    roots = last_forms(forms.filter(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("root")), stage)
    named = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    found = words.join(forms, "id", "left").join(roots, "id", "left").join(named, "form_id", "left").join(ends, "root", "left")
    return found.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def last_forms(links: DataFrame, stage: Stage) -> DataFrame:
    """``id`` and the ``root`` it ends at. Each turn follows a link's own link, so a path halves; turns are written to the shared folder."""
    turn = 0
    while True:
        links = stage.write(links, f"links{turn}")
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if turn:
            stage.drop(f"links{turn - 1}")
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        links = links.join(ahead, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
        turn += 1
