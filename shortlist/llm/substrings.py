"""Removal of long repeated byte strings, by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
document or another, overlaps included.

Equal strings are first brought together. The window of every start selects an anchor, the
``GRAM`` bytes in it with the smallest hash (the last among equals). That depends on the window's
content alone, so equal windows select equal anchors at equal offsets, and neighbouring starts with
one anchor make up one context, the text from the first start to the end of the last
window. Contexts are grouped by the hash of their anchor. Equal contexts are combined before they are
shuffled, into one with a weight; a context of weight two and more is repeated as a whole.

The distinct contexts of each group become texts of a collection whose Burrows-Wheeler transform is
expanded: beginning with the empty string, breadth first, the interval of every string found is extended
backward by each character before it. An interval whose end has no common-prefix value yet gets the
present depth there and is extended in turn. Values appear in increasing order; at depth
``length`` it stops, and the starts left without a value share at least that much with the one before.

Before that, contexts of groups with several are cut into ranges of starts and grouped again, by
all the bytes that the windows of a range share; what is alone then drops out. A group that still
has very many contexts (a passage within many different texts) is not put into one task but
cut into narrower ranges; at one start per range equal windows meet by their digest.

Defined cases: a null text is the empty text; texts shorter than ``length`` lose nothing, nor do empty
ones; a row that repeats an id and a text counts as another document, so it loses all strings; rows are
told apart by id and text, a null id included; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import Stage, per_row, text_of

GRAM, PIECE = 64, 1 << 19
#: Contexts are cut into ranges of so many starts, and further as long as a group has more contexts than this.
RANGES, MOST_CONTEXTS = (64, 8, 1), 2_000
#: Bytes of contexts that one transform is made of, and of those that one task gets.
COLLECTION, SHARE = 1 << 18, 1 << 22

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Anchors:
    """Finds the anchors of windows of ``length`` bytes."""

    def __init__(self, length: int):
        self.length, self.gram = length, min(GRAM, length)
        n = PIECE + length + 1
        self.down, self.up = _powers(_BACK, n), _powers(_BASE, n)

    def of(self, body: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(hash of the anchor, its position, first start, last start) of every context, in order."""
        starts = len(body) - self.length + 1
        for begin in range(0, starts, PIECE):
            data = np.frombuffer(body, np.uint8, min(PIECE, starts - begin) + self.length - 1, begin)
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUES[data] * self.down[: len(data)], out=sums[1:])
            grams = _mixed((sums[self.gram :] - sums[: -self.gram]) * self.up[: len(data) - self.gram + 1])
            low = np.uint64((1 << 20) - 1)
            best = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
            have, want = 1, self.length - self.gram + 1
            while have < want:
                step = min(have, want - have)
                best = np.minimum(best[:-step], best[step:])
                have += step
            chosen = (low - (best & low)).astype(np.int64)
            edges = np.flatnonzero(np.diff(chosen)) + 1
            first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(chosen)]]) - 1
            at = chosen[first]
            keys = grams[at].astype(np.int64)
            yield from zip(keys.tolist(), (at + begin).tolist(), (first + begin).tolist(), (last + begin).tolist())


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order. ``left``: bytes to the end of each one's own text, where 0, less than all, stands.

    Prefix doubling: eight bytes at first, then twice as many per round. Equal suffixes stay in the order of their texts.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(left >= i, padded[i : n + i], 0).astype(np.uint64)
    order = np.argsort(key)
    have = 8
    while True:
        sorted_ = key[order]
        fresh = np.concatenate([[0], (sorted_[1:] != sorted_[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) + 1
        if int(fresh.sum()) == n - 1:
            return order
        if have > int(left.max()):  # what is left in a tie are equal suffixes of different texts
            return np.argsort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64))
        behind = np.zeros(n, np.int64)
        inside = np.flatnonzero(left >= have)
        behind[inside] = rank[inside + have]
        key = (rank.astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        order = np.argsort(key)
        have *= 2


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Per text, the starts whose ``length`` bytes also start elsewhere in the collection."""
    sizes = np.array([len(b) + 1 for b in bodies])
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    n = len(raw)
    last = np.repeat(ends - 1, sizes)
    left = last - np.arange(n)
    # Bytes are raised by one where there is room for it, so that the end of a text is less than any byte.
    symbols = raw.astype(np.int16) + 1
    symbols[ends - 1] = 0
    present = np.unique(symbols)
    if len(present) > 256:
        raise ValueError("a collection with all 256 byte values cannot be text")
    text = np.searchsorted(present, symbols).astype(np.uint8)

    order = suffix_order(text, left)
    before = text[order - 1]  # the transform; before the first byte stands the end of the last text
    counts = np.bincount(text, minlength=256)
    first = np.concatenate([[0], np.cumsum(counts)])
    to = np.empty(n, np.int64)  # where the suffix that is longer by one stands
    by_char = np.argsort(before, kind="stable")
    to[by_char] = np.arange(n)

    unset = np.ones(n + 1, bool)
    unset[: counts[0] + 1] = False  # ends differ from each other and from all else
    unset[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for depth in range(length):
        width = high - low + 1
        total = int(width.sum())
        rows = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width)
        owner = np.repeat(np.arange(len(low)), width)
        chars = before[rows]
        real = chars != 0
        rows, group = rows[real], owner[real] * 256 + chars[real]
        if not len(rows):
            break
        if (width > 1).any():
            sort = np.argsort(group, kind="stable")
            rows, group = rows[sort], group[sort]
        change = np.flatnonzero(group[1:] != group[:-1])
        begin, end = np.concatenate([[0], change + 1]), np.concatenate([change, [len(group) - 1]])
        low, high = to[rows[begin]], to[rows[end]]
        if depth == 0:  # the ends of texts are strings of their own too
            low, high = np.concatenate([np.arange(counts[0]), low]), np.concatenate([np.arange(counts[0]), high])
        else:
            new = unset[high + 1]
            low, high = low[new], high[new]
        unset[high + 1] = False  # the common prefix with the next row has ``depth`` bytes
        if not len(low):
            break
    shares = unset[:n] | unset[1:]
    shares[: counts[0]] = False
    marked = np.zeros(n, bool)
    marked[order[shares]] = True
    return [np.flatnonzero(marked[e - s : e - 1]) for e, s in zip(ends.tolist(), sizes.tolist())]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], breaks + 1])].tolist(), starts[np.concatenate([breaks, [len(starts) - 1]])].tolist()))


def _expand(length: int):
    """Marks of the contexts of weight one in a set of groups, in collections of bounded size.

    Rows come ordered by group; a group is in one collection as a whole.
    """

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = table.column("key").to_numpy()
        weights, low = table.column("n").to_numpy(), table.column("low").to_numpy()
        bodies = table.column("body").to_pylist()
        rows, lo, hi = [], [], []
        start = 0
        while start < len(bodies):
            stop, size = start, 0
            while stop < len(bodies) and (size < COLLECTION or keys[stop] == keys[stop - 1]):
                size += len(bodies[stop])
                stop += 1
            for i, found in enumerate(repeated_starts(bodies[start:stop], length), start):
                if weights[i] == 1:
                    for a, b in _runs(found):
                        rows.append(i)
                        lo.append(a + int(low[i]))
                        hi.append(b + int(low[i]))
            start = stop
        made = table.select(["id", "print"]).take(pa.array(rows, pa.int64()))
        return made.append_column("low", pa.array(lo, pa.int64())).append_column("high", pa.array(hi, pa.int64()))

    return task


def _ranges(rows: DataFrame, kind: str, length: int, starts: int) -> DataFrame:
    """Contexts cut into ranges of ``starts`` starts by their offset from the anchor, without their bytes.

    A range is grouped by the bytes that all its windows share; equal windows are in equal ranges.
    """

    def cut(batch):
        out: dict[str, list] = {k: [] for k in ("key", "digest", "n", "id", "print", "low", "high", "anchor")}
        for n, own, mark, low, anchor, body in zip(*(batch[c] for c in ("n", "id", "print", "low", "anchor", "body"))):
            high = low + len(body) - length
            for part in range((anchor - high) // starts, (anchor - low) // starts + 1):
                here, there = anchor - (part + 1) * starts + 1, anchor - part * starts
                core = body[there - low : max(0, here - low + length)]
                lo, hi = max(low, here), min(high, there)
                out["key"].append(xxhash.xxh3_64_intdigest(core, seed=part + 1) - (1 << 63))
                out["digest"].append(xxhash.xxh3_128_digest(body[lo - low : hi - low + length]))
                for name, value in (("n", n), ("id", own), ("print", mark), ("low", lo), ("high", hi), ("anchor", anchor)):
                    out[name].append(value)
        return out

    return per_row(rows, f"key long, digest binary, n long, id {kind}, print long, low long, high long, anchor long", cut)


def marks(docs: DataFrame, length: int, stage: Stage) -> DataFrame:
    """``id``, ``print``, ``low``, ``high``: ranges of starts of repeated strings, for the rows (``id``, ``print``, ``text``) of ``docs``."""
    kind = docs.schema["id"].dataType.simpleString()

    def contexts(batch):
        out: dict[str, list] = {k: [] for k in ("key", "digest", "id", "print", "low", "high", "anchor")}
        finder = Anchors(length)
        for own, mark, text in zip(batch["id"], batch["print"], batch["text"]):
            body = text.encode("utf-8", "replace")
            for key, at, low, high in finder.of(body):
                out["key"].append(key)
                out["digest"].append(xxhash.xxh3_128_digest(body[low : high + length]))
                out["id"].append(own)
                out["print"].append(mark)
                out["low"].append(low)
                out["high"].append(high)
                out["anchor"].append(at)
        return out

    schema = f"key long, digest binary, id {kind}, print long, low long, high long, anchor long"
    found = stage.write(per_row(docs, schema, contexts, step=64), "contexts")

    def combined(rows: DataFrame) -> DataFrame:
        one = F.max(F.struct("id", "print", "low", "high", "anchor")).alias("one")
        return rows.groupBy("key", "digest").agg(F.sum("n").alias("n"), one).select("key", "digest", "n", "one.*")

    def open_groups(distinct: DataFrame) -> DataFrame:
        """Groups of several contexts of which one at least is not repeated as a whole."""
        groups = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least"))
        return groups.filter((F.col("contexts") > 1) & (F.col("least") == 1)).select("key", "contexts")

    distinct = stage.write(combined(found.withColumn("n", F.lit(1).cast("long"))), "distinct")
    made = found.join(distinct.filter(F.col("n") > 1).select("key", "digest"), ["key", "digest"]).select("id", "print", "low", "high")

    wanted = distinct.join(open_groups(distinct), "key")
    requests = wanted.groupBy("id", "print").agg(F.collect_list(F.struct("n", "low", "high", "anchor")).alias("wanted"))
    texts = docs.dropDuplicates(["id", "print"]).alias("d").join(
        requests.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.print") == F.col("r.print"))
    ).select("d.id", "d.print", "d.text", "r.wanted")

    def bodies(batch):
        out: dict[str, list] = {k: [] for k in ("n", "id", "print", "low", "anchor", "body")}
        for own, mark, text, wanted in zip(batch["id"], batch["print"], batch["text"], batch["wanted"]):
            body = text.encode("utf-8", "replace")
            for w in wanted:
                values = w["n"], own, mark, w["low"], w["anchor"], body[w["low"] : w["high"] + length]
                for name, value in zip(out, values):
                    out[name].append(value)
        return out

    rows = stage.write(per_row(texts, f"n long, id {kind}, print long, low long, anchor long, body binary", bodies, step=64), "bodies")
    for turn, starts in enumerate(RANGES):
        parts = stage.write(_ranges(rows, kind, length, starts), f"parts{turn}")
        distinct = stage.write(combined(parts), f"distinct{turn}")
        whole = distinct.filter(F.col("n") > 1).select("key", "digest")
        made = made.unionByName(parts.filter(F.col("n") == 1).join(whole, ["key", "digest"]).select("id", "print", "low", "high"))
        wanted, of = distinct.join(open_groups(distinct), "key").alias("w"), rows.alias("r")
        inside = (F.col("r.low") <= F.col("w.low")) & (F.col("w.high") + length <= F.col("r.low") + F.octet_length("r.body"))
        same = F.col("w.id").eqNullSafe(F.col("r.id")) & (F.col("w.print") == F.col("r.print")) & (F.col("w.anchor") == F.col("r.anchor"))
        body = F.substring(F.col("r.body"), (F.col("w.low") - F.col("r.low") + 1).cast("int"), (F.col("w.high") - F.col("w.low") + length).cast("int"))
        rows = stage.write(of.join(wanted, same & inside).select("w.key", "w.n", "w.id", "w.print", "w.low", "w.anchor", "w.contexts", body.alias("body")), f"rows{turn}")
        cold = rows.filter(F.col("contexts") <= MOST_CONTEXTS)
        if size := cold.agg(F.sum(F.octet_length("body"))).first()[0] or 0:
            bucket = F.pmod(F.xxhash64("key"), F.lit(size // SHARE + 1)).alias("bucket")
            cold = cold.select("key", "n", "id", "print", "low", "body", bucket)
            marked = cold.groupBy("bucket").applyInArrow(_expand(length), f"id {kind}, print long, low long, high long")
            made = made.unionByName(stage.write(marked, f"marks{turn}"))
        rows = rows.filter(F.col("contexts") > MOST_CONTEXTS)
        if rows.isEmpty():
            break
    return made


def spans(ranges: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes (first, one past the last) of ranges of starts."""
    out: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high + length)
        else:
            out.append((low, high + length))
    return out


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", length: int = 400, with_text: bool = False) -> DataFrame:
    """One row per document: its id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes and the spans."""
    stage = Stage(docs.sparkSession, "substrings")
    body = text_of(text)
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(body).alias("print"), body.alias("text"))
    made = marks(rows, length, stage).groupBy("id", "print").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    same = F.col("d.id").eqNullSafe(F.col("m.id")) & (F.col("d.print") == F.col("m.print"))
    joined = rows.alias("d").join(made.alias("m"), same, "left").select(F.col("d.id").alias("key"), F.col("d.text").alias("text"), "m.ranges")

    def remove(batch):
        out: dict[str, list] = {k: [] for k in ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
        for key, text, ranges in zip(batch["key"], batch["text"], batch["ranges"]):
            body, gone = text.encode("utf-8", "replace"), spans(ranges or [], length)
            edges = [0, *(x for span in gone for x in span), len(body)]
            kept = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
            values = key, len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [list(s) for s in gone]
            for name, value in zip(out, values):
                out[name].append(value)
        return out

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    full = f"{schema}, kept binary, spans array<array<long>>"
    return per_row(joined, full if with_text else schema, remove).withColumnRenamed("key", id_column)
