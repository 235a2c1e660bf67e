"""Near-duplicates by an inverted join over the coordinates of MinHash signatures.

A document is the set of its hashed word shingles; documents with equal sets form a class, and all
that follows works on classes. The signature of a class has ``coordinates`` values. Every pair of
coordinate and value is a token with a posting list, and two classes collide on the tokens
they share. Pairs with at least ``collisions`` of them are candidates, confirmed on their full sets.

Lists are merged with prefixes and skips. Tokens are ordered by how many classes hold them.
Two classes that share ``collisions`` of ``coordinates`` tokens share one of the first
``coordinates - collisions + 1`` of either, so a class is posted under these, its rarest tokens, only,
and the long lists of common passages are skipped.

What matters in the end is who is connected, so pairs already connected are not compared. First each
list links its members to one centre, at first to the class with the most collisions in all, which is
the one most like the others, then to others in further rounds; the confirmed links give components.
Then lists that still hold several components are compared in full across components, in bands of
set size beyond which no pair can reach the threshold, and long lists in pairs of blocks, so
that no task holds more than two blocks. No list emits the pairs within a component.

A bitmap per class spares most comparisons of full sets: every shingle flips one of ``bits`` bits, so two
bitmaps differ in at most as many bits as the sets differ in shingles. A pair whose bitmaps differ in
more than the threshold allows is no link, whatever its collisions; all others are confirmed.

With 64 coordinates and 36 collisions, a pair of similarity 0.8 is missed with a probability of 4e-6.

Defined cases: a text with fewer words than a shingle has one shingle, its whole word sequence;
a null text and one without words has none, is linked with nothing and is its own component; rows
that repeat an id and a text share all their results; a null id is the component id only of a
component without another id; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import LOWER, UPPER, Stage, few_parts, per_row, text_of
from shortlist.llm.components import components

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles. ``bytes.split`` parts at space and the characters 9 to 13."""
    own = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not own:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    length = min(words, len(own))
    made = np.full(len(own) - length + 1, np.uint64(length), np.uint64)
    for i in range(length):
        made = mixed(made * _MIX[0] + hashes[i : len(own) - length + 1 + i])
    return np.unique(made)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The smallest value per coordinate; a long set is read piece by piece."""
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    keys = mixed(np.arange(1, coordinates + 1, dtype=np.uint64) * _MIX[0]) | np.uint64(1)
    for start in range(0, len(shingles), 1 << 16):
        piece = shingles[start : start + (1 << 16)]
        for i in range(coordinates):
            value = (piece * keys[i]) >> np.uint64(32)
            least[i] = min(least[i], value.min())
    return least


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits, a power of two from 64 on, as integers; each shingle flips one of them."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, *, id_column: str, text: str, shingle_words: int, coordinates: int, bits: int) -> DataFrame:
    """Per row: ``id``; ``size`` and ``digest`` of its set, its signature of ``coordinates`` integers and its bitmap."""

    def rows(batch):
        out: dict[str, list] = {"id": batch["id"], "size": [], "digest": [], "signature": [], "bitmap": []}
        for body in batch["text"]:
            found = shingle_set(body, shingle_words)
            out["size"].append(len(found))
            out["digest"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            out["signature"].append(signature(found, coordinates).astype(np.int32).tolist() if len(found) else None)
            out["bitmap"].append(bitmap(found, bits).tolist() if len(found) else None)
        return out

    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    return per_row(frame, f"id {kind}, size long, digest binary, signature array<int>, bitmap array<long>", rows)


def confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) of class numbers whose sets reach the threshold.

    Sets are computed again from one text of each class that stands in a pair, found by its id and
    recognised by the digest of its set.
    """
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = needed.join(classes.select("class", "digest", "id"), "class")
    found = texts.join(needed, texts["id"].eqNullSafe(needed["id"])).select("class", "digest", "text")

    def sets(batch):
        out: dict[str, list] = {"class": [], "shingles": []}
        for number, digest, body in zip(batch["class"], batch["digest"], batch["text"]):
            own = shingle_set(body, shingle_words).tobytes()
            if hashlib.blake2b(own, digest_size=16).digest() == digest:
                out["class"].append(number)
                out["shingles"].append(own)
        return out

    own = per_row(found, "class long, shingles binary", sets).dropDuplicates(["class"])
    both = pairs.join(own.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(own.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")

    def compare(batch):
        out: dict[str, list] = {"a": [], "b": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["x"], batch["y"]):
            left, right = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * common >= percent * (len(left) + len(right) - common):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return per_row(both, "a long, b long", compare, step=64)


@dataclass
class _Members:
    """The classes of one list, or of two blocks of it: one entry or row for each."""

    number: np.ndarray
    component: np.ndarray
    size: np.ndarray
    home: np.ndarray
    block: np.ndarray
    signature: np.ndarray
    bitmap: np.ndarray
    #: The coordinates under which the class stands in a list.
    posted: np.ndarray

    def by_size(self) -> _Members:
        order = np.lexsort((self.number, self.size))
        return _Members(*(getattr(self, field.name)[order] for field in fields(self)))


def _across(of: _Members, at: int, collisions: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in different components that have enough collisions and may reach the threshold, in blocks.

    A pair is emitted by the list of its first common coordinate, ``at``, and skipped in all others. Of
    two blocks only pairs between them are compared.
    """
    of = of.by_size()
    between = len(of.block) and (of.block != of.block[0]).any()
    for start in range(0, len(of.number), 128):
        stop = min(start + 128, len(of.number))
        last = int(np.searchsorted(of.size, of.size[stop - 1] * 100 // percent, side="right"))
        for other in range(start, last, 2048):
            to = min(other + 2048, last)
            open_ = of.component[start:stop, None] != of.component[None, other:to]
            open_ &= np.arange(start, stop)[:, None] < np.arange(other, to)[None, :]
            open_ &= of.home[start:stop, None] | of.home[None, other:to]
            open_ &= of.size[start:stop, None] * 100 >= of.size[None, other:to] * percent
            if between:
                open_ &= of.block[start:stop, None] != of.block[None, other:to]
            i, j = np.nonzero(open_)
            i, j = i + start, j + other
            for piece in range(0, len(i), 1 << 15):
                left, right = i[piece : piece + (1 << 15)], j[piece : piece + (1 << 15)]
                # Of signed integers NumPy counts the bits of the absolute value.
                apart = np.bitwise_count((of.bitmap[left] ^ of.bitmap[right]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                near = apart * (100 + percent) <= (of.size[left] + of.size[right]) * (100 - percent)
                left, right = left[near], right[near]
                same = of.signature[left] == of.signature[right]
                enough = same.sum(axis=1) >= collisions
                left, right, same = left[enough], right[enough], same[enough]
                first = (same & of.posted[left] & of.posted[right]).argmax(axis=1) == at
                yield of.number[left[first]], of.number[right[first]]


def linked(
    docs: DataFrame, stage: Stage, *, id_column: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80,
    coordinates: int = 64, collisions: int = 36, rounds: int = 3, bits: int = 1024, block: int = 1 << 14,
) -> tuple[DataFrame, DataFrame]:
    """Membership (``id``, ``n_shingles``, ``class``) of every row, and ``class``, ``component``, ``component_id`` of every class."""
    rows = stage.write(sketches(docs, id_column=id_column, text=text, shingle_words=shingle_words, coordinates=coordinates, bits=bits), "rows")
    texts = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    # Of equal sets all signatures and bitmaps are equal, so any stands for the class.
    classes = rows.filter(F.col("size") > 0).groupBy("digest", "size").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bitmap").alias("bitmap"))
    classes = stage.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    tokens = classes.select("class", F.posexplode("signature").alias("at", "value"))
    tokens = tokens.select("class", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))
    frequency = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > 1)
    # Tokens of one class only come first in the order and have lists of one, which link nothing.
    shared = tokens.join(frequency, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("classes", "token"))).alias("held"))
    room = F.greatest(F.lit(0), F.size("held") - (collisions - 1))
    # All the class's collisions with others: the class with the most of them in a list is the one most like the rest.
    alike = F.aggregate("held.classes", F.lit(0).cast("long"), lambda s, x: s + x)
    posted = shared.select("class", alike.alias("alike"), F.slice(F.col("held.token"), F.lit(1), room).alias("tokens")).filter(F.size("tokens") > 0)
    postings = stage.write(posted.select("class", "alike", F.explode("tokens").alias("token")), "postings")

    narrow = classes.select("class", "size", "signature", "bitmap")
    state = edges = None
    for turn in range(rounds):
        own = _with_component(postings, state)
        order = F.xxhash64("class", F.lit(turn)) if turn else -F.col("alike")
        centre = F.min(F.struct(order.alias("order"), "component", "class"))
        centres = own.groupBy("token").agg(centre.alias("centre"), F.min("component").alias("low"), F.max("component").alias("high"))
        centres = centres.filter(F.col("low") != F.col("high")).select("token", "centre")
        # Of the centres of its lists, each class is compared with the one it meets most often.
        met = own.join(centres, "token").filter(F.col("component") != F.col("centre.component"))
        met = met.groupBy("class", F.col("centre.class").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        pairs = met.groupBy("class").agg(F.max(F.struct("times", "b")).alias("best")).select(F.col("class").alias("a"), F.col("best.b").alias("b"))
        pairs = stage.write(few_parts(_colliding(pairs, narrow, collisions, percent)), f"star{turn}")
        made = stage.write(few_parts(confirmed(pairs, classes, texts, shingle_words, percent)), f"edges{turn}")
        edges = made if edges is None else edges.unionByName(made)
        state = components(edges, stage, f"state{turn}_").select(F.col("node").alias("class"), "component")

    # Lists that still hold more than one component, compared across components.
    own = _with_component(postings, state)
    several = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("length"))
    several = several.filter(F.col("low") != F.col("high")).select("token", F.ceil(F.col("length") / block).alias("blocks"))
    places = own.join(several, "token").drop("alike")
    at = F.shiftright("token", 32).cast("int")
    masks = places.groupBy("class").agg(*(F.sum(F.when((at >= lo) & (at < lo + 32), F.pow(F.lit(2.0), at - lo).cast("long")).otherwise(F.lit(0))).alias(f"mask{lo}") for lo in range(0, coordinates, 32)))
    mask = F.array(*(f"mask{lo}" for lo in range(0, coordinates, 32)))
    own = places.join(narrow.join(masks.select("class", mask.alias("posted")), "class"), "class")
    # Sizes of a pair differ by at most a band, so it meets in the band of the larger one, at home or as a guest.
    band = F.floor(F.log(F.col("size").cast("double")) / (F.log(F.lit(100.0 / percent)) * (1 + 1e-9))).cast("int")
    bands = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home"))))
    own = own.select("token", "class", "component", "size", "signature", "bitmap", "posted", "blocks", bands.alias("place")).select("*", "place.*").drop("place")
    # A long list is dealt into blocks; a class goes to every pair of blocks that holds its own.
    mine, every = F.pmod(F.xxhash64("class"), "blocks"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    meets = F.explode(F.transform(every, lambda other: F.struct(F.least(mine, other).alias("one"), F.greatest(mine, other).alias("two"))))
    own = own.select("*", mine.alias("block"), meets.alias("meets")).select("*", "meets.*").drop("meets", "blocks")
    pairs = stage.write(own.groupBy("token", "band", "one", "two").applyInArrow(_list_pairs(collisions, percent), "a long, b long"), "across")
    made = stage.write(few_parts(confirmed(pairs, classes, texts, shingle_words, percent)), "edges")
    label = components(edges.unionByName(made), stage, "final_").select(F.col("node").alias("class"), "component")
    found = _with_component(classes, label)
    smallest = found.groupBy("component").agg(F.min("id").alias("component_id"))
    found = found.join(smallest, "component").select("digest", "class", "component", "component_id")
    return rows.select("id", F.col("size").alias("n_shingles"), "digest"), found


def _with_component(classes: DataFrame, state: DataFrame | None) -> DataFrame:
    """Adds ``component``; a class without links is its own."""
    if state is None:
        return classes.withColumn("component", F.col("class"))
    return classes.join(state, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _colliding(pairs: DataFrame, narrow: DataFrame, collisions: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) with enough collisions over all coordinates that may reach the threshold by size and bitmap."""
    left = narrow.select(F.col("class").alias("a"), F.col("size").alias("size_a"), F.col("signature").alias("sign_a"), F.col("bitmap").alias("bits_a"))
    right = narrow.select(F.col("class").alias("b"), F.col("size").alias("size_b"), F.col("signature").alias("sign_b"), F.col("bitmap").alias("bits_b"))
    near = F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent
    same = F.aggregate(F.zip_with("sign_a", "sign_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    may = apart * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    return pairs.join(left, "a").join(right, "b").filter(near & may & (same >= collisions)).select("a", "b")


def _list_pairs(collisions: int, percent: int):
    def pairs(group: pa.Table) -> pa.Table:
        component, count = group.column("component").to_numpy(), group.num_rows
        made = []
        if count > 1 and (component != component[0]).any():
            plain = {name: group.column(name).to_numpy() for name in ("class", "size", "home", "block")}
            wide = {name: group.column(name).combine_chunks().flatten().to_numpy().reshape(count, -1) for name in ("signature", "bitmap", "posted")}
            posted = (wide["posted"][:, :, None] >> np.arange(32)[None, None, :] & 1).reshape(count, -1)[:, : wide["signature"].shape[1]].astype(bool)
            of = _Members(plain["class"], component, plain["size"], plain["home"], plain["block"], wide["signature"], wide["bitmap"], posted)
            made = list(_across(of, group.column("token")[0].as_py() >> 32, collisions, percent))
        a = np.concatenate([m[0] for m in made]) if made else np.empty(0, np.int64)
        b = np.concatenate([m[1] for m in made]) if made else np.empty(0, np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return pairs


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", **options) -> DataFrame:
    """One row per document: its id, n_shingles, component_id, kept (whether it has the component's smallest id)."""
    stage, kept = Stage(docs.sparkSession, "neardup"), Stage(docs.sparkSession, "neardup")
    rows, classes = linked(docs, stage, id_column=id_column, **options)
    found = rows.join(classes.select("digest", "component_id"), "digest", "left")
    own = F.coalesce("component_id", "id")
    found = found.select(F.col("id").alias(id_column), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
    # A few numbers a document are kept; signatures, bitmaps and links go now.
    found = kept.write(found, "found")
    stage.remove(stage.folder)
    return found
