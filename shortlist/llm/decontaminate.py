"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``2 * BLOCK`` words, one every ``BLOCK`` words, weighted by term frequency and
inverse document frequency over the words that the benchmark uses (no other word adds to a product with
an item). Document frequencies are counted over all documents. A randomised singular value
decomposition of passages and items, computed where the passages are, gives the latent space; each
passage of every document is projected and compared by cosine with all items. What comes close
is a candidate, confirmed on its words (so passages that no answer is near, and texts that hold half of no answer, are not projected): the longest common subsequence with the item, in the
passage and an item's length around it, must hold ``least_common`` of the item's words, and at least
half of its answer must stand there. The answer is what follows the last question mark, or else the
item's ``ANSWER`` rarest words, so that common words in the right order are not enough.

The space is fitted on all passages and on all items; both parts weigh the same, so items keep directions of
their own. Texts are taken apart once: the used words of each block are written as numbers beside the text, and counts, products and the search
read these; a text is taken apart again if it holds a candidate. Up to ``WIDEST`` used words the passages are read once, into the products of
all pairs of words that meet in a passage; with more words, products with the wanted directions are added up in two readings.
Items are queries and taken in blocks of ``block_items``, so what goes to tasks is bounded.

Defined cases: null and empty texts and texts without words hold no passage; items without words match nothing; of rows that repeat an item
id, each is searched; several places of an item in one document give one row, the best; documents that repeat are
each found, and rows that repeat an id give one row; extra columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import Stage, per_row, release, small_batches, text_of

WORD = re.compile(r"[^\W_]+")
BLOCK, ANSWER, ROWS, GROUPS = 16, 4, 256, 32
#: Used words up to which a task holds the products of all pairs of them (as float64).
WIDEST = 4096


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def common_subsequence(item: dict[str, int], words: list[str], length: int) -> int:
    """Length of the longest common subsequence; ``item`` has a bit for each position of a word. One step per word."""
    full = (1 << length) - 1
    free = full
    for word in words:
        if hits := item.get(word):
            met = free & hits
            free = ((free + met) | (free - met)) & full
    return length - free.bit_count()


@dataclass
class Item:
    key: object
    words: list[str]
    answer: frozenset[str] = frozenset()
    bits: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(key, text: str, frequency: dict[str, int]) -> Item:
        words = words_of(text)
        after = words_of(text.rsplit("?", 1)[1]) if text and "?" in text else []
        rare = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))[:ANSWER]
        bits: dict[str, int] = {}
        for i, w in enumerate(words):
            bits[w] = bits.get(w, 0) | 1 << i
        return Item(key, words, frozenset(after or rare), bits)

    def share(self, region: list[str]) -> float:
        """Share of the item's words in common order with ``region``, 0 without half of the answer."""
        if 2 * len(self.answer.intersection(region)) < len(self.answer):
            return 0.0
        return common_subsequence(self.bits, region, len(self.words)) / len(self.words)


@dataclass
class Space:
    """The words in use with their weights, the latent directions, and the items in them (rows of length one)."""

    place: dict[str, int]
    weight: np.ndarray
    directions: np.ndarray
    items: list[Item]
    latent_items: np.ndarray
    least_norm: float
    #: For every word in use the items in whose answer it stands, as 0 or 1.
    answers: np.ndarray = field(init=False)

    def __post_init__(self):
        self.answers = np.zeros((len(self.place), len(self.items)), np.uint8)
        for number, item in enumerate(self.items):
            self.answers[[self.place[w] for w in item.answer], number] = 1

    def near(self, places: np.ndarray, block: np.ndarray, passages: int) -> np.ndarray | None:
        """Whether a word of an answer stands within an item's length of each passage; None if no item can be confirmed.

        Half of an answer must stand in the text, so only items of which this much does are looked at.
        """
        held = self.answers[np.unique(places)].sum(axis=0, dtype=np.int64)
        able = np.flatnonzero(2 * held >= [len(item.answer) for item in self.items])
        if not len(able):
            return None
        far = -(-max(len(self.items[i].words) for i in able) // BLOCK)
        marked = np.zeros(passages + 2 * far + 2, np.int64)
        marked[block[self.answers[:, able].any(axis=1)[places]] + far + 1] = 1
        before = np.cumsum(marked)
        first = np.arange(passages)
        return before[np.minimum(first + 2 * far + 2, len(before) - 1)] > before[first]


def vector(words: list[str], place: dict[str, int], weight: np.ndarray) -> np.ndarray:
    out = np.zeros(len(weight))
    for word, times in Counter(words).items():
        if word in place:
            out[place[word]] = times * weight[place[word]]
    return out


def used_words(docs: DataFrame, stage: Stage, place: dict[str, int], text: str, id_column: str | None = None) -> DataFrame:
    """Per document its words in use (``places``) with the ``blocks`` they stand in, its number of ``passages``, and its ``text`` and id (``doc``)."""
    kind = docs.schema[id_column].dataType.simpleString() if id_column else "int"

    def rows(batch):
        out: dict[str, list] = {"places": [], "blocks": [], "passages": [], "doc": batch["doc"], "text": batch["text"]}
        for body in batch["text"]:
            words = words_of(body)
            places = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
            used = np.flatnonzero(places >= 0)
            out["places"].append(places[used])
            out["blocks"].append((used // BLOCK).astype(np.int32))
            # Two blocks each; the last ones of a text may be short.
            out["passages"].append(max(1, -(-len(words) // BLOCK) - 1) if words else 0)
        return out

    own = F.col(id_column) if id_column else F.lit(0)
    schema = f"places array<int>, blocks array<int>, passages int, doc {kind}, text string"
    return stage.write(per_row(docs.select(own.alias("doc"), text_of(text).alias("text")), schema, rows), "words")


def document_frequencies(used: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each of the ``size`` words in use, and the number of documents."""

    def task(batches):
        found, docs = np.zeros(size, np.int64), 0
        for batch in batches:
            places, lengths = batch.column(0).flatten().to_numpy(), _lengths(batch.column(0))
            pairs = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + places)
            found += np.bincount(pairs % size, minlength=size)
            docs += len(lengths)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([docs, *found[held].tolist()], pa.int64())], ["place", "docs"])

    parts = used.select("places").mapInArrow(task, "place int, docs long")
    sums = {r["place"]: r["docs"] for r in parts.groupBy("place").agg(F.sum("docs").alias("docs")).collect()}
    return np.array([sums.get(i, 0) for i in range(size)], np.int64), sums.get(-1, 0)


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def _pieces(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words in use of ``step + 1`` neighbouring blocks at a time, the block of each, and where a passage (two blocks) begins."""
    for batch in batches:
        lengths, passages = _lengths(batch.column(0)), batch.column(2).to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(passages + 1)])  # blocks are numbered on over documents; no passage begins in a last one
        places = batch.column(0).flatten().to_numpy()
        row = batch.column(1).flatten().to_numpy() + np.repeat(first[:-1], lengths)
        begins = np.ones(first[-1], bool)
        begins[first[1:] - 1] = False
        for start in range(0, len(begins) - 1, step):
            stop = min(start + step, len(begins) - 1)
            a, b = np.searchsorted(row, [start, stop + 1])
            if a < b:
                yield places[a:b].astype(np.int64), row[a:b] - start, begins[start:stop]


def _few_tasks(used: DataFrame) -> DataFrame:
    """What the products read, in a few tasks a core: every task hands on a part of one size, however little it has read."""
    return used.select("places", "blocks", "passages").coalesce(max(GROUPS, 4 * used.sparkSession.sparkContext.defaultParallelism))


def _part_of_product(places: np.ndarray, row: np.ndarray, begins: np.ndarray, weight: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``P' P factor`` of neighbouring blocks, as word numbers and their rows.

    ``row`` is the block of every word, in order, of ``len(begins) + 1`` blocks; passage i, blocks i and i + 1, counts where ``begins[i]``.
    """
    words, at = np.unique(places, return_inverse=True)
    n, size = len(begins), len(words)
    blocks = np.bincount(row * size + at, minlength=(n + 1) * size).reshape(n + 1, size) * weight[words].astype(np.float32)
    passages = (blocks[:-1] + blocks[1:]).astype(np.float32)
    square = np.einsum("ij,ij->i", passages, passages)
    scale = np.where(begins & (square > 0), 1 / np.maximum(square, 1e-24), 0).astype(np.float32)  # both sides of the product are of length one
    return words, passages.T @ (passages @ factor[words] * scale[:, None])


def gram_product(used: DataFrame, weight: np.ndarray, factor: np.ndarray, step: int = 64) -> np.ndarray:
    """``P' P factor`` for the passages P, each of length one: every task sums its own part, and the parts are summed by blocks of rows."""
    width, narrow = factor.shape, factor.astype(np.float32)

    def task(batches):
        total = np.zeros(width)
        for places, row, begins in _pieces(batches, step):
            at, part = _part_of_product(places, row, begins, weight, narrow)
            total[at] += part
        starts = range(0, width[0], ROWS)
        own = [TaskContext.get().partitionId() % GROUPS] * len(starts)
        parts = pa.array([total[a : a + ROWS].tobytes() for a in starts], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array(own, pa.int32()), parts], ["start", "own", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(p, np.float64) for p in table.column("part").to_pylist()], axis=0)
        return pa.table({"start": table.column("start")[:1], "own": table.column("own")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    # Tasks are added up in groups first, so that no task holds the parts of all.
    schema = "start int, own int, part binary"
    summed = _few_tasks(used).mapInArrow(task, schema).groupBy("start", "own").applyInArrow(add, schema).groupBy("start").applyInArrow(add, schema)
    out = np.zeros(width)
    for row in summed.collect():
        part = np.frombuffer(bytes(row["part"]), np.float64).reshape(-1, width[1])
        out[row["start"] : row["start"] + len(part)] = part
    return out


def _edges(size: int) -> np.ndarray:
    """Where each row of an upper triangle begins when its rows lie one after the other, and the end of the last."""
    return np.concatenate([[0], np.cumsum(size - np.arange(size))])


def _part_of_matrix(places: np.ndarray, row: np.ndarray, begins: np.ndarray, weight: np.ndarray, total: np.ndarray, edges: np.ndarray) -> None:
    """Adds ``P' P`` of neighbouring blocks, as in ``_part_of_product``, to ``total``: the rows of its upper triangle, laid out by ``edges``."""
    n, size = len(begins), len(weight)
    # A word's count in both blocks of a passage together, by passage and word.
    keys = np.concatenate([row[row < n] * size + places[row < n], (row[row > 0] - 1) * size + places[row > 0]])
    keys, times = np.unique(keys, return_counts=True)
    own, word = np.divmod(keys, size)
    value = times * weight[word]
    square = np.bincount(own, value**2, n)
    value = value * np.where(begins & (square > 0), 1 / np.sqrt(np.maximum(square, 1e-24)), 0)[own]
    # Each word of a passage meets itself and those behind it.
    meets = np.cumsum(np.bincount(own, minlength=n))[own] - np.arange(len(own))
    left = np.repeat(np.arange(len(own)), meets)
    right = left + np.arange(len(left)) - np.repeat(np.cumsum(meets) - meets, meets)
    np.add.at(total, (edges[word] - word)[left] + word[right], value[left] * value[right])


def gram_matrix(used: DataFrame, weight: np.ndarray, step: int = 256) -> np.ndarray:
    """``P' P`` for the passages P, each of length one, on and above the diagonal; for few enough words.

    Tasks hold the upper triangle alone; parts hold what is not 0 of ``ROWS`` rows.
    """
    size = len(weight)
    edges = _edges(size)

    def ends(start: int) -> tuple[int, int]:
        return edges[start], edges[min(start + ROWS, size)]

    def packed(start: int, own: int, total: np.ndarray) -> dict:
        at = np.flatnonzero(total)
        return {"start": start, "own": own, "at": at.astype(np.int32).tobytes(), "part": total[at].astype(np.float32).tobytes()}

    arrow = pa.schema([("start", pa.int32()), ("own", pa.int32()), ("at", pa.binary()), ("part", pa.binary())])

    def task(batches):
        total = np.zeros(edges[-1])
        for places, row, begins in _pieces(batches, step):
            _part_of_matrix(places, row, begins, weight, total, edges)
        own = TaskContext.get().partitionId() % GROUPS
        for start in range(0, size, ROWS):
            yield pa.RecordBatch.from_pylist([packed(start, own, total[slice(*ends(start))])], schema=arrow)
        total = None
        release()

    def unpacked(at: bytes, part: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(at, np.int32), np.frombuffer(part, np.float32)

    def add(table: pa.Table) -> pa.Table:
        start = table.column("start")[0].as_py()
        total = np.zeros(np.diff(ends(start))[0])
        for at, part in zip(table.column("at"), table.column("part")):
            places, values = unpacked(at.as_py(), part.as_py())
            total[places] += values
        return pa.Table.from_pylist([packed(start, table.column("own")[0].as_py(), total)], schema=arrow)

    schema = "start int, own int, at binary, part binary"
    summed = _few_tasks(used).mapInArrow(task, schema).groupBy("start", "own").applyInArrow(add, schema).groupBy("start").applyInArrow(add, schema)
    out = np.zeros((size, size))
    for row in summed.collect():
        places, values = unpacked(bytes(row["at"]), bytes(row["part"]))
        places = places + edges[row["start"]]
        own = np.searchsorted(edges, places, "right") - 1
        out[own, places - edges[own] + own] = values
    return out


def directions(used: DataFrame, weight: np.ndarray, items: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors of all passages and items, by a randomised range, refined once."""
    width = items.shape[1]
    extra = min(width, rank + 16)
    count = used.agg(F.sum("passages")).first()[0] or 0
    scale = max(1.0, count / max(1, len(items)))  # the items together weigh as much as the passages
    upper = gram_matrix(used, weight) if width <= WIDEST else None

    def product(factor: np.ndarray) -> np.ndarray:
        if upper is None:
            own = gram_product(used, weight, factor)
        else:
            own = upper @ factor + upper.T @ factor - np.diagonal(upper)[:, None] * factor
        return own + scale * (items.T @ (items @ factor))

    basis = np.linalg.qr(product(np.random.default_rng(seed).normal(size=(width, extra))))[0]
    gram = basis.T @ product(basis)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return basis @ vectors[:, np.argsort(-values)[: min(rank, extra)]]


def places_of(items: list[tuple]) -> dict[str, int]:
    """The words in use, numbered."""
    return {w: i for i, w in enumerate(sorted({w for _, t in items for w in words_of(t)}))}


def learn(used: DataFrame, place: dict[str, int], items: list[tuple], *, rank: int) -> Space:
    held, count = document_frequencies(used, len(place))
    frequency = {w: int(n) for w, n in zip(place, held) if n}
    weight = np.log((count + 1) / (held + 1)) + 0.1
    made = [Item.of(key, t, frequency) for key, t in items]
    raw = np.array([vector(item.words, place, weight) for item in made]).reshape(len(made), len(place))
    norms = np.linalg.norm(raw, axis=1)
    unit = raw / np.maximum(norms, 1e-12)[:, None]
    found = directions(used, weight, unit, rank)
    latent = unit @ found
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-12)[:, None]
    return Space(place, weight, found.astype(np.float32), made, latent.astype(np.float32), 0.25 * float(norms.min()))


def search(space: Space, places: np.ndarray, block: np.ndarray, last: int, least_cosine: float) -> list[tuple[int, int, float]]:
    """(number of the item, first word of the passage, cosine) of those of a text's ``last`` passages close to an item, in pieces of bounded size."""
    found: list[tuple[int, int, float]] = []
    near = space.near(places, block, last)
    if near is None:
        return found
    for start in range(0, last, 4096):
        stop = min(start + 4096, last)
        a, b = np.searchsorted(block, [start, stop + 1])
        weights = space.weight[places[a:b]]
        at = block[a:b] - start
        # A passage is compared if its weight could come from a part of an item, and if part of an answer is near.
        heavy = np.bincount(at, weights * weights, stop - start + 1)
        close = np.flatnonzero((heavy[:-1] + heavy[1:] >= space.least_norm**2) & near[start:stop])
        if not len(close):
            continue
        use = np.zeros(stop - start + 1, bool)
        use[close] = use[close + 1] = True
        own = use[at]
        rows, inverse = np.unique(at[own], return_inverse=True)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(inverse)) + 1])  # words come in order of their blocks
        sums = np.add.reduceat(space.directions[places[a:b][own]] * weights[own][:, None].astype(np.float32), edges, axis=0)
        full = np.zeros((stop - start + 1, sums.shape[1]), np.float32)
        full[rows] = sums
        latent = full[close] + full[close + 1]
        cosine = latent @ space.latent_items.T / np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        i, j = np.nonzero(cosine >= least_cosine)
        found.extend(zip(j.tolist(), ((close[i] + start) * BLOCK).tolist(), cosine[i, j].tolist()))
    return found


def confirmed(space: Space, words: list[str], candidates: list[tuple[int, int, float]], least_common: float) -> dict[int, tuple[float, float, int]]:
    """Per item number: the best share in common, with its cosine and the passage's first word."""
    best: dict[int, tuple[float, float, int]] = {}
    for number, first, cosine in candidates:
        item = space.items[number]
        around = len(item.words)
        share = item.share(words[max(0, first - around) : first + 2 * BLOCK + around]) if around else 0.0
        if share >= least_common and (share, cosine, -first) > best.get(number, (0.0, 0.0, 0)):
            best[number] = share, cosine, -first
    return {n: (share, cosine, -first) for n, (share, cosine, first) in best.items()}


def hits(used: DataFrame, space: Space, schema: str, least_cosine: float, least_common: float) -> DataFrame:
    """What is confirmed in each text, of ``schema``; a text is read if the search of its words in use finds a candidate."""
    spark_schema = used.sparkSession.createDataFrame([], schema).schema

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(spark_schema)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in arrow.names}
            own = {name: batch.column(name) for name in batch.schema.names}
            ends = np.concatenate([[0], np.cumsum(_lengths(own["places"]))])
            places, blocks = (own[name].flatten().to_numpy() for name in ("places", "blocks"))
            for i, last in enumerate(own["passages"].to_pylist()):
                at = slice(ends[i], ends[i + 1])
                if not last or not (close := search(space, places[at], blocks[at], last, least_cosine)):
                    continue
                best = confirmed(space, words_of(own["text"][i].as_py()), close, least_common)
                for number, (share, cosine, first) in sorted(best.items()):
                    for name, value in zip(arrow.names, (own["doc"][i].as_py(), space.items[number].key, cosine, share, first)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        release()

    small_batches(used.sparkSession)
    return used.mapInArrow(task, schema)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text",
    rank: int = 224, least_cosine: float = 0.4, least_common: float = 0.6, block_items: int = 1_000,
) -> DataFrame:
    """One row per document and item it holds: both ids, ``cosine``, ``common`` (share of the item) and ``first_word`` of the passage."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    schema = f"doc {kind}, item {item_kind}, cosine double, common double, first_word long"
    stage, frames = Stage(spark, "decontaminate"), []
    numbered = benchmark.select(F.col(item_column).alias("key"), text_of(item_text).alias("text")).distinct()
    numbered = stage.write(numbered.sort("key", "text").withColumn("row", F.monotonically_increasing_id()), "items")
    after = -1
    while items := numbered.filter(F.col("row") > after).orderBy("row").limit(block_items).collect():
        after = items[-1]["row"]
        known = [(r["key"], r["text"]) for r in items if words_of(r["text"])]
        if not known:
            continue
        own, place = Stage(spark, "decontaminate"), places_of(known)
        used = used_words(docs, own, place, text, id_column)
        space = learn(used, place, known, rank=rank)
        frames.append(own.write(hits(used, space, schema, least_cosine, least_common), "hits"))
        own.drop("words")
    if not frames:
        return spark.createDataFrame([], schema).withColumnsRenamed({"doc": id_column, "item": item_column})
    made = frames[0]
    for frame in frames[1:]:
        made = made.unionByName(frame)
    best = F.max(F.struct("common", "cosine", (-F.col("first_word")).alias("before"))).alias("best")
    made = made.groupBy("doc", "item").agg(best)
    return made.select(
        F.col("doc").alias(id_column), F.col("item").alias(item_column), F.round("best.cosine", 4).alias("cosine"),
        F.col("best.common").alias("common"), (-F.col("best.before")).alias("first_word"),
    )
