"""SentencePiece encoding of merge-type (BPE) models by backtracking over longest matches, and decoding.

Encoding looks for the sequence of pieces in which every two neighbours are compatible: merging
their joined text again, best score first and leftmost among equals, gives just these two pieces.
From each position the longest piece is tried first (all matches of a text come from one
Aho-Corasick pass), then shorter ones; a bit per position remembers the places from which no
sequence led on, so each is tried once.

A text is cut first where no piece of the model can reach across: between two characters that
stand next to each other in no piece, and around characters that are no piece themselves. Merges
never cross such a cut, so the parts are encoded apart, whole texts stay exact, and frequent parts
are remembered in a bounded table. Characters that are no piece become their UTF-8 bytes.

Defined cases: a null text is the empty text and has the end id only; control pieces in a text are
plain text; very long parts without a cut are encoded in memory linear in the part; rows that
repeat are encoded like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import per_row, text_of

SPACE = "▁"
#: Parts remembered per task, and the longest part worth remembering.
REMEMBERED, REMEMBERED_LENGTH = 100_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """The pieces of a model file; ``encode`` and ``decode`` are exact for the models that ``check`` lets pass."""

    def __init__(self, data: bytes):
        import ahocorasick

        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, 1)))
            elif field in (2, 3):
                (trainer if field == 2 else normalizer).update(_fields(value))
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.check(trainer, normalizer)
        self.rank = {p: (-score, i) for i, (p, score, kind) in enumerate(self.pieces) if kind == 1}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i, (_, _, kind) in enumerate(self.pieces) if kind == 3}
        self.unknown = next(i for i, (_, _, kind) in enumerate(self.pieces) if kind == 2)
        self.end = next(i for i, (p, _, kind) in enumerate(self.pieces) if kind == 3 and p == trainer.get(47, b"</s>").decode())
        self.chars = {p for p in self.rank if len(p) == 1}
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        #: Pieces that merging their own text gives; others never come out of encoding.
        self.words = ahocorasick.Automaton()  # of a piece: how far before its last character it starts, and its id
        self.halves: dict[str, tuple[str, str]] = {}  # the two pieces that the last merge of a piece joins
        for p in self.rank:
            if self.merged(p) == [p]:
                self.words.add_word(p, (1 - len(p), self.rank[p][1]))
        self.lengths = [len(p) for p, _, _ in self.pieces]
        #: The longest piece that each piece begins with, itself left out; -1 for none.
        self.shorter = [-1] * len(self.pieces)
        for p in self.words:
            before = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.words), None)
            self.shorter[self.rank[p][1]] = self.rank[before][1] if before else -1
        self.words.make_automaton()
        #: By id: the order of merging, the first and the second piece of the last merge (-1 for none); by two ids: the order of their merge.
        self.order = [-score for _, score, _ in self.pieces]
        self.head, self.tail = [-1] * len(self.pieces), [-1] * len(self.pieces)
        for p, (a, b) in self.halves.items():
            if p in self.rank:
                self.head[self.rank[p][1]], self.tail[self.rank[p][1]] = self.rank[a][1], self.rank[b][1]
        self.joint: dict[int, float] = {}
        for p, (order, _) in self.rank.items():
            for n in range(1, len(p)):
                if (a := self.rank.get(p[:n])) and (b := self.rank.get(p[n:])):
                    self.joint[a[1] * len(self.pieces) + b[1]] = order
        self.compatible: dict[int, bool] = {}  # first id times the number of pieces plus second id
        self.memory: dict[str, str] = {}  # word, without the space before it: the ids of both in decimal
        self.older: dict[str, str] = {}
        self.altered: dict[str, str] = {}  # words that do not decode to themselves
        self.marks: dict[str, str] = {}  # last characters apart, with their ids in decimal; one entry a character

    @staticmethod
    def check(trainer: dict, normalizer: dict) -> None:
        if trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("only BPE models with byte fallback are encoded")
        if normalizer.get(1) not in (b"identity",) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models without normalisation, with escaped and kept white space are encoded")

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the neighbours of best score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = min(((self.rank[a + b][0], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                break
            if len(parts) == 2:
                self.halves.setdefault(text, (parts[0], parts[1]))
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces again gives just the two.

        The merges that made them are undone from the latest to the earliest. Between two undone
        merges, the pieces at the border must not form a piece that would have come first: one of
        a better score, or of the same score if the undone merge lay to the right.
        """
        order, joint, count, known = self.order, self.joint.get, len(self.pieces), False
        a, b, limit, tie = left, right, (1 << 62), True
        while True:
            first = joint(a * count + b)
            if first is not None and (first < limit or tie and first == limit):
                break
            end, start = self.tail[a], self.head[b]
            if end < 0 and start < 0:
                known = True
                break
            if start < 0 or end >= 0 and order[a] > order[b]:
                limit, tie, a = order[a], False, end
            else:
                limit, tie, b = order[b], True, start
        if len(self.compatible) >= 4 * REMEMBERED:
            self.compatible.clear()
        self.compatible[left * len(self.pieces) + right] = known
        return known

    def backtracked(self, part: str) -> list[int]:
        """The ids of a part all of whose characters are pieces."""
        size = len(part)
        longest = [-1] * size
        for last, (back, piece) in self.words.iter(part):
            longest[last + back] = piece  # of one start, longer pieces end later
        lengths, compatible, shorter, count = self.lengths, self.compatible.get, self.shorter, len(self.pieces)
        taken, at, failed, piece, before = [], 0, None, longest[0], -1
        while at < size:
            while piece >= 0:
                to = at + lengths[piece]
                if failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    fits = before < 0 or compatible(before * count + piece)
                    if fits is None:
                        fits = self.fit(before, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                taken.append(piece)
                before, at = piece, to
                if at < size:
                    piece = longest[at]
            else:
                if not taken:
                    raise ValueError(f"no compatible sequence of pieces for {part[:50]!r}")
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= lengths[last]
                before, piece = taken[-1] if taken else -1, shorter[last]
        return taken

    def cut(self, text: str) -> list[str]:
        """The parts across whose borders no piece reaches."""
        starts = [0, *(i for i, pair in enumerate(zip(text, text[1:]), 1) if pair[0] + pair[1] not in self.joined), len(text)]
        return [text[a:b] for a, b in zip(starts, starts[1:]) if a < b]

    def ids_of_word(self, word: str) -> list[int]:
        if len(word) <= REMEMBERED_LENGTH and self.chars.issuperset(word):
            return self.backtracked(word)
        ids: list[int] = []
        for part in self.cut(word):
            if len(part) == 1 and part not in self.chars:
                ids.extend(self.byte[b] for b in part.encode())
            else:
                ids.extend(self.backtracked(part))
        return ids

    def escaped(self, text: str) -> str:
        return (SPACE if self.dummy_prefix and text else "") + text.replace(" ", SPACE)

    def words_between(self, text: str) -> list[str]:
        """The escaped text before each run of spaces and at its ends, where no piece but a run of spaces crosses."""
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", self.escaped(text)) if self.splits else [self.escaped(text)]

    @property
    def splits(self) -> bool:
        """Whether no piece has a space after another character."""
        if not hasattr(self, "_splits"):
            self._splits = not any(pair[1] == SPACE and pair[0] != SPACE for pair in self.joined)
        return self._splits

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words_between(text) for i in self.ids_of_word(word)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids give nothing, bytes join to characters, the first space is the prefix."""
        out, pending, first = [], bytearray(), self.dummy_prefix
        for i in [*ids, None]:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(decoded_bytes(bytes(pending)))
                pending.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i is not None and i not in self.control:
                piece = self.pieces[i][0].replace(SPACE, " ")
                if first and not any(out):
                    first, piece = piece[:1] != " ", piece.removeprefix(" ")
                out.append(piece)
        return "".join(out)

    def remembered(self, word: str) -> str:
        """The ids in decimal of a word with a space before it; ``altered`` learns what it decodes to if that is another text.

        A last character that no piece joins with the one before it is looked up apart, so a word and the same word
        with a mark behind it are encoded once. The bytes of a character never fall into two words, so decoded words can be joined. Of the
        words seen last, ``REMEMBERED`` to twice as many are kept.
        """
        known = self.memory.get(word) or self.older.get(word)
        if known is None and 2 < len(word) <= REMEMBERED_LENGTH and word[-2:] not in self.joined:
            head, mark = self.remembered(word[:-1]), word[-1]
            if mark not in self.marks:
                self.marks[mark] = " ".join(map(str, self.ids_of_word(mark)))
            if word[:-1] in self.altered:
                self.altered[word] = self.altered[word[:-1]] + mark
            return f"{head} {self.marks[mark]}"
        if known is None:
            ids = self.ids_of_word(SPACE + word)
            known = " ".join(map(str, ids))
            if min(ids) in self.byte_of:
                lead = [self.rank[SPACE][1]] if self.dummy_prefix else []  # else the word's own space is taken as the prefix
                decoded = self.decode(lead + ids)
            else:
                decoded = "".join([self.pieces[i][0] for i in ids]).replace(SPACE, " ")
            if decoded != " " + word:
                self.altered[word] = decoded[1:]
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
                self.altered = {w: t for w, t in self.altered.items() if w in self.older}
            self.memory[word] = known
        return known

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, SHA-256 of the ids in decimal, SHA-256 of the decoded text."""
        if not text or not self.splits or not self.dummy_prefix or text[0] == " " or "  " in text or SPACE in text:
            # Runs of spaces belong to the word behind them; words with a single space are looked up as below.
            single = lambda w: w[0] == SPACE and w[1:2] != SPACE
            parts = [self.remembered(w[1:]) if single(w) else " ".join(map(str, self.ids_of_word(w))) for w in self.words_between(text)]
            line = " ".join([*parts, str(self.end)])
            return digests(line, self.decode(list(map(int, line.split(" ")))))
        # Every word has one space before it, the first one the prefix.
        words, altered = text.split(" "), {}
        ids = list(map(self.memory.get, words))
        if None in ids:
            for i, known in enumerate(ids):
                if known is None:
                    ids[i] = self.remembered(words[i])
                    if words[i] in self.altered:
                        altered[words[i]] = self.altered[words[i]]
        if self.altered:
            altered |= {w: self.altered[w] for w in self.altered.keys() & set(words)}
        ids.append(str(self.end))
        return digests(" ".join(ids), " ".join([altered.get(w, w) for w in words]) if altered else text)


def digests(line: str, decoded: str) -> tuple[int, str, str]:
    return line.count(" ") + 1, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def decoded_bytes(data: bytes) -> str:
    """UTF-8, with one replacement character for each byte that is part of no character."""
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def loaded(data: bytes) -> Model:
    """The model of these bytes, made once per Python worker, which then keeps what it remembers."""
    held = sys.__dict__.setdefault("_shortlist_piece_models", {})
    key = hashlib.sha256(data).digest()
    if key not in held:
        held.clear()
        held[key] = Model(data)
    return held[key]


def encode_documents(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, ``ids`` (with the end id) and ``decoded``, the text that these ids give."""
    data = open(model_path, "rb").read()

    def setup():
        model = loaded(data)

        def rows(batch):
            ids = [model.encode(t) for t in batch["text"]]
            return {"key": batch["key"], "ids": ids, "decoded": [model.decode(i) for i in ids]}

        return rows

    return _mapped(docs, id_column, text, "ids array<int>, decoded string", setup)


def digest_documents(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_tokens, and the digests of its ids in decimal and of the text they decode to."""
    data = open(model_path, "rb").read()

    def setup():
        model = loaded(data)

        def rows(batch):
            made = [model.digest(t) for t in batch["text"]]
            counts, ids, decoded = zip(*made) if made else ((), (), ())
            return {"key": batch["key"], "n_tokens": counts, "ids_sha256": ids, "decoded_sha256": decoded}

        return rows

    return _mapped(docs, id_column, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", setup)


def _mapped(docs: DataFrame, id_column: str, text: str, made: str, setup) -> DataFrame:
    key_type = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("key"), text_of(text).alias("text"))
    return per_row(frame, f"key {key_type}, {made}", setup=setup).withColumnRenamed("key", id_column)
