"""Every operator on small tables: against brute force, round trips, and the cases its docstring defines."""

from __future__ import annotations

import hashlib
import pathlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from brute_llm import brute_components, brute_removed
from shortlist.llm import collocations, components, decontaminate, exact, language, licenses, neardup, neural, pieces, quality, spelling, substrings, toxicity, warc
from shortlist.llm.common import Stage, is_held_out

ODD = "id long, text string, lang string, key string, n long, low long, label int, row long"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_docs(spark):
    """Nulls, empty, blank and repeated rows, ties, and columns whose names the operators use themselves."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (4, "one two"), (5, "ONE two"), (None, "one two three four five six seven"), (6, "x" * 20000)]
    frame = docs_of(spark, rows)
    for name in ("id", "key", "n", "low", "label", "row", "component", "class", "digest", "body", "hash", "print"):
        frame = frame.withColumn(name, F.lit(7))
    return frame


# ---- repeated strings


def test_interval_expansion_marks_repeats():
    draw = random.Random(1)
    for trial in range(120):
        length = draw.choice([1, 2, 4, 9])
        bodies = [bytes(draw.choice(b"ab" if trial % 2 else b"abcd\x00\xff") for _ in range(draw.randint(0, 50))) for _ in range(draw.randint(1, 6))]
        seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
        want = [[i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1] for b in bodies]
        assert [x.tolist() for x in substrings.repeated_starts(bodies, length)] == want


@pytest.mark.parametrize("most", [2000, 1])
def test_repeated_strings_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_CONTEXTS", most)
    draw = random.Random(2)
    passage = "".join(draw.choice("abcdefgh é") for _ in range(400))
    texts = [None, "", "short", passage, passage, "a" * 700, "ab" * 300, passage[:90] + "?" + passage[91:]]
    texts += ["".join(draw.choice("abcdefgh ") for _ in range(150)) + passage[draw.randint(0, 200) :] for _ in range(8)]
    frame = docs_of(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame, length=120).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, 120)


def test_repeated_strings_defined_cases(spark):
    frame = docs_of(spark, [(1, "z" * 50), (2, "q" * 39), (None, "w" * 10 + "".join(map(chr, range(97, 123))) * 2)])
    frame = frame.union(frame.filter("doc_id = 2")).withColumn("anchor", F.lit(1)).withColumn("n", F.lit("x"))
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans, r.kept, r.spans) for r in substrings.remove_repeats(frame, length=39, with_text=True).collect()}
    assert got[1, 50][:2] == (50, 1) and got[2, 39] == (39, 1, b"", [[0, 39]]) and got[None, 62][:2] == (0, 0)
    assert substrings.remove_repeats(frame.limit(0), length=39).count() == 0


# ---- licences


def brute_licence(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for t in licenses.TEMPLATES:
        first, length = t.key
        for start in range(-len(t.words), len(words)):
            if start + first >= 0 and tuple(words[start + first : start + first + length]) == t.words[first : first + length]:
                share = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)) / len(t.words)
                if share >= 0.6:
                    found.append((t, start + first, share))
    base = [at for t, at, _ in found if t.base]
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({t.label for t, _, _ in found if t.base})),
        ",".join(sorted({t.label for t, _, _ in found})), max((s for _, _, s in found), default=0.0),
    )


def test_licences_against_brute_force(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    extra = [(-1, None), (-2, ""), (-3, "cc by CC-BY cc, by all RIGHTS reserved"), (-4, "general public license general public license"), (-5, "by"), (-5, "by")]
    draw = random.Random(6)
    for number, t in enumerate(licenses.TEXTS):  # whole, with words changed, without a key word, cut short, in other text
        words = list(t.words)
        other = [draw.choice(["alpha", "the", w]) if draw.random() < 0.3 else w for w in words]
        first, length = t.key
        other[first : first + length] = words[first : first + length]
        broken = words[:first] + words[first + 1 :]
        for i, some in enumerate((words, other, broken, words[: first + length], ["x", *words[first:], *words])):
            extra.append((-100 - 10 * number - i, ", ".join(some).upper() if i % 2 else " ".join(some)))
    frame = table.union(docs_of(spark, extra))
    rows = {r.doc_id: r.text for r in frame.collect()}
    got = licenses.scan(frame.withColumn("words", F.lit(1)).withColumn("key", F.lit(1))).collect()
    assert len(got) == frame.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute_licence(rows[r.doc_id])
    whole = {r.doc_id: r for r in got}
    assert all(t.label in whole[-100 - 10 * n].labels.split(",") and whole[-100 - 10 * n].score == 1 for n, t in enumerate(licenses.TEXTS))
    assert licenses.scan(frame.limit(0)).count() == 0


# ---- exact duplicates


def test_exact_names_against_grouping(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("aB") for _ in range(draw.choice([0, 3, 7, 8, 9, 16, 17, 40]))) for _ in range(300)] + [None, "É" * 9, "é" * 9]
    frame = docs_of(spark, [(i if i % 50 else None, t) for i, t in enumerate(texts)])
    norm = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append(i if i % 50 else None)
    rows = exact.deduplicate(frame, block_bytes=4).collect()
    assert len(rows) == len(texts)
    by_text = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in rows:
        ids = by_text[r.text_sha256]
        largest = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (largest, len(ids))
    kept = Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == Counter(dict.fromkeys(by_text, 1))


def test_blocks_that_share_a_hash_get_names_of_their_own(spark):
    rows = [(1, 0, 5, b"aa"), (2, 0, 5, b"bb"), (3, 0, 5, b"aa"), (4, 0, 6, b"cc")]
    frame = spark.createDataFrame(rows, "row long, at int, hash long, block binary")
    names = {r.row: r.name for r in exact.named_blocks(frame, Stage(spark, "clash")).collect()}
    assert names[1] == names[3] and len({names[1], names[2], names[4]}) == 3


def test_exact_defined_cases(spark):
    got = exact.deduplicate(odd_docs(spark)).collect()
    assert len(got) == 8 and sum(r.kept for r in got) == 5
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id in (4, 5)} == {(4, 5, 3), (5, 5, 3)}
    twice = exact.deduplicate(docs_of(spark, [(1, "a"), (1, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted(r.kept for r in twice) == [False, False, True, True]
    assert exact.deduplicate(odd_docs(spark).limit(0)).count() == 0


# ---- near duplicates


def test_near_duplicates_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    draw = random.Random(5)
    words = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    for i in range(60):  # a chain, in which neighbours are near and ends are not
        words[i * 2 % 120] = f"v{i}"
        rows.append((100000 + i, " ".join(words)))
    frame = docs_of(spark, rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame, shingle_words=4).collect()}
    assert got == brute_components(rows, 4)


def test_groups_of_edited_copies_in_blocks(spark):
    """Copies of one text with words changed: many are alike, only some are links."""
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = [(i, " ".join(draw.choice([w, w + "x"]) if draw.random() < i % 12 / 200 else w for w in base)) for i in range(1, 121)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), shingle_words=4, rounds=1, block=16).collect()}
    want = brute_components(rows, 4, 80)
    assert got == want and 1 < len({c for _, c in want.values()}) < len(rows)


def test_bitmaps_differ_in_no_more_bits_than_sets_in_shingles():
    draw = random.Random(6)
    for bits in (64, 256, 1024):
        for _ in range(50):
            one, two = ({draw.getrandbits(64) for _ in range(draw.randint(2, 300))} for _ in range(2))
            two |= set(draw.sample(sorted(one), len(one) // 2))
            a, b = (neardup.bitmap(np.array(sorted(s), np.uint64), bits) for s in (one, two))
            assert len(a) == bits // 64 and np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(one ^ two)


def test_near_duplicates_defined_cases(spark):
    got = neardup.near_duplicates(odd_docs(spark), shingle_words=4).collect()
    found = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in got)
    assert found == [(0, 4, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True)]
    assert neardup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_near_duplicates_keep_their_result_only(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("neardup-*/*/_SUCCESS"))
    found = neardup.near_duplicates(odd_docs(spark), shingle_words=4)
    # Signatures, bitmaps, postings and links have gone before anyone reads the result.
    assert [p.parent.name for p in set(shared.glob("neardup-*/*/_SUCCESS")) - before] == ["found"]
    assert found.count() == odd_docs(spark).count()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Stage(spark, "graph"), "g").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


# ---- pieces


@pytest.fixture(scope="module")
def piece_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_against_the_library(spark, small, piece_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    model = pieces.Model(open(piece_path, "rb").read())
    draw = random.Random(6)
    texts = ["", " ", "   a  b ", "a" * 300, " " * 99, "<s> </s> <0x41> ▁▁", "中文 😀\U0001f600\x00", "\r\n\t é"]
    texts += ["".join(draw.choice("  ab etin▁\n\té中😀<>s0xTH.!-_=*") for _ in range(draw.randint(0, 40))) for _ in range(800)]
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts += ["".join(draw.choice(names) for _ in range(draw.randint(1, 6))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids
        assert model.decode(ids) == library.decode(ids)
        line = " ".join(map(str, ids))
        assert model.digest(text) == (len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    for _ in range(1000):
        ids = [draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(259) for _ in range(draw.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_pieces_defined_cases(spark, piece_path):
    got = pieces.encode_documents(odd_docs(spark), piece_path).collect()
    assert len(got) == 8 and {tuple(r.ids) for r in got if r.doc_id in (1, 2)} == {(2,)} and {r.decoded for r in got if r.doc_id == 4} == {"one two"}
    assert pieces.digest_documents(odd_docs(spark).limit(0), piece_path).count() == 0


# ---- decontamination


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    draw = random.Random(7)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(1, 20))] for _ in range(2))
        item = decontaminate.Item.of(1, " ".join(a), {})
        assert decontaminate.common_subsequence(item.bits, b, len(a)) == brute_common(a, b)


def test_passages_of_the_benchmark_are_found_and_clean_documents_are_not(spark, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    table = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in table.collect()}
    clean = [t for t in texts.values() if len(t) > 2000][:6]
    draw, planted, rows = random.Random(8), set(), []
    for n, (item, text) in enumerate(items.items()):
        words = text.split()
        for _ in range(max(1, len(words) // 10)):  # a paraphrase: some words exchanged
            words[draw.randrange(len(words))] = f"changed{n}"
        rows.append((500000 + n, f"{clean[n % len(clean)][:900]} {' '.join(words)} {clean[n % len(clean)][900:1700]}"))
        planted.add((500000 + n, item))
    frame = table.union(docs_of(spark, rows))
    texts |= dict(rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, benchmark, block_items=15).collect()}
    frequency = Counter(w for t in texts.values() for w in set(decontaminate.words_of(t)))
    want = set()
    for item, text in items.items():
        own = decontaminate.Item.of(item, text, frequency)
        rarest = own.answer
        for doc, body in texts.items():
            words = decontaminate.words_of(body)
            if not rarest.intersection(words):
                continue
            n = len(own.words)
            if any(own.share(words[a : a + 2 * n]) >= 0.8 for a in range(0, max(1, len(words)), max(1, n // 4))):
                want.add((doc, item))
    assert len(got & want) >= 0.9 * len(want) and planted & want <= got
    for doc, item in got:
        own = decontaminate.Item.of(item, items[item], frequency)
        assert brute_common(own.words, decontaminate.words_of(texts[doc])) >= 0.6 * len(own.words)


def test_the_space_is_fitted_on_every_passage(spark):
    draw = random.Random(9)
    used_in = [f"w{i}" for i in range(12)]
    texts = ["", None, "w1", "no such", *(" ".join(draw.choice([*used_in, "x", "y"]) for _ in range(draw.randint(1, 400))) for _ in range(30))]
    texts += texts[-3:] + ["x " * 40 + "w3 w4 " + "y " * 70]
    place, weight = {w: i for i, w in enumerate(used_in)}, np.array([draw.random() + 0.1 for _ in used_in])
    rows, held = [], Counter()
    for body in texts:
        words = (body or "").split()
        held.update(set(words).intersection(place))
        for a in range(0, max(1, len(words) - 16), 16) if words else []:
            counted = Counter(words[a : a + 32])
            value = np.array([counted[w] * weight[place[w]] for w in used_in])
            rows.append(value / max(np.linalg.norm(value), 1e-12))
    frame = docs_of(spark, list(enumerate(texts))).repartition(3)
    used = decontaminate.used_words(frame, Stage(spark, "test"), place, "text")
    assert used.agg(F.sum("passages")).first()[0] == len(rows)
    found, count = decontaminate.document_frequencies(used, len(place))
    assert count == len(texts) and dict(zip(used_in, found.tolist())) == {w: held[w] for w in used_in}
    factor = np.random.default_rng(1).normal(size=(len(place), 5))
    want = np.array(rows).T @ (np.array(rows) @ factor)
    for step in (3, 1024):
        assert np.allclose(decontaminate.gram_product(used, weight, factor, step), want, rtol=1e-4, atol=1e-3)


def test_the_products_of_all_pairs_of_words_cover_every_passage(spark, monkeypatch):
    draw = random.Random(19)
    used_in = [f"w{i:03d}" for i in range(300)]
    texts = ["", "no such", *(" ".join(draw.choice([*used_in, "x"]) for _ in range(draw.randint(1, 300))) for _ in range(25))]
    place, weight = {w: i for i, w in enumerate(used_in)}, np.array([draw.random() + 0.1 for _ in used_in])
    rows = []
    for words in map(str.split, texts):
        for a in range(0, max(1, len(words) - 16), 16):
            value = np.array([Counter(words[a : a + 32])[w] * weight[place[w]] for w in used_in])
            rows.append(value / max(np.linalg.norm(value), 1e-12))
    used = decontaminate.used_words(docs_of(spark, list(enumerate(texts))).repartition(3), Stage(spark, "test"), place, "text")
    want = np.triu(np.array(rows).T @ np.array(rows))
    for step in (3, 1024):
        assert np.allclose(decontaminate.gram_matrix(used, weight, step), want, rtol=1e-4, atol=1e-5)
    items = np.eye(300)[:7]
    once = decontaminate.directions(used, weight, items, 20)
    monkeypatch.setattr(decontaminate, "WIDEST", 0)
    twice = decontaminate.directions(used, weight, items, 20)
    assert np.allclose(once @ once.T, twice @ twice.T, atol=1e-2)


def test_products_of_word_pairs_are_held_as_a_triangle():
    draw = np.random.default_rng(4)
    size, blocks = 90, 400
    edges = decontaminate._edges(size)
    assert edges[-1] == size * (size + 1) // 2
    places, row = draw.integers(0, size, 4000), np.sort(draw.integers(0, blocks + 1, 4000))
    weight, begins, total = draw.random(size) + 0.1, draw.random(blocks) < 0.9, np.zeros(edges[-1])
    decontaminate._part_of_matrix(places, row, begins, weight, total, edges)
    counts = np.zeros((blocks + 1, size))
    np.add.at(counts, (row, places), 1)
    passages = (counts[:-1] + counts[1:]) * weight * begins[:, None]
    passages /= np.maximum(np.linalg.norm(passages, axis=1), 1e-12)[:, None]
    assert np.allclose(total, (passages.T @ passages)[np.triu_indices(size)])


def test_a_text_without_a_candidate_is_not_taken_apart_again(spark, monkeypatch):
    benchmark = spark.createDataFrame([(1, " ".join(f"rare{i}" for i in range(20)))], "item_id long, text string")
    place = decontaminate.places_of([(1, benchmark.first()["text"])])
    frame = docs_of(spark, [(1, "plain words only"), (2, benchmark.first()["text"])])
    used = decontaminate.used_words(frame, Stage(spark, "test"), place, "text", "doc_id")
    space = decontaminate.learn(used, place, [(1, benchmark.first()["text"])], rank=4)
    # Without its text a document can't be confirmed, so only the one without candidates passes unread.
    schema = "doc long, item long, cosine double, common double, first_word long"
    assert [r.doc for r in decontaminate.hits(used, space, schema, 0.4, 0.6).collect()] == [2]
    assert decontaminate.hits(used.withColumn("text", F.lit("")), space, schema, 0.4, 0.6).count() == 0


def test_decontamination_defined_cases(spark):
    item = " ".join(f"rare{i}" for i in range(20))
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "what is it? answer42 here")], "item_id long, text string")
    frame = odd_docs(spark).select("doc_id", "text").union(docs_of(spark, [(9, f"a b {item} c"), (9, f"a b {item} c"), (10, f"{item} x {item}")]))
    got = sorted((r.doc_id, r.item_id, r.common) for r in decontaminate.contaminated(frame.withColumn("item", F.lit(1)), benchmark).collect())
    assert got == [(9, 1, 1.0), (10, 1, 1.0)]
    assert decontaminate.contaminated(frame, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(frame.limit(0), benchmark).count() == 0


# ---- classifiers


def agreement(spark, folder, frame, label, held):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = frame.join(labels, "doc_id").filter(held).collect()
    return rows, np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = is_held_out("doc_id", 5, 0)
    scored = quality.score(docs, quality.learn(docs, labels, ~held)).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
    assert scored.count() == docs.count()
    rows, right = agreement(spark, folder, scored, "quality", held)
    assert right >= 0.95
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.97


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = is_held_out("doc_id", 5, 0)
    scored = toxicity.score(docs, toxicity.learn(docs, labels, ~held)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    rows, right = agreement(spark, folder, scored, "toxic", held)
    assert right >= 0.97 and np.mean([r.predicted for r in rows if r.toxic == 1]) >= 0.8


def test_pairs_weigh_more_than_their_terms():
    draw = np.random.default_rng(1)
    held = [sorted(set(np.flatnonzero(draw.random(4) < 0.5).tolist())) for _ in range(3000)]
    y = np.array([float({0, 1} <= set(h)) for h in held])  # only both together
    bias, linear, latent = toxicity.fit(held, y, 4, factors=2, epochs=30, seed=2)
    model = toxicity.Model({}, bias, linear, latent)
    assert model.logit([0, 1]) > 0 > max(model.logit([0]), model.logit([1]), model.logit([2, 3]), model.logit([]))


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = is_held_out("doc_id", 4, 2)
    found = language.identify(docs, language.learn(docs, ~held)).join(docs.select("doc_id", "lang"), "doc_id").filter(held).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) >= 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_classifiers_defined_cases(spark):
    frame = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") == 4, "en"))
    labels = spark.createDataFrame([Row(doc_id=4, quality=1, toxic=0), Row(doc_id=4, quality=1, toxic=0), Row(doc_id=5, quality=None, toxic=None)], "doc_id long, quality int, toxic int")
    good = quality.score(frame, quality.learn(frame, labels, F.lit(True))).collect()
    assert len(good) == 8 and {r.score for r in good} == {0.5}
    bad = toxicity.score(frame, toxicity.learn(frame, labels, F.lit(True))).collect()
    assert len(bad) == 8 and all(r.score < 0.02 for r in bad)
    told = language.identify(frame, language.learn(frame, F.lit(True))).collect()
    assert {(r.doc_id, r.lang_pred) for r in told if r.doc_id in (1, 2, 3, 4)} == {(1, "und"), (2, "und"), (3, "und"), (4, "en")}
    nothing = language.learn(frame, F.lit(False))
    assert {r.lang_pred for r in language.identify(frame, nothing).collect()} == {"und"}
    empty = frame.limit(0)
    assert quality.score(empty, quality.learn(empty, labels, F.lit(True))).count() == 0
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0), F.lit(True))).count() == 0


def test_long_texts_are_read_whole(spark):
    text = "the of and in " * 100_000
    assert language.ngram_counts(text).sum() == pytest.approx(sum(len(text) - n + 1 for n in (2, 3)) + sum(c != " " for c in text), abs=0)


# ---- archive


def test_archive_round_trip(spark, tmp_path):
    long = "<html>" + "x" * 200 + "\r\n\r\n" + "é" * 10
    rows = [(3, "http://a", long), (1, "http://b", long), (2, None, long), (4, "http://c\r\nX: y", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("header", F.lit("h"))
    warc.write_archive(pages, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() == 3
    back = warc.parsed(warc.read_archive(spark, str(tmp_path / "archive")))
    got = {r.record_id: r for r in back.collect()}
    assert len(got) == 8
    for page, _, html in rows:
        r, body = got[page], (html or "").encode()
        assert bytes(r.payload) == body and r.payload_digest == r.declared_digest == hashlib.sha256(body).hexdigest() and r.payload_bytes == len(body)
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {
        1: ("response", None), 2: ("revisit", "1"), 3: ("revisit", "1"), None: ("revisit", "1"),
        4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None),
    }
    warc.export_warc(back, str(tmp_path / "files"))
    stored = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    records, at = Counter(), 0
    while at < len(stored):  # a reader of its own: header block, then as many bytes as it declares
        head, at = stored[at : stored.index(b"\r\n\r\n", at)], stored.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        records[head.split(b"\r\n")[0], re.search(rb"WARC-Type: (\w+)", head)[1], hashlib.sha256(stored[at : at + size]).hexdigest()] += 1
        assert stored[at + size : at + size + 4] == b"\r\n\r\n"
        at += size + 4
    assert sum(records.values()) == 8 and sum(n for (_, kind, _), n in records.items() if kind == b"revisit") == 3
    single = {bytes(r[0]) for r in back.select(warc.record_bytes()).collect()}
    assert sum(len(x) for x in single) <= len(stored) and all(x in stored for x in single)
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


# ---- phrase collocations


def brute_collocations(rows, least, cover, top):
    """Per language: phrase, a, l, r, n, score in order, from plain counts of everything."""
    counts: dict = {}
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            for size in (1, 2, 3):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, own in counts.items():
        n, found = sum(c for p, c in own.items() if len(p) == 1), []
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * c >= cover * a for q, c in own.items() if len(q) == 3 and c >= least and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out[lang] = [(p.decode(), -a, x, y, n, -s) for s, a, p, x, y in sorted(found)[:top]]
    return {lang: rows for lang, rows in out.items() if rows}


def collocation_docs(draw):
    words = ["new", "york", "City", "of", "the", "é", "$", "x-y", "a'b"]
    texts = [(None, None), ("en", ""), ("en", " ... \t!"), (None, "New York city, new YORK City")]
    for _ in range(60):
        lang = draw.choice(["en", "en", "fr", None])
        texts.append((lang, "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x1c "]) for _ in range(draw.randint(0, 60)))))
    return texts + texts[10:30]


@pytest.mark.parametrize(("least", "cover", "top", "bits"), [(10, 50, 2000, 1 << 16), (3, 30, 4, 1 << 16), (3, 90, 1, 64), (2, 50, 12, 64)])
def test_collocations_against_brute_force(spark, monkeypatch, least, cover, top, bits):
    monkeypatch.setattr(collocations, "_SLICE", 64)
    rows = collocation_docs(random.Random(least))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").withColumn("phrase", F.lit(1)).withColumn("level", F.lit(2))
    got: dict = {}
    for r in collocations.collocations(frame, least=least, cover=cover, top=top, bits=bits, block=200).orderBy("lang", "rank").collect():
        own = got.setdefault(r.lang, [])
        own.append((r.phrase, r.a, r.l, r.r, r.n, r.score))
        assert r["rank"] == len(own)
    assert got == brute_collocations(rows, least, cover, top)


def test_collocations_defined_cases(spark):
    assert collocations.collocations(docs_of(spark, [], "lang string, text string")).count() == 0
    assert collocations.collocations(docs_of(spark, [("en", "one two")], "lang string, text string")).count() == 0
    big = 10**14
    row = spark.createDataFrame([(big, big, big + 1)], "a long, l long, r long").select(collocations._score("a", "l", "r", 10**6)).first()
    assert row[0] == 10**6 * big * big // (big * (big + 1))


# ---- spelling variants


def brute_variants(rows):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if mark % 97 else run[: mark % len(run)] + run[mark % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    by_size: dict = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w, n in words.items():
        others = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, ()) if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    roots = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        roots[w] = root
    return {w: (form, roots[w], n, count, form_n) for w, (form, n, count, form_n) in out.items()}


def test_variants_against_brute_force(spark, small):
    draw = random.Random(3)
    rows = [(None, None), (1, ""), (2, "aaaaa aaaaaa aaaaaaa AAAAAA aaaaab " * 3), (None, "colour color colour COLOUR color colour colours " * 4), (2, "Éclair éclair éclaix÷ " * 5)]
    rows += [(i, " ".join("".join(draw.choice("abÉé÷") for _ in range(draw.choice([4, 5, 5, 6]))) for _ in range(400))) for i in range(40)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += rows[5:9]
    frame = docs_of(spark, rows).withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).withColumn("id", F.lit("x"))
    found = spelling.variants(frame).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert len(got) == len(found) and got == brute_variants(rows)
    assert any(form != root and form for form, root, *_ in got.values())


def test_variants_defined_cases(spark):
    assert spelling.variants(docs_of(spark, [])).count() == 0
    assert spelling.variants(docs_of(spark, [(1, "abcd"), (2, "x" * 100000)])).count() == 0
    links = docs_of(spark, [(i, i + 1) for i in range(9)], "id long, root long")
    assert {r.root for r in spelling.last_forms(links, Stage(spark, "chain")).collect()} == {9}


@pytest.mark.parametrize("size", [62, 63, 64, 65, 66, 3000])
def test_variants_of_long_words(spark, size):
    draw = random.Random(size)
    word = "".join(draw.choice("abc") for _ in range(size))
    texts = [word] * 9 + [word[:40] + "z" + word[41:]] * 3 + [word[:20] + word[21:]] * 4 + [word + "c"] * 3 + [word[:-1]] * 3
    rows = [(1, t) for t in texts]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs_of(spark, rows)).collect()}
    assert got == brute_variants(rows)


# ---- neural language model


def lm_tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def lm_plain(rows, learnable, model):
    """n_tokens, n_known, base and score of every text: counts by a dictionary, probabilities by a softmax per place."""
    counts = Counter(w for i, t in rows if learnable(i) for w in lm_tokens(t))
    total, distinct, p, short = sum(counts.values()), len(counts), model.parameters, model.numbers.short
    key = {w: neural.END if w is None else neural.tokens_of(w)[0] for _, t in rows for w in lm_tokens(t)}
    number = {w: model.tokens.index(key[w]) for w in key if key[w] in model.tokens[:short]}
    inside = sum(counts[w] for w in number)
    out = []
    for _, text in rows:
        one = two = short + 1
        tokens, base, score = lm_tokens(text), 0.0, 0.0
        for w in tokens:
            q = p.before[one].astype(float) @ p.first + p.before[two].astype(float) @ p.second
            logits = q @ p.word.astype(float).T + p.bias
            place = number.get(w, short)
            score += (logits[place] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / np.log(10)
            if place == short:
                score += np.log10((counts[w] + 1) / (total - inside + distinct - len(number) + 1))
            base += np.log10((counts[w] + 1) / (total + distinct + 1))
            one, two = place, one
        out.append((len(tokens), sum(counts[w] > 0 for w in tokens), total, base, score))
    return out


def test_neural_scores_against_a_plain_softmax(spark):
    draw = random.Random(8)
    words = ["a", "B", "cé", "d\x1c", "e" * 70, "E" * 70, "f" * 71, "g"]
    rows = [(i, " ".join(draw.choice(words[: 3 + i % 6]) for _ in range(draw.randint(0, 40)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one"), (102, "one"), (None, "never seen a\tb"), (103, "z" * 200000)]
    frame = docs_of(spark, rows).repartition(3)
    for name in ("token", "c", "row", "key", "rare", "base", "round"):
        frame = frame.withColumn(name, F.lit(7))
    stage, ids = Stage(spark, "lm"), F.coalesce("doc_id", F.lit(-1))
    for dictionary, shortlist in ((50, 4), (4, 3), (3, 50), (0, 9)):
        model, counts = neural.learn(frame, ids % 3 != 0, Stage(spark, "lm"), dictionary=dictionary, shortlist=shortlist, width=5, batch=16, noise=4)
        got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in neural.score(frame, model, counts, Stage(spark, "lm")).collect())
        plain = lm_plain(rows, lambda i: (-1 if i is None else i) % 3 != 0, model)
        want = sorted((str(i), *x) for (i, _), x in zip(rows, plain))
        for a, b in zip(got, want, strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-4)
    sums = np.exp(model.parameters.log_probabilities().of(*(x.ravel() for x in np.meshgrid(*[np.arange(n) for n in (model.numbers.size, model.numbers.size + 1, model.numbers.size + 1)], indexing="ij"))))
    assert np.allclose(sums.reshape(model.numbers.size, -1).sum(axis=0), 1)
    empty, counts = neural.learn(frame.limit(0), F.lit(True), stage)
    assert neural.score(frame.limit(0), empty, counts, Stage(spark, "lm")).count() == 0
    assert all(r.base_score == r.score == 0 and r.n_known == 0 for r in neural.score(frame, empty, counts, Stage(spark, "lm")).collect())


def test_noise_contrastive_slopes():
    draw = np.random.default_rng(2)
    shares = np.array([0.4, 0.3, 0.2, 0.1])
    model = neural.Parameters(*(a.astype(np.float64) for a in neural.Parameters.start(shares, 3, 1).arrays()))
    places = (draw.integers(0, 4, 9), draw.integers(0, 5, 9), draw.integers(0, 5, 9), np.array([0, 0, 1, 3, 2]), np.log(shares))
    for array, slope in zip(model.arrays(), neural.slopes(model, *places)):
        for at in np.ndindex(array.shape):
            old, values = array[at], []
            for step in (1e-5, -1e-5):
                array[at] = old + step
                values.append(neural.objective(model, *places))
            array[at] = old
            assert slope[at] == pytest.approx((values[0] - values[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_neural_model_beats_frequencies_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4)
    held, stage = is_held_out("doc_id", 7, 2), Stage(spark, "lm")
    model, counts = neural.learn(docs, ~held, stage)
    sums = neural.score(docs, model, counts, stage).filter(held).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (sums[0] - sums[1]) / sums[2] > 0.05


# ---- classifiers, computed again plainly


def test_bradley_terry_weights_are_the_optimum(spark):
    """At the optimum of the penalised logistic loss its slope is 0; Newton's method finds the same weights."""
    draw = np.random.default_rng(3)
    better, worse = draw.normal(0.3, 1, (200, 4)), draw.normal(0, 1, (200, 4))
    found = quality.bradley_terry(better, worse, penalty=0.05, steps=4000)
    d, w = better - worse, np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        slope = -d.T @ p / len(d) + 0.05 * w
        w = w - np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 0.05 * np.eye(4), slope)
    assert np.allclose(found, w, atol=1e-3)


def test_quality_scores_follow_from_the_strengths(spark):
    model = quality.Model(np.zeros(len(quality.features(""))), np.ones(len(quality.features(""))), np.linspace(-1, 1, len(quality.features(""))), 0.2)
    texts = [(1, "One two three."), (2, ""), (3, None), (4, "!!! @@ ### AAA aaa " * 50)]
    for r in quality.score(docs_of(spark, texts), model, cut=0.3).collect():
        x = quality.features(dict(texts)[r.doc_id] or "")
        strength = sum(min(8, max(-8, v)) * w for v, w in zip(x, model.weights))
        odds = np.exp(strength - 0.2) * 0.3 / 0.7
        assert r.score == pytest.approx(odds / (1 + odds)) and (r.score >= 0.3) == (strength >= 0.2)


def test_language_votes_of_all_pairs():
    draw = np.random.default_rng(5)
    names, pairs = ("a", "b", "c", "d"), tuple((i, j) for i in range(4) for j in range(i + 1, 4))
    votes = language.Votes(names, pairs, draw.normal(size=(6, 9)).astype(np.float32))
    for _ in range(200):
        x = draw.normal(size=8).astype(np.float32)
        won, sums, margin = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}
        for (i, j), w in zip(pairs, votes.weights):
            m = float(w[:-1] @ x + w[-1])
            margin[names[i], names[j]], margin[names[j], names[i]] = m, -m
            won[names[i] if m >= 0 else names[j]] += 1
            sums[names[i]] += m
            sums[names[j]] -= m
        best = max(names, key=lambda n: (won[n], sums[n]))
        closest = min(margin[best, other] for other in names if other != best)
        name, sure = votes.predict(x)
        assert name == best and sure == pytest.approx(1 / (1 + np.exp(-4 * closest)), rel=1e-4)


def test_toxicity_is_a_sum_over_all_pairs():
    draw = np.random.default_rng(7)
    model = toxicity.Model({}, 0.4, draw.normal(size=9), draw.normal(size=(9, 3)))
    for held in ([], [4], [0, 3], [1, 2, 5, 8], list(range(9))):
        pairs = sum(float(model.latent[i] @ model.latent[j]) for n, i in enumerate(held) for j in held[n + 1 :])
        assert model.logit(held) == pytest.approx(0.4 + sum(model.linear[i] for i in held) + pairs)
