"""License scan with a positional index of rare words.

Templates are licence notices and whole licence texts. Each has a mandatory key phrase, given by the positions of its
words in the template. The index has postings (template, position) for every word of a key phrase, ordered within a
template by inverse document frequency, counted over all documents. A file's licence words are looked up from
the rarest on. The first word of a template's order gives the places where the template would start, every further word
intersects them with its own by relative position, and a template one of whose key words the file lacks falls out.
What is left at the end holds the whole key phrase. At these places the file's positions of all words of the template are compared: the share of
words that stand where the template has them is the score of the place, and places count from ``least_share``. So a
whole licence text may differ in names and clauses outside its key phrase.

As every word of a key phrase must stand there, no place is lost by looking the rarest up first.

Defined cases: a null or empty text has no words, nulls in first_word and last_word, empty label
strings and score 0; equal templates at one place count once per label; of equal scores any is the file's score, as it is
the number alone; words of equal frequency are looked up in byte order; texts of any length are read whole; rows that repeat are
scanned like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import ASCII_LOWER, per_row, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, (text or "").translate(ASCII_LOWER))


@dataclass(frozen=True)
class Template:
    """``key``: first position and number of the words that must all match."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False

    @staticmethod
    def of(label: str, text: str, key: str, base: bool = False) -> Template:
        words, phrase = tuple(words_of(text)), tuple(words_of(key))
        starts = [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
        if not phrase or not starts:
            raise ValueError(f"the key phrase {key!r} is not in the template of {label}")
        return Template(label, words, (starts[0], len(phrase)), base)


#: Phrases whose places are all counted.
BASE = (
    Template.of("cc-by", "cc by", "cc by", True),
    Template.of("gpl", "general public license", "general public license", True),
    Template.of("reserved", "all rights reserved", "all rights reserved", True),
)
#: Notices as their licences word them.
NOTICES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template.of("mit", "released under the mit license", "the mit license"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification", "use in source and binary forms"),
    Template.of("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute this software"),
    Template.of("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template.of("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template.of("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template.of("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template.of("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template.of("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template.of("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template.of("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template.of("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template.of("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Licences and licence headers in full. Fixed texts.
TEXTS = (
    Template.of("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "to deal in the software without restriction"),
    Template.of("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
        OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "for any purpose with or without fee is hereby granted"),
    Template.of("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
        BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        "redistributions of source code must retain the above copyright notice"),
    Template.of("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
        use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution.""", "alter it and redistribute it freely"),
    Template.of("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""", "released into the public domain anyone is free to copy"),
    Template.of("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""", "you may not use this file except in compliance with the license"),
    Template.of("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "either version 3 of the license or at your option any later version"),
    Template.of("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""", "if a copy of the mpl was not distributed with this file"),
)
TEMPLATES = BASE + NOTICES + TEXTS


def document_frequencies(docs: DataFrame, vocabulary: frozenset[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of ``vocabulary`` stands. The result has at most one entry per word."""

    def count(rows):
        found: Counter = Counter()
        for body in rows["text"]:
            found.update(vocabulary.intersection(words_of(body)))
        return {"word": list(found), "docs": list(found.values())}

    parts = per_row(docs.select(text_of(text).alias("text")), "word string, docs long", count)
    return {r["word"]: r["docs"] for r in parts.groupBy("word").agg(F.sum("docs").alias("docs")).collect()}


@dataclass(frozen=True)
class Index:
    """Per key word its postings: number of the template, position, and the word's place in the template's order of lookups.

    ``rarity`` orders all key words, the rarest first.
    """

    templates: tuple[Template, ...]
    postings: dict[str, list[tuple[int, int, int]]]
    rarity: dict[str, int]

    @staticmethod
    def of(templates: tuple[Template, ...], frequency: dict[str, int]) -> Index:
        keys = {w for t in templates for w in t.words[t.key[0] : sum(t.key)]}
        rarity = {w: i for i, w in enumerate(sorted(keys, key=lambda w: (frequency.get(w, 0), w)))}
        postings: dict[str, list[tuple[int, int, int]]] = {}
        for number, t in enumerate(templates):
            order = sorted(range(t.key[0], sum(t.key)), key=lambda i: (rarity[t.words[i]], i))
            for turn, at in enumerate(order):
                postings.setdefault(t.words[at], []).append((number, at, turn))
        return Index(templates, postings, rarity)


def places(words: list[str], index: Index, least_share: float) -> list[tuple[int, int, float]]:
    """(number of the template, start of its key phrase, share of its words in place) for each place that holds it."""
    held = sorted(index.rarity.keys() & set(words), key=index.rarity.__getitem__)
    alive: dict[int, tuple[set[int], int]] = {}  # starts that all words so far agree on, and how many words these are
    where: dict[str, list[int]] = {}
    for word in held:
        for number, position, turn in index.postings[word]:
            starts, agreed = alive.get(number, (set(), 0))
            if turn != agreed:
                continue  # a rarer word of the key phrase is missing
            if not where:
                for at, w in enumerate(words):
                    if w in index.rarity:
                        where.setdefault(w, []).append(at)
            own = {at - position for at in where[word]}
            own = own & starts if turn else own
            if own:
                alive[number] = own, agreed + 1
            else:
                alive.pop(number, None)
    found = []
    for number, (starts, agreed) in alive.items():
        t = index.templates[number]
        for start in starts if agreed == t.key[1] else ():
            inside = range(max(0, -start), min(len(t.words), len(words) - start))
            share = sum(words[start + i] == t.words[i] for i in inside) / len(t.words)
            if share >= least_share:
                found.append((number, start + t.key[0], share))
    return found


def scan(
    docs: DataFrame, *, id_column: str = "doc_id", text: str = "text",
    templates: tuple[Template, ...] = TEMPLATES, least_share: float = 0.6,
) -> DataFrame:
    """One row per document: its number of words, the places of base phrases, all labels and the best share."""
    keys = frozenset(w for t in templates for w in t.words[t.key[0] : sum(t.key)])
    index = Index.of(templates, document_frequencies(docs, keys, text))

    def look(rows):
        out: dict[str, list] = {k: [] for k in ("key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for key, body in zip(rows["key"], rows["text"]):
            words = words_of(body)
            found = places(words, index, least_share)
            base = [(n, at) for n, at, _ in found if templates[n].base]
            out["key"].append(key)
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min((at for _, at in base), default=None))
            out["last_word"].append(max((at for _, at in base), default=None))
            out["base_labels"].append(",".join(sorted({templates[n].label for n, _ in base})))
            out["labels"].append(",".join(sorted({templates[n].label for n, _, _ in found})))
            out["score"].append(max((share for _, _, share in found), default=0.0))
        return out

    key_type = docs.schema[id_column].dataType.simpleString()
    schema = f"key {key_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return per_row(docs.select(F.col(id_column).alias("key"), text_of(text).alias("text")), schema, look).withColumnRenamed("key", id_column)
