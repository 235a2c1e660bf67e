"""Text helpers: tokens, clean-up, sentences and sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist import vocab
from shortlist.functions.arrays import any_of, let

#: Runs of letters, digits and underscores in any script; one-character tokens count.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

#: Sentence end before a capital, a bullet on a new line, or a numbered item on a new line.
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])|(?:\n\s*[-•*]\s*)|(?:\n\s*\d+[.)]\s+)"


def tokens(column: Column) -> Column:
    """Lower-cased word tokens, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def stripped(column: Column) -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def normalised(column: Column) -> Column:
    """Plain dashes and quotes, bullets on their own line, tidy line ends."""
    text = F.translate(F.coalesce(column, F.lit("")), "\u2013\u2014\u2019\u2018\u00a0", "--'' ")
    text = F.replace(text, F.lit("•"), F.lit("\n• "))
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[^\S\n]+(\n|\z)", "$1")
    return stripped(text)


def sentences(column: Column) -> Column:
    """Trimmed sentences longer than three characters."""
    parts = F.transform(F.split(column, SENTENCE_BREAK, -1), stripped)
    return F.filter(parts, lambda s: F.length(s) > 3)


def header_label(line: Column) -> Column:
    """The section a trimmed line announces, or null if it is not a header."""
    possible = F.length(line).between(1, 80) & ~line.rlike(r"^[\-•*]\s|^\d+\.")

    def label(lowered: Column) -> Column:
        found = F.lit(None).cast("string")
        for name in reversed(vocab.SECTION_HEADERS):
            found = F.when(lowered.rlike(any_of(vocab.SECTION_HEADERS[name])), F.lit(name)).otherwise(found)
        return F.when(F.length(lowered) < 60, found)

    return F.when(possible, let(F.trim(F.regexp_replace(F.lower(line), ":+$", "")), label))


def sections(column: Column) -> Column:
    """``map<section, text>`` of clean text; ``full_text`` alone where no section has lines.

    Each header opens a section that runs to the next header. Sections that repeat are joined.
    """
    return let(column, lambda text: let(F.split(text, "\n", -1), lambda lines: _line_sections(text, lines)))


def _line_sections(text: Column, lines: Column) -> Column:
    headers = F.filter(
        F.transform(
            lines,
            lambda line, i: F.struct(i.alias("at"), let(stripped(line), header_label).alias("label")),
        ),
        lambda h: h["label"].isNotNull(),
    )

    def bodies(marked: Column) -> Column:
        # Every header together with the position where the following one starts.
        starts = F.transform(marked, lambda h: h["at"])
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(marked), F.lit(1))), F.array(F.size(lines)))
        spans = F.filter(
            F.arrays_zip(marked.alias("head"), ends.alias("until")), lambda s: s["until"] - s["head"]["at"] > 1
        )
        return F.transform(
            spans,
            lambda s: F.struct(
                s["head"]["label"].alias("label"),
                stripped(
                    F.array_join(F.slice(lines, s["head"]["at"] + 2, s["until"] - s["head"]["at"] - 1), "\n")
                ).alias("text"),
            ),
        )

    def merged(pieces: Column) -> Column:
        labels = F.array_distinct(F.transform(pieces, lambda p: p["label"]))
        found = F.map_from_entries(
            F.transform(
                labels,
                lambda name: F.struct(
                    name,
                    F.array_join(
                        F.transform(F.filter(pieces, lambda p: p["label"] == name), lambda p: p["text"]), "\n"
                    ),
                ),
            )
        )
        return F.when(F.size(pieces) > 0, found).otherwise(F.create_map(F.lit("full_text"), text))

    return let(let(headers, bodies), merged)
