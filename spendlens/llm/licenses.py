"""License scan: fuzzy short-notice search with pigeonhole seeds.

A notice of length L allowed k edits is split into k+1 pieces: any text within k edits of it
holds at least one piece unchanged, near its place. One Aho-Corasick pass over the normalised
text finds all pieces of all notices; around each hit the ``regex`` library's bounded-error
matching verifies the whole notice and reports its span and edits. Exact phrases are notices
with no allowed edits. Everything is row-local: no shuffle, memory bounded by one slice of rows.

Defined results: a null or empty text has no words, no labels, score 0 and null positions;
repeated rows get equal rows; an empty table gives an empty result; columns other than the id
and the text are not read, so clashing names do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import ITEM_WORDS, map_slices

# The base phrases and their labels (exact, word by word).
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Short notices as normalised words, with the edits allowed (about one in ten characters).
NOTICES = (
    ("agpl", "gnu affero general public license", 3),
    ("apache-2.0", "apache license version 2 0", 2),
    ("artistic", "artistic license 2 0", 1),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("bsd", "bsd 2 clause license", 1),
    ("bsd", "bsd 3 clause license", 1),
    ("bsl-1.0", "boost software license version 1 0", 3),
    ("cc0", "creative commons zero", 1),
    ("cc0", "to the extent possible under law", 3),
    ("cc-by", "creative commons attribution", 2),
    ("cc-by", "licensed under cc by", 1),
    ("cc-by-nc", "licensed under cc by nc", 1),
    ("cc-by-sa", "licensed under cc by sa", 1),
    ("cc-by-sa", "creative commons attribution share alike", 3),
    ("cddl", "common development and distribution license", 4),
    ("confidential", "proprietary and confidential", 2),
    ("epl", "eclipse public license", 2),
    ("eupl", "european union public licence", 2),
    ("gfdl", "gnu free documentation license", 2),
    ("gpl", "gnu general public license", 2),
    ("gpl", "either version 3 of the license or at your option any later version", 5),
    ("isc", "permission to use copy modify and or distribute this software", 5),
    ("lgpl", "gnu lesser general public license", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person", 5),
    ("mpl", "mozilla public license", 2),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 6),
    ("ms-pl", "microsoft public license", 2),
    ("odbl", "open data commons open database license", 3),
    ("ofl", "sil open font license", 2),
    ("reserved", "all rights reserved", 2),
    ("unlicense", "this is free and unencumbered software", 3),
    ("warranty", "without warranty of any kind express or implied", 4),
    ("wtfpl", "do what the fuck you want to public license", 4),
    ("zlib", "this software is provided as is without any express or implied warranty", 6),
)

# Verified windows that a task keeps.
KEPT_WINDOWS = 50_000

SPAN = StructType(
    [
        StructField("label", StringType()),
        StructField("start", IntegerType()),
        StructField("end", IntegerType()),
        StructField("edits", IntegerType()),
    ]
)

_BLANK = re.compile(" ")
_SOURCE_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """Split a phrase into edits+1 consecutive pieces of nearly equal length: (offset, piece)."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def make_scanner(phrases=PHRASES, notices=NOTICES):
    """A function text -> (n_words, base places, fuzzy spans); built once per task."""
    import ahocorasick
    import regex

    seeds: dict[str, list] = {}
    for label, phrase in phrases:
        seeds.setdefault(f" {phrase} ", []).append((None, label, 0))
    for n, (_, phrase, edits) in enumerate(notices):
        for offset, piece in pieces(phrase, edits):
            seeds.setdefault(piece, []).append((n, offset, len(piece)))
    automaton = ahocorasick.Automaton()
    for piece, found in seeds.items():
        automaton.add_word(piece, (len(piece), found))
    automaton.make_automaton()
    verify = [regex.compile(rf"(?b)\b(?:{regex.escape(p)}){{e<={k}}}\b") for _, p, k in notices]

    seen: dict[tuple[int, str], tuple | None] = {}

    def verified(n: int, window: str) -> tuple | None:
        """Of the best match in the window: its first and last character but blanks, its end and its
        edits. Windows recur, as several pieces of a notice lead to one, and are kept."""
        key = (n, window)
        if key not in seen:
            if len(seen) >= KEPT_WINDOWS:
                seen.clear()
            seen[key] = None
            if m := verify[n].search(window):
                found = m.group()
                start, end = m.end() - len(found.lstrip()), m.start() + len(found.rstrip())
                seen[key] = (start, end, m.end(), sum(m.fuzzy_counts))
        return seen[key]

    def scan(text: str | None):
        words = (text or "").encode("utf-8", "replace").translate(ITEM_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        base, spans, done = [], [], {}
        blanks: list[int] = []  # the line begins with one: the word behind the i-th is word i
        for last, (size, found) in automaton.iter(line):
            at = last - size + 1
            blanks = blanks or [m.start() for m in _BLANK.finditer(line)]
            for n, offset, _ in found:
                if n is None:
                    base.append((bisect_right(blanks, at) - 1, offset))
                    continue
                label, phrase, edits = notices[n]
                if at < done.get(n, 0):  # an earlier match of this notice covers the place
                    continue
                # From the blank before the word in which a match may begin, as the library inserts
                # nothing at the very start of its range, to the blank behind the word of its end.
                a, b = max(0, at - offset - edits - 1), line.find(" ", at - offset + len(phrase) + edits)
                a = max(line.rfind(" ", 0, a + 1), done.get(n, 0))
                a = max(0, a)
                if m := verified(n, line[a : b + 1 if b >= 0 else len(line)]):
                    start, end, until, cost = m
                    first, after = bisect_right(blanks, a + start) - 1, bisect_left(blanks, a + end) - 1
                    spans.append((label, first, after + 1, cost, len(phrase)))
                    done[n] = a + until
        return words, sorted(base), sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))

    return scan


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES
) -> DataFrame:
    """One row per input row: the id, n_words, n_base, first_word, last_word (of exact phrases),
    base_labels, labels, score (1 minus the edits per character of the best match) and
    ``spans`` (label, start, end in code points of the source text, edits) of all notices."""
    schema = StructType(
        [
            docs.schema[id_col],
            StructField("n_words", LongType()),
            StructField("n_base", LongType()),
            StructField("first_word", LongType()),
            StructField("last_word", LongType()),
            StructField("base_labels", StringType()),
            StructField("labels", StringType()),
            StructField("score", DoubleType()),
            StructField("spans", ArrayType(SPAN)),
        ]
    )

    def make():
        scan = make_scanner(phrases, notices)

        def rows(ids, texts):
            for doc, text in zip(ids, texts, strict=True):
                words, base, spans = scan(text)
                base_labels = sorted({label for _, label in base})
                labels = sorted({*base_labels, *(s[0] for s in spans)})
                out = []
                if spans:
                    at = [m.span() for m in _SOURCE_WORD.finditer(text)]
                    out = [
                        {"label": s[0], "start": at[s[1]][0], "end": at[s[2] - 1][1], "edits": s[3]} for s in spans
                    ]
                score = 1.0 if base else max((1 - s[3] / s[4] for s in spans), default=0.0)
                yield (
                    doc,
                    len(words),
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    ",".join(base_labels),
                    ",".join(labels),
                    score,
                    out,
                )

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)
