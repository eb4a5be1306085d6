"""Line dedup: normalise units, group digests globally, keep the earliest ranked occurrence.

A unit is a line (or a paragraph: runs of lines between blank lines). Normalised, its A-Z are
lower-cased and its white space is one space. Every unit that holds a word is compared, whatever
its length. Per digest the earliest (id, start) stays; all other occurrences are removed and
reported with their offsets in the source.

A passage copied into the middle of a line makes no equal line. So the sentences of a unit are
hashed as well, and where consecutive repeated sentences of a unit that stays hold
``passage_words`` words or more, that stretch goes, too. A shorter stretch stays: single short
sentences recur in clean prose.

Only digest rows move: the earliest occurrence per digest is a min that is combined map-side, so
a line that a third of all documents hold is one row per task, and the occurrences are joined
back by a sort-merge join whose hot keys AQE splits.

Defined results: null and empty texts have no units; rows equal in id and text are one document
given twice and get the same result; a null id ranks last; empty tables give empty results; only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import ASCII_LOWER, map_slices, written

PASSAGE_WORDS = 25
# A sentence ends with its last mark; what has none is the rest of the unit.
SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")


def units(text: str, paragraphs: bool = False) -> list[tuple[int, int]]:
    """[start, end) of the lines, or of the paragraphs, of a text."""
    out, at, start = [], 0, None
    for line in text.split("\n"):
        end = at + len(line)
        if not paragraphs:
            out.append((at, end))
        elif line.strip():
            start = at if start is None else start
            last = end
        elif start is not None:
            out.append((start, last))
            start = None
        at = end + 1
    if start is not None:
        out.append((start, last))
    return out


def normalise(unit: str) -> list[bytes]:
    return unit.encode("utf-8", "replace").translate(ASCII_LOWER).split()


def sentences(text: str, start: int, end: int) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the sentences with a word in a unit."""
    found = ((*m.span(), normalise(m.group())) for m in SENTENCE.finditer(text, start, end))
    return [(a, b, words) for a, b, words in found if words]


def digest_rows(docs: DataFrame, id_col: str, text_col: str, paragraphs: bool) -> DataFrame:
    """One row per unit with a word and per sentence with a word in it: id, text hash, place (twice
    the offset, plus one for a sentence), 128-bit digest. Narrow, as these rows are shuffled."""
    schema = StructType(
        [StructField("id", docs.schema[id_col].dataType), StructField("row_hash", LongType())]
        + [StructField("place", LongType()), StructField("d1", LongType()), StructField("d2", LongType())]
    )

    def digest(words: list[bytes], kind: bytes) -> tuple[int, int]:
        d = hashlib.blake2b(b" ".join(words), digest_size=16, person=kind).digest()
        return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)

    def make():
        def rows(ids, hashes, texts):
            for doc, h, text in zip(ids, hashes, texts, strict=True):
                text = text or ""
                for a, b in units(text, paragraphs):
                    if words := normalise(text[a:b]):
                        yield (doc, h, 2 * a, *digest(words, b"unit"))
                        for start, _, inner in sentences(text, a, b):
                            yield (doc, h, 2 * start + 1, *digest(inner, b"sentence"))

        return rows

    source = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(text_col).alias("__text"))
    return map_slices(source, schema, make)


def repeated_units(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraphs: bool = False
) -> DataFrame:
    """Units and sentences that occur earlier: id, row_hash, place (as in ``digest_rows``)."""
    rows = written(digest_rows(docs, id_col, text_col, paragraphs), "line-digests")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "row_hash", "place")
    first = (
        rows.groupBy("d1", "d2")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("d1", "d2", "first")
    )
    # Written, so that the join below has two plain shuffles: AQE splits hot digests only then.
    first = written(first, "line-firsts")
    return rows.join(first.hint("merge"), ["d1", "d2"]).where(place != F.col("first")).select("id", "row_hash", "place")


def removed_stretches(
    text: str, places: set[int], passage_words: int, paragraphs: bool = False
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, end) of the repeated units of a text, and of the passages in its other units."""
    gone, passages = [], []
    for a, b in units(text, paragraphs):
        if 2 * a in places:
            gone.append((a, b))
            continue
        start = end = size = 0
        for x, y, words in [*sentences(text, a, b), (b, b, [])]:
            if 2 * x + 1 in places and words:
                start, end, size = (start if size else x), y, size + len(words)
                continue
            if size >= passage_words:
                passages.append((start, end))
            size = 0
    return gone, passages


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    passage_words: int = PASSAGE_WORDS,
    paragraphs: bool = False,
) -> DataFrame:
    """One row per input row: id, n_units, n_removed (units), n_passages (removed within others),
    n_chars_removed, spans (all removed ``start:end``, comma-joined), kept_text (the removed units'
    line ends go with them)."""
    removed = (
        repeated_units(docs, id_col, text_col, paragraphs)
        .groupBy("id", "row_hash")
        .agg(F.collect_set("place").alias("again"))
    )
    source = docs.select(
        F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("__hash")
    )
    both = source.join(
        removed.hint("merge"), (F.col("__id").eqNullSafe(F.col("id"))) & (F.col("__hash") == F.col("row_hash")), "left"
    ).select("__id", "__text", "again")
    schema = StructType(
        [docs.schema[id_col]]
        + [StructField(c, LongType()) for c in ("n_units", "n_removed", "n_passages", "n_chars_removed")]
        + [StructField("spans", StringType()), StructField("kept_text", StringType())]
    )

    def make():
        def rows(ids, texts, repeated):
            for doc, text, again in zip(ids, texts, repeated, strict=True):
                text = text or ""
                gone, passages = removed_stretches(text, set(again), passage_words, paragraphs) if again else ([], [])
                cut = sorted([(a, b, 1) for a, b in gone] + [(a, b, 0) for a, b in passages])
                kept, at = [], 0
                for a, b, line_end in cut:
                    kept.append(text[at:a])
                    at = min(b + line_end, len(text))
                kept.append(text[at:])
                yield (
                    doc,
                    len(units(text, paragraphs)) if text else 0,
                    len(gone),
                    len(passages),
                    sum(b - a for a, b, _ in cut),
                    ",".join(f"{a}:{b}" for a, b, _ in cut),
                    "".join(kept),
                )

        return rows

    return map_slices(both, schema, make)
