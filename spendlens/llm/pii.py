"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then a transducer rewrites disguises and
keeps, for every character it writes, the source span it came from: homoglyphs and compatibility
forms to ASCII, invisible characters to nothing, spelled digits to digits, at/dot disguises to
``@`` and ``.``. The same detectors run on the rewritten text and their spans are mapped back to
the source; those that are not base spans are added. Texts without any disguise skip the second
pass. Everything is row-local.

Defined results: a null or empty text has no spans; repeated rows get equal rows; empty tables
give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_slices

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind and the possessive digits change no match and keep long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _emails(text: str):
    """Leftmost non-overlapping matches of the address pattern, found from each ``@``: the local
    part is the whole run of its characters before the sign, so no run is scanned twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def find_spans(text: str) -> list[tuple[int, str, int]]:
    """Base identifiers as (start, kind, end), leftmost and non-overlapping within a kind."""
    out = [(a, "email", b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


# Letters of other scripts that look like an ASCII letter.
HOMOGLYPHS = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονιρ" + "‐‑‒–−․。",
        "ABEKMHOPCTXaeopcyxijshdqw" + "ABEZHIKMNOPTYXaovip" + "-----..",
        strict=True,
    )
)
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits, and the sign before a spelled phone number.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
# Endings of a domain whose dots stand as such between blanks. A dot that is spelled needs none of
# them: any two to six letters end such a domain.
ENDINGS = "com org net edu gov mil int info biz io co dev app ai example test uk de fr es nl eu us ca au ch jp ru".split()
_ENDING = "[A-Za-z]{2,6}"
# Words before a noun, which begin no domain ("look at the dot there").
_NO_DOMAIN = r"(?!(?:the|a|an|this|that|each|every|my|your|his|her|its|our|their)\s)"

_FOREIGN = re.compile("[^\x00-\u017f]|[\u00ad\u00b2\u00b3\u00b9]")
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(
    rf"(?i)(?<![^\W_])(?:(plus)[\s-]+)?((?:{_WORD}|[0-9])(?:(?:[\s-]|\s?(?:\bdot\b|\bpoint\b|\.)\s?)(?:{_WORD}|[0-9]+)){{5,}})(?![^\W_])"
)
# Four or more numbers joined by dot words: parts of any length, unlike those above.
_PART = rf"(?:[0-9]++|(?:{_WORD})(?:[\s-](?:{_WORD}))*)"
_DOTTED = re.compile(
    rf"(?i)(?<![^\W_])(?:(plus)[\s-]+)?({_PART}(?:(?:\s?\b(?:dot|point)\b\s?|\.){_PART}){{3,}})(?![^\W_])"
)
_SPELLED_PART = re.compile(rf"(?i){_WORD}|dot|point|[0-9.]|[\s-]")
# Cheap to search and true wherever _BRACKETED matches.
_BRACKET = re.compile(r"(?i)[\[({<]\s?(?:at|@|dot|\.)\s?[\])}>]")
_BRACKETED = re.compile(r"(?i)\s?(?:\[\s?(at|@|dot|\.)\s?\]|\(\s?(at|@|dot|\.)\s?\)|\{\s?(at|@|dot|\.)\s?\}|<\s?(at|dot)\s?>)\s?")
_PLAIN = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:(?:\.|\sdot\s)[A-Za-z0-9_%+-]+){0,3})(\sat\s|\s@\s|@\s?)"
    rf"({_NO_DOMAIN}[A-Za-z0-9-]+(?:(?:\.|\sdot\s)[A-Za-z0-9-]+){{0,3}}\sdot\s{_ENDING})(?![A-Za-z0-9])"
)
# Behind an "@" the domain is rewritten whatever stands before it.
_SIGNED = re.compile(
    rf"(?i)@([A-Za-z0-9-]+(?:(?:\.|\sdot\s)[A-Za-z0-9-]+){{0,3}}\sdot\s{_ENDING})(?![A-Za-z0-9])"
)
# Signs between blanks: "jane @ example . com"; either the at or a dot, at least, has them. A blank
# on the left alone makes a mention of what follows, not an address.
_SPACED = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9_%+-]+(?:\s?\.\s?[A-Za-z0-9_%+-]+){0,3})(\s@\s|@\s?)"
    rf"([A-Za-z0-9-]+(?:\s?\.\s?[A-Za-z0-9-]+){{0,3}}\s?\.\s?(?:{'|'.join(ENDINGS)}))(?![A-Za-z0-9])"
)
_SPACED_SIGN = re.compile(r"\s@|@\s|@[A-Za-z0-9-]+\s?\.\s|@[A-Za-z0-9-]+\s\.")
_SPACED_DOT = re.compile(r"\s\.\s?|\.\s")
# A number behind a plus in which at least two digits in a row are spelled, the others in groups.
_MIXED = re.compile(
    rf"(?i)(?:\+|(?<![^\W_])(plus)[\s-]+)((?:{_WORD}|[0-9]+)(?:[\s-](?:{_WORD}|[0-9]+)){{3,}})(?![^\W_])"
)
_TWO_WORDS = re.compile(rf"(?i)\b(?:{_WORD})[\s-](?:{_WORD})\b")
_DOT = re.compile(r"(?i)\sdot\s")


def _fold(c: str) -> str:
    """One character's ASCII look-alike, or the character itself."""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in INVISIBLE:
        return ""
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else c


class Rewriter:
    """A text together with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text = text
        self.spans: list[tuple[int, int]] | None = None  # None: every character is its own source

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.spans is None:
            return start, end
        return self.spans[start][0], self.spans[end - 1][1]

    def rewrite(self, edits: list[tuple[int, int, list[tuple[int, int, str]]]]) -> None:
        """Replace each [start, end) by characters with their own [start, end) in this text."""
        if not edits:
            return
        old = self.spans if self.spans is not None else [(i, i + 1) for i in range(len(self.text))]
        text, spans, at = [], [], 0
        for start, end, chars in edits:
            text.append(self.text[at:start])
            spans += old[at:start]
            for a, b, c in chars:
                text.append(c)
                spans.append((old[a][0], old[b - 1][1]))
            at = end
        text.append(self.text[at:])
        spans += old[at:]
        self.text, self.spans = "".join(text), spans


def _foreign_edits(text: str):
    for m in _FOREIGN.finditer(text):
        c = m.group()
        if (f := _fold(c)) != c:
            yield m.start(), m.end(), [(m.start(), m.end(), f)] if f else []


def _spelled_edits(text: str, pattern: re.Pattern = _SPELLED):
    for m in pattern.finditer(text):
        chars = [(m.start(1), m.end(1), "+")] if m.group(1) else []
        for p in _SPELLED_PART.finditer(text, m.start(2), m.end(2)):
            word = p.group().lower()
            if word in DIGIT_WORDS:
                chars.append((p.start(), p.end(), DIGIT_WORDS[word]))
            elif word in ("dot", "point", "."):
                chars.append((p.start(), p.end(), "."))
            elif word.isdigit():
                chars.append((p.start(), p.end(), word))
        yield m.start(), m.end(), chars


def _bracketed_edits(text: str):
    for m in _BRACKETED.finditer(text):
        sign = next(g for g in m.groups() if g).lower()
        yield m.start(), m.end(), [(m.start(), m.end(), "@" if sign in ("at", "@") else ".")]


def _dot_edits(text: str, start: int, end: int):
    return [(d.start(), d.end(), [(d.start(), d.end(), ".")]) for d in _DOT.finditer(text, start, end)]


def _plain_edits(text: str):
    for m in _PLAIN.finditer(text):
        yield from _dot_edits(text, m.start(1), m.end(1))
        yield m.start(2), m.end(2), [(m.start(2), m.end(2), "@")]
        yield from _dot_edits(text, m.start(3), m.end(3))


def _signed_edits(text: str):
    for m in _SIGNED.finditer(text):
        yield from _dot_edits(text, m.start(1), m.end(1))


def _spaced_edits(text: str):
    for m in _SPACED.finditer(text):
        for part in (1, 3):
            yield from (
                (d.start(), d.end(), [(d.start(), d.end(), ".")]) for d in _SPACED_DOT.finditer(text, m.start(part), m.end(part))
            )
        if m.end(2) - m.start(2) > 1:
            yield m.start(2), m.end(2), [(m.start(2), m.end(2), "@")]


def _mixed_edits(text: str):
    for m in _MIXED.finditer(text):
        if _TWO_WORDS.search(m.group(2)):
            plus = (m.start(1), m.end(1)) if m.group(1) else (m.start(), m.start() + 1)
            digits = [(p.start(), p.end(), DIGIT_WORDS.get(p.group().lower(), p.group())) for p in _SPELLED_PART.finditer(text, *m.span(2))]
            yield m.start(), m.end(), [(*plus, "+"), *(d for d in digits if d[2].isdigit())]


def normalised(text: str) -> Rewriter:
    """Apply the transducers in order; each runs only where its trigger occurs."""
    r = Rewriter(text)
    if not text.isascii() and _FOREIGN.search(text):
        r.rewrite(list(_foreign_edits(r.text)))
    low = r.text.lower()
    if any(w in low for w in ("three", "seven", "eight", "zero", "five", "nine", "four", "six", "two", "one")):
        r.rewrite(list(_spelled_edits(r.text)))
        if "+" in r.text or "plus" in low:
            r.rewrite(list(_mixed_edits(r.text)))
    if "dot" in low or "point" in low:
        r.rewrite(list(_spelled_edits(r.text, _DOTTED)))
    if _BRACKET.search(r.text):
        r.rewrite(list(_bracketed_edits(r.text)))
    if "dot" in low and ("at" in low or "@" in r.text):
        r.rewrite(list(_plain_edits(r.text)))
        if "@" in r.text:
            r.rewrite(list(_signed_edits(r.text)))
    if "@" in r.text and _SPACED_SIGN.search(r.text):
        r.rewrite(sorted(_spaced_edits(r.text)))
    return r


def text_spans(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), each sorted by start, kind, end."""
    if not text:
        return [], []
    base = find_spans(text)
    r = normalised(text)
    every = set(base)
    if r.spans is not None:
        every.update((a, kind, b) for s, kind, e in find_spans(r.text) for a, b in [r.span(s, e)])
    order = lambda s: (s[0], KINDS.index(s[1]), s[2])
    return sorted(base, key=order), sorted(every, key=order)


SPAN = StructType(
    [StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]
)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the counts and SHA-256 of the base spans, all spans as text
    (``kind:start:end``, comma-joined) and ``found`` (all spans as structs), in code points."""
    schema = StructType(
        [docs.schema[id_col]]
        + [StructField(f"n_{k}", LongType()) for k in KINDS]
        + [StructField("base_sha256", StringType()), StructField("spans", StringType())]
        + [StructField("found", ArrayType(SPAN))]
    )

    def make():
        def rows(ids, texts):
            for doc, text in zip(ids, texts, strict=True):
                base, every = text_spans(text)
                digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
                yield (
                    doc,
                    *(sum(s[1] == k for s in base) for k in KINDS),
                    digest,
                    ",".join(f"{k}:{a}:{b}" for a, k, b in every),
                    [{"kind": k, "start": a, "end": b} for a, k, b in every],
                )

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one mask."""
    if not text:
        return text
    out, at, last = [], 0, 0
    for start, kind, end in text_spans(text)[1]:
        if start >= at:
            out += [text[last:start], f"<{kind.upper()}>"]
            at = last = end
        elif end > at:
            at = last = end
    return "".join(out) + text[last:]


def mask_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data masked and, where the column exists, its length updated."""

    names = docs.columns
    at = names.index(text_col)
    length = names.index(length_col) if length_col in names else None

    def make():
        def rows(*columns):
            for row in zip(*columns, strict=True):
                row = list(row)
                new = masked(row[at])
                if length is not None and new != row[at]:
                    row[length] = len(new)
                row[at] = new
                yield tuple(row)

        return rows

    return map_slices(docs, docs.schema, make)
