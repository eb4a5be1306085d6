"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. The transducer reads the symbols of one pre-token and keeps, per place, the last token
of the encoding of the symbols so far. Of the tokens that end at a place exactly one joins the
encoding of what precedes it without a merge across the joint, so each place costs a few look-ups.
A token is emitted once it lies ``lookahead`` symbols back: two texts with the same first n symbols
have the same tokens in the first n - lookahead of them. That number is computed from the merge
list: a boundary between agreeing and differing symbols moves back by the left part of a merge,
and only if the symbol right of it begins with what the merge before took; the longest such
chain, in order of rank, bounds the way back. What is kept is one block and the lookahead, however
long the pre-token.

Decoding. A state machine takes the bytes of one id after the other and gives the text that is
complete; bytes of an unfinished character wait for the next id, and those that cannot become one
give U+FFFD.

The vocabulary file decides on normalisation, pre-tokens, special tokens and decoding. Pre-tokens
of Latin texts are found by pattern, others chunk by chunk between white space. Their ids are
memoised per worker process up to a fixed number and length.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens
written in a text are their ids, as the library takes them; repeated rows are encoded each; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import codecs
import json
import re
from functools import lru_cache
from math import inf
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import map_slices, worker_state
from .packing import VOCABULARY, Tokens

# Symbols taken in between two emissions, and the pre-tokens and chunks whose ids are kept.
BLOCK = 4096
CACHE_UNITS = 500_000
CACHE_LENGTH = 100
# Joints of two tokens and heads that are kept.
CACHE_JOINS = 200_000
CACHE_HEADS = 100_000
# Lengths of the heads of pre-tokens whose tokens are kept too, as many words begin alike.
HEADS = (7, 4)
# Ids of one batch of decoded texts.
BATCH_IDS = 1 << 20

# A symbol that ends a word is one character here: its own, moved to a private plane.
_WORD_END = 0xF0000


@lru_cache(1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, the other bytes in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(moved)) for b in range(256)]


class Merges:
    """A merge list as tables over tokens written with one character per symbol."""

    def __init__(self, vocab: dict[str, int], merges: list, word_end: str):
        self.rank: dict[tuple[str, str], int] = {}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
        made = {a + b for a, b in merges}
        key = {}
        for t in vocab:
            if t not in made:
                ends = word_end and t.endswith(word_end) and len(t) > len(word_end)
                key[t] = chr(ord(t[: -len(word_end)]) + _WORD_END) if ends else t
        for r, (a, b) in enumerate(merges):
            key[a + b] = key[a] + key[b]
            self.rank[key[a], key[b]] = r
        # Per token and side, the symbols at its end as it is merged, and the rank at which each of
        # them becomes the next.
        single = [t for t in key.values() if len(t) == 1]
        self.spines = [{t: ((t,), (inf,)) for t in single} for _ in range(2)]
        # A token whose own symbols merge otherwise never arises.
        arises = set(single)
        for (x, y), r in self.rank.items():
            for side, part in enumerate((x, y)):
                line, until = self.spines[side][part]
                self.spines[side][x + y] = ((*line, x + y), (*until[:-1], r, inf))
            if x in arises and y in arises and self._first_across(x, y) == (r, True):
                arises.add(x + y)
        self.ids = {key[t]: i for t, i in vocab.items() if key[t] in arises}
        # What some token ends with, and the lengths of the tokens among its own ends, longest first.
        tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.tails = {t: tuple(n for n in range(len(t), 0, -1) if t[-n:] in self.ids) for t in tails}
        self.longest_token = max(map(len, self.ids))
        self.lookahead = self._lookahead()
        self.joins: dict[tuple[str, str], bool] = {}
        self.heads: dict[str, tuple[str, ...]] = {}

    def _first_across(self, left: str, right: str) -> tuple[int, bool] | None:
        """Rank of the first merge across the joint of two tokens, and whether both are whole by
        then. Of equal pairs in a row the left one is merged first."""
        a, a_until = self.spines[1][left]
        b, b_until = self.spines[0][right]
        i = j = 0
        while True:
            r = self.rank.get((a[i], b[j]), inf)
            if r < a_until[i] and r <= b_until[j] and r != inf:
                return int(r), a_until[i] == inf and b_until[j] == inf
            if a_until[i] == b_until[j] == inf:
                return None
            if a_until[i] <= b_until[j]:
                i += 1
            else:
                j += 1

    def join(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are beside each other."""
        if len(self.joins) >= CACHE_JOINS:
            self.joins.clear()
        known = self.joins[left, right] = self._first_across(left, right) is None
        return known

    def _lookahead(self) -> int:
        back: dict[str, int] = {}
        most = 1
        for a, b in self.rank:  # in order of rank
            way = len(a) + max(back.get(t, 0) for t in self.spines[0][b][0])
            back[a] = max(back.get(a, 0), way)
            most = max(most, way)
        return most


class Transducer:
    """Symbols of one pre-token in, ids out as soon as they are certain."""

    def __init__(self, merges: Merges, block: int = BLOCK):
        self.merges, self.block = merges, block
        self.symbols = ""
        self.last: list[str] = [""]

    def feed(self, symbols: str) -> list[int]:
        out = []
        for i in range(0, len(symbols), self.block):
            self._read(symbols[i : i + self.block])
            if (sure := len(self.symbols) - self.merges.lookahead) > 0:
                out += self._emit(sure)
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.symbols))
        self.symbols, self.last = "", [""]
        return out

    def _read(self, more: str) -> None:
        tails, joins, heads, last = self.merges.tails, self.merges.joins, self.merges.heads, self.last
        text = self.symbols = self.symbols + more
        start, size = len(last) - 1, len(text)
        new = not start
        if new:
            for n in HEADS:
                if n < size and (known := heads.get(text[:n])) is not None:
                    last += known
                    start = n
                    break
        for end in range(start + 1, size + 1):
            at = end - 1
            while at and text[at - 1 : end] in tails:
                at -= 1
            for n in tails[text[at:end]]:
                at = end - n
                token = text[at:end]
                if not at:
                    break
                stays = joins.get((last[at], token))
                if stays is None:
                    stays = self.merges.join(last[at], token)
                if stays:
                    break
            else:
                raise ValueError(f"no token for {text[end - 1]!r}")
            last.append(token)
            if new and end in HEADS and end < size:
                if len(heads) >= CACHE_HEADS:
                    heads.clear()
                heads[text[:end]] = tuple(last[1:])

    def _emit(self, sure: int) -> list[int]:
        """The ids of the tokens that end at ``sure`` symbols or before; the rest stays."""
        ids, last, at, out, cut = self.merges.ids, self.last, len(self.symbols), [], 0
        while at > sure:
            at -= len(last[at])
        cut = at
        while at:
            token = last[at]
            out.append(ids[token])
            at -= len(token)
        out.reverse()
        self.symbols, self.last = self.symbols[cut:], ["", *last[cut + 1 :]]
        return out


class Encoder:
    """Texts to ids (little-endian 32-bit) by the vocabulary file's own rules."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model = rules["model"]
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pre_tokens = library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.ends_words = bool(model["end_of_word_suffix"])
        self.machine = Transducer(self.merges)
        self.symbols = byte_symbols()
        self.cache: dict[str | bytes, bytes] = {}

    def token_ids(self, symbols: str) -> list[int]:
        """Ids of one pre-token, written in byte symbols."""
        if not symbols:
            return []
        if self.ends_words:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + _WORD_END)
        out = self.machine.feed(symbols)
        return out + self.machine.finish() if out else self.machine.finish()

    def unit_ids(self, unit: str | bytes) -> bytes:
        """Ids of a pre-token (text) or of a chunk between white space (bytes)."""
        if isinstance(unit, str):
            plain = unit.isascii() and unit.isprintable()  # such characters stand for themselves
            out = self.token_ids(unit if plain else "".join([self.symbols[b] for b in unit.encode()]))
        else:
            out, at, text = [], 0, unit.decode()
            for found in [*self.special_pattern.finditer(text), None]:
                plain = text[at : found.start() if found else len(text)]
                if plain:
                    for token, _ in self.pre_tokens(self.normalize(plain)):
                        out += self.token_ids(token)
                if found:
                    out.append(self.special[found.group()])
                    at = found.end()
        return pack(f"<{len(out)}i", *out)

    def encode(self, text: str | None) -> np.ndarray:
        units = Tokens.units(text or "")
        found = list(map(self.cache.get, units))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self.learn(units[i])
        return np.frombuffer(b"".join(found), dtype="<i4")

    def learn(self, unit: str | bytes) -> bytes:
        ids = self.cache.get(unit)
        if ids is None:
            ids = self.unit_ids(unit)
            if len(unit) <= CACHE_LENGTH:
                if len(self.cache) >= CACHE_UNITS:
                    self.cache.clear()
                self.cache[unit] = ids
        return ids


class Decoder:
    """Ids in, text out as soon as its bytes are complete."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        names = {i: t for t, i in rules["model"]["vocab"].items()}
        names |= {t["id"]: t["content"] for t in rules["added_tokens"]}
        if rules["decoder"] is None:  # without one, the tokens' names stand between spaces
            self.between = b" "
            self.bytes = {i: t.encode() for i, t in names.items()}
        elif rules["decoder"]["type"] == "ByteLevel":
            value = {c: b for b, c in enumerate(byte_symbols())}
            self.between = b""
            self.bytes = {i: bytes(value[c] for c in t) if set(t) <= set(value) else t.encode() for i, t in names.items()}
        else:
            raise ValueError(f"decoder {rules['decoder']['type']} is not known")
        self.start()

    def start(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids) -> str:
        data = self.between.join([self.bytes[i] for i in ids if i in self.bytes])
        if data and not self.first:
            data = self.between + data
        self.first = self.first and not data
        return self.machine.decode(data)

    def finish(self) -> str:
        text = self.machine.decode(b"", True)
        self.start()
        return text

    def text(self, ids: np.ndarray) -> str:
        self.start()
        parts = [self.feed(ids[i : i + BLOCK].tolist()) for i in range(0, len(ids), BLOCK)]
        return "".join(parts) + self.finish()


def _kept(kind: type, vocabulary: str):
    """One encoder or decoder of a vocabulary per worker process."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    state = worker_state(f"bpe_{kind.__name__}")
    if vocabulary not in vars(state):
        setattr(state, vocabulary, kind(public_tokenizers.path(vocabulary)))
    return getattr(state, vocabulary)


def round_trip(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per input row: id, ids (as by ``encode_documents``), decoded (the text that the ids
    give, as by ``decode_ids``), by one worker process a task."""
    schema = StructType(
        [docs.schema[id_col], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
    )

    def make():
        encode, decode = _kept(Encoder, vocabulary).encode, _kept(Decoder, vocabulary).text

        def rows(ids, texts):
            for doc, text in zip(ids, texts, strict=True):
                found = encode(text)
                yield doc, found, decode(found)

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per input row: id, ids (of the whole text, no special tokens added)."""
    schema = StructType([docs.schema[id_col], StructField("ids", ArrayType(IntegerType()))])

    def make():
        encode = _kept(Encoder, vocabulary).encode
        return lambda ids, texts: [(d, encode(t)) for d, t in zip(ids, texts, strict=True)]

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)


def decode_ids(rows: DataFrame, ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``rows`` and decoded, the text of its ids (null ids: no ids)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])
    arrow = to_arrow_schema(schema)
    at = rows.columns.index(ids_col)

    def run(batches):
        import pyarrow as pa

        decoder = _kept(Decoder, vocabulary)
        for batch in batches:
            column = batch.column(at)
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False)
            texts, first = [], 0
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                texts.append(decoder.text(values[a:b]))
                if b - int(offsets[first]) >= BATCH_IDS or i + 1 == batch.num_rows:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], schema=arrow)
                    texts, first = [], i + 1

    return rows.mapInArrow(run, schema)
