"""Sum-of-squares online packing of tokenised documents into fixed windows.

Every task packs the documents of its own partition: whole windows are cut off a long document,
the rest is placed online into the fill level h that minimises the sum of N(h)^2, N being the
number of open windows at each level (a level array of one integer per fill level). Windows still
open when the task's documents end are joined and cut into whole windows and powers of two, so
that nothing is padded. No shuffle; a task keeps the level array, one open list per level and one
slice of documents.

Tokens: ``tokenizers`` ids of the vocabulary file, no special tokens added, plus one end id.
White space separates pre-tokens of that vocabulary, so ids are looked up per unit of text (a
pre-token of a Latin text, a white-space-delimited chunk of another); units not seen before are
encoded, and a worker process keeps a bounded number of them.

Defined results: a null or empty text is a document of the end id alone; repeated rows are packed
each; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_slices, worker_state

WINDOW = 2048
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
# Words and chunks whose ids a worker process keeps between tasks; beyond that it starts anew.
CACHE_UNITS = 400_000
# Sequence ids: the task's number above these bits, the task's own count below.
TASK_SHIFT = 36

# Texts of ASCII and of letters whose lower case and composition do not depend on their neighbours
# fall into the vocabulary's pre-tokens by a plain pattern, the simplest ones by splitting.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_NOT_PLAIN = re.compile(f"[^{_LETTERS} \n\t\r.,]")
_NOT_LATIN = re.compile(f"[^{_LETTERS}\n\t\r -~]|<\\|")
_MARKS_MEET = ("..", ".,", ",.", ",,")
_PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[0-9]|[^\\s0-9{_LETTERS}]+")


class Tokens:
    """Documents to ids (little-endian unsigned 32-bit bytes), by units of text whose ids do not
    depend on their neighbours: pre-tokens of Latin texts, white-space chunks of others."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache: dict[str | bytes, bytes] = {}

    @staticmethod
    def units(text: str) -> list[str] | list[bytes]:
        if _NOT_PLAIN.search(text) or any(m in text for m in _MARKS_MEET):
            if _NOT_LATIN.search(text):
                return text.encode("utf-8", "replace").split()
            return _PRE_TOKEN.findall(text.lower())
        return text.lower().replace(".", " . ").replace(",", " , ").split()

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def learn(self, units: set[str | bytes]) -> None:
        """Ids of new units; pre-tokens are encoded together, as each ends with an end token."""
        words = [u for u in units if isinstance(u, str)]
        for i in range(0, len(words), 1000):
            part = words[i : i + 1000]
            ids = np.frombuffer(self._ids([" ".join(part)])[0], dtype="<u4")
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) != len(part) + 1:  # not one end per word: take them singly
                self.cache.update(zip(part, self._ids(part), strict=True))
            else:
                data = ids.tobytes()
                self.cache.update((w, data[4 * a : 4 * b]) for w, (a, b) in zip(part, pairwise(cuts), strict=True))
        chunks = [u for u in units if isinstance(u, bytes)]
        for i in range(0, len(chunks), 1000):
            part = chunks[i : i + 1000]
            self.cache.update(zip(part, self._ids([c.decode() for c in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        parts = [self.units(t or "") for t in texts]
        found = [list(map(self.cache.get, p)) for p in parts]
        gaps = [[j for j, ids in enumerate(f) if ids is None] if None in f else () for f in found]
        self.learn({p[j] for p, at in zip(parts, gaps, strict=True) for j in at})
        for p, f, at in zip(parts, found, gaps, strict=True):
            for j in at:
                f[j] = self.cache[p[j]]
        return list(map(b"".join, found))


class Packer:
    """Online sum-of-squares packing; pieces are (owner, start, length, payload) tuples."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}

    def place(self, piece: tuple) -> list | None:
        """Put a piece shorter than the window into the best level; the window's pieces if full."""
        size, w, n = piece[2], self.window, self.levels
        # Change of the sum of squares when level h gives a window to level h + size; the level
        # of full windows and that of empty ones are not counted.
        from_ = n[1 : w - size + 1]
        to = n[size + 1 : w + 1]
        change = 2 * (to - from_) + 2
        if len(change):
            change[-1] = 1 - 2 * from_[-1]
            change = np.where(from_ > 0, change, np.iinfo(np.int64).max)
            best = int(change.argmin())
        if not len(change) or change[best] > 2 * n[size] + 1:
            self.levels[size] += 1
            self.open.setdefault(size, []).append([piece])
            return None
        level = best + 1
        pieces = self.open[level].pop()
        self.levels[level] -= 1
        pieces.append(piece)
        if level + size == w:
            return pieces
        self.levels[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        return None

    def close(self) -> list[list]:
        """The windows still open, fullest first, joined and cut anew: into whole windows and, for
        the rest, into the powers of two it is made of, which need no padding either."""
        left = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open.clear()
        self.levels[:] = 0
        whole, rest = divmod(sum(p[2] for p in left), self.window)
        sizes = [self.window] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        out, room = [], 0
        for owner, start, length, payload in left:
            while length:
                if not room:
                    room = sizes[len(out)]
                    out.append([])
                n = min(length, room)
                out[-1].append((owner, start, n, payload[: 4 * n]))
                start, length, payload, room = start + n, length - n, payload[4 * n :], room - n
        return out


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str = VOCABULARY
) -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length, ids_crc32 (of the
    ids as little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id,
    offset (place in the sequence, gapless from 0)."""
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = StructType([docs.schema[id_col]] + [StructField(c, LongType()) for c in names])
    end = int(END_ID).to_bytes(4, "little")

    def make():
        import os

        import public_tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = worker_state("tokens")
        if vocabulary not in vars(state):
            setattr(state, vocabulary, Tokens(public_tokenizers.path(vocabulary)))
        encode = getattr(state, vocabulary).encode
        packer = Packer(window)
        base = TaskContext.get().partitionId() << TASK_SHIFT
        made = iter(range(base, base + (1 << TASK_SHIFT)))

        def emit(pieces):
            sequence, offset = next(made), 0
            for (doc, tokens), start, length, payload in pieces:
                yield doc, start, length, zlib.crc32(payload), tokens, sequence, offset
                offset += length

        def rows(ids=None, texts=None):
            if ids is None:
                for pieces in packer.close():
                    yield from emit(pieces)
                return
            for doc, data in zip(ids, encode(texts), strict=True):
                data += end
                tokens = len(data) // 4
                owner, at = (doc, tokens), 0
                while tokens - at >= window:
                    yield from emit([(owner, at, window, data[4 * at : 4 * (at + window)])])
                    at += window
                if at < tokens and (full := packer.place((owner, at, tokens - at, data[4 * at :]))):
                    yield from emit(full)

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make, finish=True)
