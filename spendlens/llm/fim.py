"""Fill-in-middle transformation with content-defined chunk memoization.

A document's bytes are cut into chunks where a rolling hash of the last 32 bytes has its low bits
zero, so that equal passages of different documents give equal chunks wherever they stand. What is
needed of a chunk is summarised once: its code points and which sentinels begin in it, along with
its first and last bytes, by which the summaries of neighbours combine across a boundary in the
middle of a character or a sentinel. A content cache (the chunk's bytes are its key, so a hit is a
verified one) keeps the summaries of a worker process up to a fixed size. The sums of the chunks'
code points locate the chunk of each cut, and only that chunk is searched for the cut's byte.

Form: ``plain`` where the text is empty, holds a sentinel or is not chosen; else ``spm`` or
``psm``. The choice and the cuts come from the SHA-256 of the seed and the decimal id (nothing for
a null id), so a repeated task gives the same rows.

Defined results: a null text is an empty one, and plain; repeated rows are transformed each, to
the same output; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import accumulate
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_slices, worker_state

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
SEED = "1"
# Of 100 documents, those transformed, and of 100 transformed those with the suffix first.
RATE = 90
SUFFIX_FIRST = 20

# Chunks: a boundary where these bits of the rolling hash are zero (one byte in 512), or after the
# longest chunk. Summaries kept, and the longest chunk that is worth keeping.
CHUNK_BITS = 9
LONGEST = 4096
CACHE_CHUNKS = 100_000

# Rolling hash: a fixed pseudo-random number per byte value.
_GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)
_EDGE = max(map(len, SENTINELS)) - 1


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    if not data:
        return []
    rolled = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < 32:  # the sum over the last 32 bytes, each shifted by its distance
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint32(width))
        width *= 2
    # The low bits depend on the last few bytes alone; the high ones on all 32.
    at = np.flatnonzero(rolled >> np.uint32(32 - CHUNK_BITS) == 0) + 1
    ends, before = [], 0
    for end in [*at.tolist(), len(data)]:
        ends.extend(range(before + LONGEST, end, LONGEST))
        if end > before:
            ends.append(end)
        before = end
    return ends


def summarise(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    """Code points that begin in the chunk, whether it holds a sentinel, its first and last bytes."""
    points = len(chunk) if chunk.isascii() else int(np.count_nonzero(_starts(chunk)))
    return points, _holds_sentinel(chunk), chunk[:_EDGE], chunk[-_EDGE:]


def _starts(data: bytes) -> np.ndarray:
    """Which bytes begin a code point."""
    return (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80


def _holds_sentinel(data: bytes) -> bool:
    return any(s.encode() in data for s in SENTINELS)


class Chunks:
    """The chunks of one document: their ends and combined summaries."""

    def __init__(self, data: bytes, cache: dict):
        self.data, self.ends = data, chunk_ends(data)
        counts, edge, self.sentinel, at = [], b"", False, 0
        for end in self.ends:
            chunk = data[at:end]
            summary = cache.get(chunk)
            if summary is None:
                if len(cache) >= CACHE_CHUNKS:
                    cache.clear()
                summary = cache[chunk] = summarise(chunk)
            points, inside, head, tail = summary
            counts.append(points)
            self.sentinel = self.sentinel or inside or _holds_sentinel(edge + head)
            # A chunk shorter than a sentinel passes on bytes of its predecessor.
            edge = (edge + tail)[-_EDGE:] if len(chunk) < _EDGE else tail
            at = end
        self.before = [0, *accumulate(counts)]

    @property
    def points(self) -> int:
        return self.before[-1]

    def byte_of(self, point: int) -> int:
        """The byte at which code point number ``point`` begins (the end for the last plus one)."""
        if point >= self.points:
            return len(self.data)
        i = bisect_right(self.before, point) - 1
        at = self.ends[i - 1] if i else 0
        chunk, within = self.data[at : self.ends[i]], point - self.before[i]
        return at + (within if chunk.isascii() else int(np.flatnonzero(_starts(chunk))[within]))


def draws(doc, seed: str = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the seed and the decimal id."""
    digest = sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transform(doc, data: bytes, cache: dict, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST):
    """(code points, form, prefix and middle code points, output) of one document."""
    chunks = Chunks(data, cache)
    n = chunks.points
    h1, h2, h3, h4 = draws(doc, seed)
    if not n or chunks.sentinel or h3 % 100 >= rate:
        return n, "plain", None, None, data
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = chunks.byte_of(first), chunks.byte_of(second)
    p, m, s = (mark + part for mark, part in zip((b"<P>", b"<M>", b"<S>"), (data[:a], data[a:b], data[b:]), strict=True))
    if h4 % 100 < suffix_first:
        return n, "spm", first, second - first, s + p + m
    return n, "psm", first, second - first, p + s + m


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per input row: id, n (code points), form, prefix_chars, middle_chars (null if
    plain), output."""
    schema = StructType(
        [
            docs.schema[id_col],
            StructField("n", LongType()),
            StructField("form", StringType()),
            StructField("prefix_chars", LongType()),
            StructField("middle_chars", LongType()),
            StructField("output", StringType()),
        ]
    )

    def make():
        state = worker_state("fim")
        cache = vars(state).setdefault("chunks", {})

        def rows(ids, texts):
            for doc, text in zip(ids, texts, strict=True):
                *numbers, output = transform(doc, (text or "").encode("utf-8", "replace"), cache, seed, rate, suffix_first)
                yield (doc, *numbers, output.decode())

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)


def restore(form, output):
    """Column: the exact text from a form and its output. No sentinel overlaps another or itself
    in part, so the first place of each after the first mark is the one that was written."""
    after_mark = F.substring(output, len(PREFIX) + 1, 2_147_483_647)

    def parts(first: str, second: str):
        left = F.substring_index(after_mark, first, 1)
        rest = F.substring(after_mark, F.length(left) + len(first) + 1, F.lit(2_147_483_647))
        middle = F.substring_index(rest, second, 1)
        last = F.substring(rest, F.length(middle) + len(second) + 1, F.lit(2_147_483_647))
        return left, middle, last

    prefix, suffix, middle = parts(SUFFIX, MIDDLE)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX, MIDDLE)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
