"""Periodic runs of words, by descending-LCP Kruskal over a document's suffixes.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends
and that is at least ``min_length`` words and ``min_exponent`` periods long.

Neighbours in the suffix array are united in order of decreasing longest common prefix (LCP), by a
union-find whose sets are ordered lists of positions, the smaller inserted into the larger. When
sets meet at LCP m, each position becomes adjacent to another one at some distance d; d <= m makes
a repetition of period d, and this is where runs come from: positions s and s + q of a run's start
have exactly the LCP length - q, and as that is two periods or more, no third suffix with this
prefix starts between them, so they are adjacent when they meet. Conversely an adjacent pair with
2 d <= m reaches as far right as its period goes and has no smaller period (the position one
smaller period on would have met before and lie between), so it is a run if the word before
breaks the period.

A run of the wanted length has a repeated window of ``least_lcp`` words. Windows are hashed for all
documents of a slice at once, so that documents without a repeated one, which have no run, need
no suffix array; only words covered by repeated windows are united.

Work is per document, linear in its words but for a logarithm; a slice of documents is in memory.

Defined results: a null, empty or blank text has no words and no runs; fewer words than
``min_length`` have none; repeated rows are treated each; an empty table gives an empty result;
only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import map_slices, space_words

MIN_LENGTH = 24
MIN_EXPONENT = 3
# A smaller set of at least this share of the larger is merged into it by sorting.
SORT_SHARE = 16

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The least LCP of a run's first two periods: length - period, length being at least
    ``min_length`` and ``min_exponent`` periods."""
    return min_length - min_length // min_exponent


def suffix_order(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of word numbers and the LCP of neighbours in it, by prefix doubling."""
    n = len(words)
    levels, size = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1], 1
    while True:
        rank = levels[-1]
        if size >= n or int(rank.max()) == n:
            break
        key = rank * (n + 2)
        key[: n - size] += rank[size:]
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int64) + 1)
        size *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # Ranks of equal length agree where so many words agree; past the end nothing does.
        rank = np.append(levels[level], [0, 0])
        same = (rank[np.minimum(a, n)] == rank[np.minimum(b, n)]) & (np.maximum(a, b) + (1 << level) <= n)
        a, b, lcp = a + (same << level), b + (same << level), lcp + (same << level)
    return order, lcp


def unite(order: np.ndarray, lcp: np.ndarray, least: int):
    """Yield (x, y, m): positions x < y that become adjacent in a set when sets meet at LCP m."""
    joints = np.flatnonzero(lcp >= least)
    joints = joints[np.argsort(-lcp[joints], kind="stable")]
    if not len(joints):
        return
    left, right, heights = order[joints].tolist(), order[joints + 1].tolist(), lcp[joints].tolist()
    sets: dict[int, list[int]] = {p: [p] for p in {*left, *right}}
    parent = {p: p for p in sets}

    def find(p):
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    for x, y, m in zip(left, right, heights, strict=True):
        a, b = find(x), find(y)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, little = sets[a], sets.pop(b)
        parent[b] = a
        if len(little) * SORT_SHARE < len(large):
            for p in little:
                i = bisect_left(large, p)
                if i:
                    yield large[i - 1], p, m
                if i < len(large):
                    yield p, large[i], m
                large.insert(i, p)
        else:
            members = set(little)
            large += little
            large.sort()
            for p, q in zip(large, large[1:], strict=False):
                if (p in members) != (q in members):
                    yield p, q, m


def runs_of(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple]:
    """(start, length, period) of all runs of a sequence of word numbers, by start and period."""
    n = len(words)
    if n < min_length:
        return []
    found = set()
    order, lcp = suffix_order(words, least_lcp(min_length, min_exponent))
    for x, y, m in unite(order, lcp, least_lcp(min_length, min_exponent)):
        d = y - x
        if 2 * d <= m and m + d >= max(min_length, min_exponent * d) and (not x or words[x - 1] != words[y - 1]):
            found.add((x, m + d, d))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Owners (numbers ascending along the words) in which some window of ``size`` words occurs
    twice, and perhaps a few more: windows are compared by hash."""
    if len(hashes) <= size:
        return np.empty(0, dtype=owner.dtype)
    whole, width, shift = None, 1, 0
    part = hashes
    with np.errstate(over="ignore"):
        while width <= size:  # the window as a sum of parts of 1, 2, 4, ... words
            if size & width:
                piece = part[shift:] if whole is None else part[shift : shift + len(whole)]
                whole = piece if whole is None else whole[: len(piece)] * np.uint64(0x9E3779B97F4A7C15) + piece
                shift += width
            part = part[:-width] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * width) + part[width:]
            width *= 2
        whole = whole[: len(hashes) - size + 1]
        inside = owner[: len(whole)] == owner[size - 1 :]
        whole, owner = whole[inside], owner[: len(inside)][inside]
        key = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + owner.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    by = np.argsort(key, kind="stable")
    key, owner = key[by], owner[by]
    return np.unique(owner[1:][(key[1:] == key[:-1]) & (owner[1:] == owner[:-1])])


def collapse(words: list[bytes], runs: list[tuple]) -> list[bytes]:
    """The words that stay when of every run only its first period stays."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return words if keep.all() else [words[i] for i in np.flatnonzero(keep).tolist()]


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period),
    collapsed (the words kept, joined by one space)."""
    if min_exponent < 3:
        raise ValueError("adjacent suffixes give all runs of three periods or more")
    least = least_lcp(min_length, min_exponent)
    schema = StructType(
        [
            docs.schema[id_col],
            StructField("n_words", LongType()),
            StructField("runs", ArrayType(RUN)),
            StructField("collapsed", StringType()),
        ]
    )

    def make():
        def rows(ids, texts):
            words = [space_words((t or "").encode("utf-8", "replace")) for t in texts]
            sizes = [len(w) for w in words]
            hashes = np.array([hash(w) for d in words for w in d], dtype=np.int64).view(np.uint64)
            owner = np.repeat(np.arange(len(words)), sizes)
            again = set(repeated_windows(hashes, owner, least).tolist())
            for i, (doc, own) in enumerate(zip(ids, words, strict=True)):
                runs = []
                if i in again:
                    numbers: dict[bytes, int] = {}
                    for w in own:
                        numbers.setdefault(w, len(numbers))
                    runs = runs_of(np.array([numbers[w] for w in own]), min_length, min_exponent)
                yield (
                    doc,
                    len(own),
                    [{"start": s, "length": n, "period": q} for s, n, q in runs],
                    b" ".join(collapse(own, runs)).decode("utf-8", "replace"),
                )

        return rows

    return map_slices(docs.select(F.col(id_col), F.col(text_col)), schema, make)


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of one id in ten made periodic from some word on, for measuring what
    the search finds: with h = crc32 of the decimal id and g = h / 10, where h % 10 = 0 each word
    i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) / (3 + g % 8). Such texts have
    one space between words. Other texts, and those without id or words, stay."""
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    periodic = F.array_join(
        F.transform(
            F.col("__words"),
            lambda w, i: F.when(i < F.col("__a"), w).otherwise(
                F.element_at(F.col("__words"), (F.col("__a") + (i - F.col("__a")) % F.col("__p") + 1).cast("int"))
            ),
        ),
        " ",
    )
    planted = (
        docs.select(F.col(id_col), F.col(text_col), h.alias("__h"))
        .withColumn("__g", F.floor(F.col("__h") / 10))
        .withColumn("__words", F.when(F.col("__h") % 10 == 0, words))
        .withColumn("__n", F.greatest(F.size("__words"), F.lit(1)))
        .withColumn("__a", (F.col("__g") % F.col("__n")).cast("int"))
        .withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    )
    text = F.when(F.size("__words") > 0, periodic).otherwise(F.col(text_col))
    return planted.select(F.col(id_col), text.alias(text_col))
