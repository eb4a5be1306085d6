"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item's windows are its runs of ten consecutive words (an item of fewer words is one window).
A window is the set of its shingles of five words; shingles are ordered by their frequency over
all documents, rarest first. A document holds the window only if it holds all of its shingles, so
the necessary prefix is one shingle: the rarest. Documents are joined on that shingle alone (a
window whose rarest shingle is in no document drops out), the positional bound keeps candidates
whose window would lie inside the document, and the words themselves are compared.

Three passes over the documents: frequencies, candidates, word counts. The benchmark side is
broadcast only below a counted size, and no document text is shuffled then; beyond it, positions
(id, text hash, place, shingle hash) are joined by a sort-merge join whose hot shingles AQE splits,
and the words of the documents with candidates are compared after joining these back.

Defined results: null and empty texts have no words and no hits; items without words have no
windows; repeated items count once per item_id and repeated documents are judged each; empty
tables give empty results, an empty benchmark no hits; only the ids and texts are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, small, written

WINDOW = 10
SHINGLE = 5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ASCII characters that are no letter or digit stand between words.
_BETWEEN = "".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """One row per window and shingle in it: item, words, size, k (words a shingle), offset, hash."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("ws")).where(
        F.size("ws") > 0
    )
    size = F.least(F.lit(window), F.size("ws"))
    windows = items.select(
        "item", "ws", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("ws") - size)).alias("s")
    ).select("item", "size", F.slice("ws", F.col("s") + 1, F.col("size")).alias("words"))
    windows = windows.distinct()
    parts = []
    for k in range(1, shingle + 1):
        of = F.col("size") >= shingle if k == shingle else F.col("size") == k
        parts.append(
            windows.where(of)
            .select("*", F.lit(k).alias("k"), F.explode(F.sequence(F.lit(0), F.col("size") - k)).alias("offset"))
            .withColumn("hash", _hash(F.col("words"), F.col("offset"), k))
        )
    return reduce(DataFrame.unionByName, parts)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, row_hash (of the text), ws (its words)."""
    return docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row_hash"), words_of(F.col(text_col)).alias("ws")
    )


def _positions(words: DataFrame, k: int, *keep: str) -> DataFrame:
    """Every k-word shingle of rows with ws: the columns ``keep``, its place and hash. Of a document
    the words are referenced, not copied, as long as no shuffle follows."""
    at = words.where(F.size("ws") >= k).select("*", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("pos"))
    return at.withColumn("hash", _hash(F.col("ws"), F.col("pos"), k)).select(*keep, "pos", "hash")


def window_prefixes(words: DataFrame, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """The necessary prefix of each window, its rarest shingle over all documents: words, size, k,
    hash, offset, items. Windows with a shingle that is nowhere drop out; one row per different
    window, with the items that share it."""
    known = tokens.select("k", "hash").distinct()
    counted = [
        _positions(words, k).join(small(known.where(F.col("k") == k).select("hash")), "hash").select("hash", F.lit(k).alias("k"))
        for k in sizes
    ]
    seen = written(reduce(DataFrame.unionByName, counted).groupBy("k", "hash").count(), "decontam-counts")
    ranked = tokens.join(small(seen), ["k", "hash"], "left").groupBy("item", "words", "size", "k").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "hash", "offset")).alias("rarest")
    )
    shared = ranked.where("rarest.n > 0").groupBy("words", "size", "k", "rarest.hash", "rarest.offset").agg(
        F.collect_set("item").alias("items")
    )
    return written(shared, "decontam-prefixes")


def contained_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """Occurrences of windows: id, row_hash (of the text), start (word), size, items."""
    tokens = written(item_windows(benchmark, item_col, item_text_col, window, shingle), "decontam-windows")
    sizes = sorted(r.k for r in tokens.select("k").distinct().collect())  # at most ``shingle`` values
    words = _documents(docs, id_col, text_col)
    if not sizes:
        ids, items = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"id {ids}, row_hash long, start int, size int, items array<{items}>"
        )
    prefix = window_prefixes(words, tokens, sizes)
    start = F.col("pos") - F.col("offset")
    held = F.slice("ws", F.col("start") + 1, F.col("size")) == F.col("words")
    found = []
    for k in sizes:
        of = prefix.where(F.col("k") == k).drop("k").withColumn("__b", F.concat_ws(" ", "words", F.col("items").cast("array<string>")))
        few = is_small(of, "__b")
        side = F.broadcast(of) if few else of.hint("merge")
        out = ("id", "row_hash", "start", "size", "items")
        if few:
            at = _positions(words, k, "id", "row_hash", "ws").join(side, "hash").withColumn("start", start)
            found.append(at.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("ws"))).where(held).select(*out))
            continue
        # Beyond the bound narrow rows are joined, and only documents with candidates join back.
        at = _positions(words, k, "id", "row_hash").join(side.drop("__b"), "hash").withColumn("start", start)
        at = written(at.where("start >= 0").select(*out, "words").distinct(), "decontam-candidates")
        near = small(at.select(F.col("id").alias("__i"), F.col("row_hash").alias("__h")).distinct())
        texts = words.join(near, F.col("id").eqNullSafe(F.col("__i")) & (F.col("row_hash") == F.col("__h")), "leftsemi")
        same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash"))
        both = at.join(texts.distinct().select(F.col("id").alias("__id"), F.col("row_hash").alias("__hash"), "ws"), same)
        found.append(both.where(F.col("start") + F.col("size") <= F.size("ws")).where(held).select(*out))
    return reduce(DataFrame.unionByName, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, row_hash, n_words, n_hit (words inside windows), n_items, items
    (ids as strings, sorted), contaminated."""
    hits = contained_windows(docs, benchmark, id_col, text_col, **options)
    # Bounded by the words of one document and the items. The windows of a document are made
    # different before their items are listed.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, a.reach))).alias("n"),
            F.greatest(a.reach, s.end).alias("reach"),
        ),
        lambda a: a.n,
    )
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string")))
    per_document = (
        hits.groupBy("id", "row_hash")
        .agg(spans.alias("spans"), items.alias("items"))
        .select("id", "row_hash", covered.cast("long").alias("n_hit"), "items")
    )
    counts = docs.select(
        F.col(id_col).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__hash"),
        F.size(words_of(F.col(text_col))).cast("long").alias("n_words"),
    )
    same = F.col("__id").eqNullSafe(F.col("id")) & (F.col("__hash") == F.col("row_hash"))
    return (
        counts.join(per_document.hint("merge"), same, "left")
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .select(
            F.col("__id").alias(id_col),
            F.col("__hash").alias("row_hash"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            "items",
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that hold no window."""
    hit = contained_windows(docs, benchmark, id_col, text_col, **options).select(
        F.col("id").alias("__id"), F.col("row_hash").alias("__hash")
    )
    hit = written(hit.distinct(), "decontam-hit")
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash"))
    return docs.join(small(hit), same, "leftanti")
