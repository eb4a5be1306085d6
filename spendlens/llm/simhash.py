"""SimHash near-dedup by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius (two of four bits: itself, 64 and
2016 more). Two fingerprints within the radius share a variant, and two that share one are within
the radius, as either is at most half of it away; a bit count verifies them all the same.

The variants are dealt by their top ``prefix`` bits. A fingerprint's variants reach only
1 + p + p(p-1)/2 of those prefixes, so what is shuffled is one row per fingerprint and prefix with
the flips that are left for the low bits; the low-bit flips are made beside the sort that finds
colliding variants. A prefix with more rows than ``GROUP_ROWS`` is dealt to several tasks by a
linear checksum of the variant, each task making only the variants of its checksum; within a task
the same checksum bounds how many variants are in memory. Equal fingerprints are one row first.

Per group the colliding fingerprints are reported as a star to the least one of their local
component, never as all pairs; the stars are joined to components by alternating large-star and
small-star rounds with each round written to the checkpoint folder.

Defined results: a text without words (null, empty, blank) has fingerprint zero and links as any
other; repeated rows and ties share fingerprint and component; rows with a null id are linked but
name no component (a component of such rows alone has a null id); empty tables give empty
results; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import ASCII_LOWER, map_slices, shuffle_parts, small, space_words, written

SHINGLE = 4
RADIUS = 4
SEED = 42
# Fingerprints of one prefix aimed at, and the rows from which a prefix is split further.
PREFIX_FINGERPRINTS = 1000
GROUP_ROWS = 50_000
# Links from which each step of a round of the components is written.
SPLIT_LINKS = 1_000_000
# Variants that a task keeps in memory at a time.
CHUNK_VARIANTS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles (repeats included), hashed by XXH64."""
    from xxhash import xxh64_intdigest

    words = space_words((text or "").encode("utf-8", "replace").translate(ASCII_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[:-1]).tolist()]
    ends = (ends - 1).tolist()
    hashes = np.array(
        [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype="<u8"
    )
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """id, row_hash (of the text), fp (the fingerprint as a signed long); one row per input row."""
    schema = StructType(
        [docs.schema[id_col], StructField("row_hash", LongType()), StructField("fp", LongType())]
    )

    def make():
        def rows(ids, hashes, texts):
            return [
                (d, h, _signed(fingerprint(t, shingle))) for d, h, t in zip(ids, hashes, texts, strict=True)
            ]

        return rows

    source = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)), F.col(text_col).alias("__text"))
    return map_slices(source, schema, make)


def flips(bits: range, most: int) -> np.ndarray:
    """XOR masks of all choices of up to ``most`` (at most two) of the given bits."""
    one = np.array([1 << b for b in bits], dtype=np.uint64)
    out = [np.zeros(1, dtype=np.uint64)]
    if most >= 1:
        out.append(one)
    if most >= 2 and len(one) > 1:
        i, j = np.triu_indices(len(one), 1)
        out.append(one[i] ^ one[j])
    return np.concatenate(out)


def checksum(x: np.ndarray, bits: int = 10) -> np.ndarray:
    """XOR-linear checksum in which every bit counts differently: bit i adds the code i + 1,
    spread over two digits, so single and double flips change it."""
    out = np.zeros(x.shape, dtype=np.uint64)
    for i in range(64):
        code = np.uint64(((i + 1) * 0x2F3) & ((1 << bits) - 1) or 1)
        out ^= ((x >> np.uint64(i)) & np.uint64(1)) * code
    return out


def routed(distinct: DataFrame, prefix: int, radius: int) -> DataFrame:
    """Rows (key, fp, left): every prefix that variants of fp can have, and the flips left."""
    half = radius // 2
    schema = StructType(
        [StructField("key", IntegerType()), StructField("fp", LongType()), StructField("left", IntegerType())]
    )

    def make():
        masks = flips(range(64 - prefix, 64), half) >> np.uint64(64 - prefix)
        left = (half - np.bitwise_count(masks)).astype(np.int32).tolist()

        def rows(fps):
            top = np.array(fps, dtype=np.int64).view(np.uint64) >> np.uint64(64 - prefix)
            keys = (top[:, None] ^ masks[None, :]).astype(np.int64).tolist()
            for fp, row in zip(fps, keys, strict=True):
                yield from zip(row, [fp] * len(row), left, strict=True)

        return rows

    return map_slices(distinct.select("fp"), schema, make)


def collide(fps: np.ndarray, left: np.ndarray, prefix: int, radius: int, split: int, share: int) -> list:
    """Links (fp, least fp of its local component) among the rows of one prefix.

    Of the variants, only those whose checksum modulo ``split`` is ``share`` are made.
    """
    low = range(0, 64 - prefix)
    fps = fps.view(np.uint64)
    key_bits = np.uint64((1 << (64 - prefix)) - 1)
    groups = []
    for n in range(radius // 2 + 1):
        members = np.flatnonzero(left == n)
        if len(members):
            groups.append((members, flips(low, n)))
    total = sum(len(m) * len(f) for m, f in groups)
    parts = 1
    while total // (parts * split) > CHUNK_VARIANTS and parts * split < 1024:
        parts *= 2
    rows = [(m, fps[m] & key_bits, checksum(fps[m] & key_bits), f, checksum(f)) for m, f in groups]
    parent = np.arange(len(fps))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    every = np.uint64(split * parts - 1)
    for part in range(parts):
        wanted = np.uint64(share + split * part)
        values, owners = [], []
        for members, base, sums, masks, mask_sums in rows:
            for a in range(0, len(members), 512):
                if split * parts == 1:
                    v = base[a : a + 512, None] ^ masks[None, :]
                    values.append(v.ravel())
                    owners.append(np.repeat(members[a : a + 512], len(masks)))
                else:
                    i, j = np.nonzero(((sums[a : a + 512, None] ^ mask_sums[None, :]) & every) == wanted)
                    values.append(base[a : a + 512][i] ^ masks[j])
                    owners.append(members[a : a + 512][i])
        if not values:
            continue
        values, owners = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(values)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        at = np.searchsorted(twice, values)
        at[at == len(twice)] = 0
        hit = np.flatnonzero(twice[at] == values)
        hit = hit[np.argsort(at[hit], kind="stable")]
        same, who = at[hit], owners[hit]
        first = np.flatnonzero(np.r_[True, same[1:] != same[:-1]])
        heads = np.repeat(who[first], np.diff(np.r_[first, len(same)]))
        pairs = np.unique(np.stack([heads, who], axis=1)[heads != who], axis=0)
        near = np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius
        for i, j in pairs[near].tolist():
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    out = []
    signed = fps.view(np.int64)
    least: dict[int, int] = {}
    roots = [find(i) for i in range(len(fps))]
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, signed[i]), signed[i])
    for i, r in enumerate(roots):
        if signed[i] != least[r]:
            out.append((int(signed[i]), int(least[r])))
    return out


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (u, v), v < u, whose components are those of all pairs within ``radius`` bits."""
    spark = distinct.sparkSession
    prefix = min(24, max(6, int(np.ceil(np.log2(max(1, count) / PREFIX_FINGERPRINTS)))))
    rows = written(routed(distinct, prefix, radius), "simhash-routed")
    # At most 2^24 prefixes exist and only the overfull ones are kept: they are few, as their
    # rows are at least GROUP_ROWS each, and are joined, not broadcast, beyond the usual bound.
    full = (
        rows.groupBy("key")
        .count()
        .where(F.col("count") > GROUP_ROWS)
        .select("key", F.least(F.lit(1024), F.pow(2, F.ceil(F.log2(F.col("count") / GROUP_ROWS)))).cast("int").alias("split"))
    )
    dealt = (
        rows.join(small(full), "key", "left")
        .withColumn("split", F.coalesce("split", F.lit(1)))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    )
    schema = StructType([StructField("u", LongType()), StructField("v", LongType())])

    def run(batches):
        """Rows arrive ordered by (key, share); a group ends where they change."""
        import pyarrow as pa

        held, held_key = [], None

        def solve():
            table = np.concatenate(held, axis=1)
            return collide(
                np.ascontiguousarray(table[0]), table[1], prefix, radius, int(table[2][0]), held_key[1]
            )

        def out(found):
            u, v = (list(c) for c in zip(*found, strict=True)) if found else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, share, fp, left, split = (
                batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)
            )
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (share[1:] != share[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                k = (int(key[a]), int(share[a]))
                if k != held_key and held:
                    yield out(solve())
                    held.clear()
                held_key = k
                held.append(np.stack([fp[a:b], left[a:b], split[a:b]]))
        if held:
            yield out(solve())

    n = shuffle_parts(spark)
    return (
        dealt.select("key", "share", "fp", "left", "split")
        .repartition(n, "key", "share")
        .sortWithinPartitions("key", "share")
        .mapInArrow(run, schema)
        .distinct()
    )


def _is_stars(edges: DataFrame, count: int) -> bool:
    """Whether every node has one lower neighbour and no lower neighbour has one itself."""
    if edges.select("u").distinct().count() < count:
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "leftsemi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node connected; nodes without edges are left out.

    Alternating large-star and small-star on (u, v) rows with v < u, written after each round,
    until every component is a star around its least node. Minimums are combined map-side. Of a
    large graph they are written too, so that each join has two plain shuffles and AQE can split a
    star's centre with very many neighbours; the rows are the same either way.
    """
    edges = written(edges, "components")
    while not _is_stars(edges, count := edges.count()):

        def cut(df: DataFrame, large: bool = count > SPLIT_LINKS) -> DataFrame:
            return written(df, "components-step") if large else df

        # large-star: every neighbour above a node is linked to the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        # small-star: a node's neighbours below it, and itself, are linked to the least of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small_ = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = written(small_, "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row per input row: id, row_hash, fp, root (least fingerprint reachable by links: the
    component itself), component_id (least id reachable; two components share it if an id repeats)."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    spark = docs.sparkSession
    distinct = written(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-distinct")
    count = distinct.count()
    roots = components(links(distinct.repartition(shuffle_parts(spark)), count, radius))
    roots = (
        roots.unionByName(roots.select(F.col("root").alias("node"), "root"))
        .distinct()
        .join(distinct.withColumnRenamed("fp", "node"), "node")
    )
    roots = written(roots, "simhash-roots")
    first = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = roots.join(first, "root").select(F.col("node").alias("fp"), "root", "component_id")
    of = distinct.join(of, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    # Written for a join of two plain shuffles: a fingerprint with very many copies is split by AQE.
    of = written(of, "simhash-named")
    return rows.join(of.hint("merge"), "fp").select(F.col(id_col), "row_hash", "fp", "root", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that with the least id (of rows
    equal in id, the one with the least text hash, once).

    Which rows go is decided on ids and text hashes alone. The texts are not shuffled while the
    rows that go are few enough to be broadcast; beyond that they are shuffled once, against a
    hash table of those rows, and not sorted. Only rows that are repeated as they stand, and stay,
    are gathered to be kept once."""
    found = near_duplicates(docs, id_col, text_col, shingle, radius)
    rows = found.groupBy(F.col(id_col).alias("__id"), F.col("row_hash").alias("__hash"), "root", "component_id").count()
    rows = written(rows, "simhash-components")
    # Grouped by the component itself, as two of them have the same component_id if an id repeats.
    kept = (
        rows.where(F.col("__id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("root").alias("__root"), F.col("component_id").alias("__keep"))
        .agg(F.min("__hash").alias("__least"))
    )
    is_kept = (
        (F.col("root") == F.col("__root"))
        & F.col("__id").eqNullSafe(F.col("__keep"))
        & (F.col("__hash") == F.col("__least"))
    )
    marked = written(rows.join(kept, is_kept, "left").withColumn("__stays", F.col("__least").isNotNull()), "simhash-kept")

    def these(df: DataFrame) -> DataFrame:
        return df.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"))

    same = F.col(id_col).eqNullSafe(F.col("__i")) & (F.xxhash64(F.col(text_col)) == F.col("__h"))
    gone = these(marked.where(~F.col("__stays")))
    repeated = these(marked.where(F.col("__stays") & (F.col("count") > 1)))
    if repeated.isEmpty():
        return docs.join(small(gone, beyond="shuffle_hash"), same, "leftanti")
    once = docs.join(small(gone.unionByName(repeated), beyond="shuffle_hash"), same, "leftanti")
    again = docs.join(small(repeated, beyond="shuffle_hash"), same, "leftsemi")
    again = again.withColumn("__h", F.xxhash64(F.col(text_col)))
    return once.unionByName(again.dropDuplicates([id_col, "__h"]).drop("__h"))
