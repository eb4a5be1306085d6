"""Exact substring dedup by prefix-free parsing, distributed.

Every byte covered by a ``length``-byte string that also starts earlier (smaller id, or same
document at a smaller offset) is removed; strings are judged on the input.

Parse. A rolling hash of eight bytes is taken at every position; the trigger of a string is the
place of its least hash (leftmost) among its first ``span`` positions. So the trigger depends on
the string alone, neighbouring strings share triggers, and the starts that share one are a phrase.
A phrase with the ``length - 1`` bytes behind it holds its strings whole; phrases so extended are
the dictionary. The ``length - span + 1`` bytes at the trigger lie in each of the phrase's
strings: their hash, the seed, names the phrase in the parse. Equal strings have equal seeds.

1. Seeds that occur once in the corpus are dropped: their phrases hold no repeated string.
2. The dictionary: equal extended phrases become one entry, that of the earliest occurrence; all
   strings of the other occurrences are repeats.
3. Corpus order: the suffixes of the entries under one seed, to a depth of ``length`` bytes, are
   grouped (by hash, verified byte by byte) and ordered by place; all but the first are repeats.
   Suffixes are thus compared once per dictionary entry, not once per occurrence.
4. The repeats go back to their documents.

What moves is packed into one binary row per task and target partition: seeds first, then only
phrases with a repeated seed. A passage that very many documents hold is sent at most twice per
task in step 1 and once per task in step 2; a seed with very many different surroundings (counted
in step 1) has its entries dealt by content, string by string, instead of by seed. The document
text is shuffled by id once; the three joins with it share that exchange.

Defined results: null and empty texts have no bytes; a null id ranks after all ids; rows with
equal ids rank by their text's hash, and rows equal in id and text are one document given twice;
empty tables give empty results; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from .common import map_slices, shuffle_parts, written

LENGTH = 100
NO_ID = (1 << 63) - 1
# Seeds gathered before a task packs and emits them, and bytes of phrases likewise.
FLUSH_SEEDS = 1_000_000
FLUSH_BYTES = 16 << 20
# Strings compared at a time.
CHUNK_STRINGS = 300_000
# A seed that occurs more often than HOT_ROWS is dealt by content; at most HOT_SEEDS are known.
HOT_ROWS = 4096
HOT_SEEDS = 100_000

PACKET = StructType(
    [StructField("kind", IntegerType()), StructField("part", IntegerType()), StructField("data", BinaryType())]
)
# The columns of the text exchange; every join reads them all, so that the three share it.
SOURCE = ("key", "id", "row", "text")
# Column types of the packets, by name.
SEEDS = ("<u8", "<i8")  # seed, id
FURTHER = ("<u8", "<i8")  # seed, occurrences of a flush beyond the two that are sent
ENTRIES = ("<u8", "<u8", "<i8", "<i8", "<u4", "<u4")  # seed, content hash, id, row hash, start, strings
RANGES = ("<i8", "<i8", "<u4", "<u4")  # id, row hash, first and last start
WANTED = ("<i8", "<i8", "<u4", "<u4", "<u8")  # id, row hash, start, strings, seed

_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(columns) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def unpack(blobs: list[bytes], types: tuple[str, ...]) -> list[np.ndarray]:
    """Columns of packed blobs, put together."""
    width = sum(np.dtype(t).itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for b in blobs:
        n, at = len(b) // width, 0
        for column, t in zip(out, types, strict=True):
            column.append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, types, strict=True)]


def dealt(kind: int, part: np.ndarray, columns: list[np.ndarray]):
    """Packets of the rows of ``columns``, one per value of ``part``, rows in their order."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        at = order[a:b]
        yield kind, int(part[at[0]]), pack([c[at] for c in columns])


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    mixed = (x.astype(np.uint64) ^ (x.astype(np.uint64) >> np.uint64(31))) * _MIX
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def eights(data: bytes | np.ndarray) -> np.ndarray:
    """The eight bytes at every position as a number (a view, nothing is copied)."""
    return np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def string_hash(at: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (at least eight) at each start."""
    h = at[starts] * _MIX
    for o in [*range(8, size - 8, 8), size - 8]:
        h = (h ^ (h >> np.uint64(29))) * _MIX + at[starts + o]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def phrases(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of strings, seed) of each phrase."""
    span = length * 16 // 25
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = eights(data)
    places = len(data) - length + span
    key = (at[:places] * _MIX) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(places, dtype=np.uint64)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        key = np.minimum(key[:-step], key[step:])
        reach += step
    trigger = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, trigger[1:] != trigger[:-1]])
    count = np.diff(np.r_[first, len(trigger)])
    return first, count, string_hash(at, trigger[first], length - span + 1)


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [first, last] ranges: sorted, touching ones joined."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64))
    new = np.flatnonzero(np.r_[True, first[1:] > reach[:-1] + 1])
    return first[new], reach[np.r_[new[1:] - 1, len(first) - 1]]


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _reduced(packets: DataFrame, parts: int, schema: StructType, solve) -> DataFrame:
    """Send packets to their parts; ``solve({kind: blobs})`` gives a part's output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.setdefault(kind, []).append(data)
        rows = []
        for row in solve(held):
            rows.append(row)
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], schema=arrow)

    return packets.repartitionById(parts, "part").mapInArrow(run, schema)


def _per_id(ids: np.ndarray):
    """(id, row numbers) of each id."""
    if not len(ids):
        return
    order = np.argsort(ids, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(ids[order[a]]), order[a:b]


# 1. seeds --------------------------------------------------------------------------------------


def _seed_packets(source: DataFrame, length: int, parts: int) -> DataFrame:
    """Kind 0: (seed, id) to the seed's part, of each flush at most twice per seed. Kind 1: the
    further ones, repeated for certain, to the id's part. Kind 3: (seed, number of the further
    ones of this flush) to the seed's part, so that all occurrences are counted there."""

    def make():
        held: list[tuple[np.ndarray, int]] = []
        size = [0]

        def flush():
            size[0] = 0
            if not held:
                return
            seeds = np.concatenate([s for s, _ in held])
            ids = np.repeat(np.array([i for _, i in held], dtype=np.int64), [len(s) for s, _ in held])
            held.clear()
            order = np.argsort(seeds, kind="stable")
            s = seeds[order]
            third = np.zeros(len(s), dtype=bool)
            third[2:] = s[2:] == s[:-2]
            further = np.zeros(len(s), dtype=bool)
            further[order] = third
            sent = ~further
            yield from dealt(0, part_of(seeds[sent], parts), [seeds[sent], ids[sent]])
            if further.any():
                yield from dealt(1, part_of(ids[further], parts), [seeds[further], ids[further]])
                seed, times = np.unique(seeds[further], return_counts=True)
                yield from dealt(3, part_of(seed, parts), [seed, times.astype("<i8")])

        def rows(keys=None, texts=None):
            if keys is None:
                yield from flush()
                return
            for key, text in zip(keys, texts, strict=True):
                seeds = phrases(_encoded(text), length)[2]
                if len(seeds):
                    held.append((seeds, key))
                    size[0] += len(seeds)
            if size[0] >= FLUSH_SEEDS:
                yield from flush()

        return rows

    return map_slices(source.select("key", "text"), PACKET, make, finish=True)


def repeated_seeds(source: DataFrame, length: int, parts: int, hot_rows: int) -> tuple[DataFrame, np.ndarray]:
    """(key, seeds): the repeated seeds of each id; and the hot seeds."""
    most = max(1, HOT_SEEDS // parts)

    def count(held):
        seeds, ids = unpack(held.get(0, []), SEEDS)
        order = np.argsort(seeds, kind="stable")
        seeds, ids = seeds[order], ids[order]
        first = np.flatnonzero(np.r_[True, seeds[1:] != seeds[:-1]]) if len(seeds) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(seeds)])
        twice = np.repeat(times > 1, times)
        yield from dealt(1, part_of(ids[twice], parts), [seeds[twice], ids[twice]])
        for blob in held.get(1, ()):
            part = part_of(unpack([blob], SEEDS)[1][:1], parts)
            yield 1, int(part[0]), blob
        # a seed with further occurrences has two rows of the same flush here: it is in seeds[first]
        further, more = unpack(held.get(3, []), FURTHER)
        occurs = times.copy()
        np.add.at(occurs, np.searchsorted(seeds[first], further), more)
        hot = np.flatnonzero(occurs > hot_rows)
        if len(hot):
            hot = hot[np.argsort(-occurs[hot], kind="stable")[:most]]
            yield 2, 0, seeds[first[hot]].tobytes()

    def per_id(held):
        seeds, ids = unpack(held.get(1, []), SEEDS)
        for key, at in _per_id(ids):
            yield key, np.unique(seeds[at]).tobytes()
        for blob in held.get(2, ()):
            yield None, blob

    schema = StructType([StructField("key", LongType()), StructField("seeds", BinaryType())])
    packets = _reduced(_seed_packets(source, length, parts), parts, PACKET, count)
    rows = written(_reduced(packets, parts, schema, per_id), "substring-seeds")
    hot = [np.frombuffer(bytes(r.seeds), "<u8") for r in rows.where("key is null").select("seeds").collect()]
    return rows.where("key is not null"), np.sort(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


# 2. dictionary ---------------------------------------------------------------------------------


def _first_of_groups(groups: list[np.ndarray], places: list[np.ndarray]):
    """Order rows by group then place: (order, is first of its group, same place as the first)."""
    order = np.lexsort([*reversed(places), *reversed(groups)])
    first = np.zeros(len(order), dtype=bool)
    first[:1] = True
    for g in groups:
        s = g[order]
        first[1:] |= s[1:] != s[:-1]
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    same = np.ones(len(order), dtype=bool)
    for p in places:
        same &= p[order] == p[head]
    return order, first, same


def _dictionary_packets(joined: DataFrame, length: int, parts: int, hot: np.ndarray) -> DataFrame:
    """Kind 0: the earliest occurrence in this task of each extended phrase. Kind 1: ranges of
    starts of its other occurrences."""

    def make():
        from xxhash import xxh3_64_intdigest

        held: list[tuple] = []

        def flush():
            if not held:
                return
            seed, content, start, count = (np.concatenate([h[i] for h in held]) for i in range(4))
            sizes = [len(h[0]) for h in held]
            key = np.repeat(np.array([h[4] for h in held], dtype=np.int64), sizes)
            row = np.repeat(np.array([h[5] for h in held], dtype=np.int64), sizes)
            held.clear()
            order, first, same = _first_of_groups([seed, content], [key, row, start])
            at = np.sort(order[first])
            part = np.where(_among(seed[at], hot), part_of(seed[at] ^ content[at], parts), part_of(seed[at], parts))
            yield from dealt(0, part, [c[at] for c in (seed, content, key, row, start, count)])
            at = np.sort(order[~first & ~same])
            last = start[at] + count[at] - np.uint32(1)
            yield from dealt(1, part_of(key[at], parts), [key[at], row[at], start[at], last])

        def rows(keys=None, ids=None, hashes=None, texts=None, wanted=None):
            if keys is None:
                yield from flush()
                return
            for key, row, text, blob in zip(keys, hashes, texts, wanted, strict=True):
                data = _encoded(text)
                first, count, seed = phrases(data, length)
                at = np.flatnonzero(_among(seed, np.frombuffer(blob, "<u8")))
                if len(at):
                    ends = (first[at] + count[at] + length - 1).tolist()
                    content = np.array(
                        [xxh3_64_intdigest(data[a:b]) for a, b in zip(first[at].tolist(), ends, strict=True)],
                        dtype=np.uint64,
                    )
                    held.append(
                        (seed[at], content, first[at].astype(np.uint32), count[at].astype(np.uint32), key, row)
                    )
            if sum(len(h[0]) for h in held) >= FLUSH_SEEDS:
                yield from flush()

        return rows

    return map_slices(joined.select(*SOURCE, "seeds"), PACKET, make, finish=True)


def _dictionary(packets: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(key, ranges, wanted): ranges of starts known to repeat, and the entries whose seed has
    further entries, so that their strings must be compared."""

    def solve(held):
        seed, content, key, row, start, count = unpack(held.get(0, []), ENTRIES)
        order, first, same = _first_of_groups([seed, content], [key, row, start])
        at = order[~first & ~same]
        last = start[at] + count[at] - np.uint32(1)
        yield from dealt(1, part_of(key[at], parts), [key[at], row[at], start[at], last])
        for blob in held.get(1, ()):
            yield 1, int(part_of(unpack([blob], RANGES)[0][:1], parts)[0]), blob
        at = order[first]
        _, which, times = np.unique(seed[at], return_inverse=True, return_counts=True)
        at = np.sort(at[(times[which] > 1) | _among(seed[at], hot)])
        yield from dealt(2, part_of(key[at], parts), [key[at], row[at], start[at], count[at], seed[at]])

    def per_id(held):
        found: dict[int, list] = {}
        key, row, first, last = unpack(held.get(1, []), RANGES)
        for k, at in _per_id(key):
            found[k] = [_row_ranges(row[at], first[at], last[at]), b""]
        columns = unpack(held.get(2, []), WANTED)
        for k, at in _per_id(columns[0]):
            found.setdefault(k, [b"", b""])[1] = pack([c[at] for c in columns[1:]])
        for k, (ranges, wanted) in found.items():
            yield k, ranges, wanted

    schema = StructType(
        [StructField("key", LongType()), StructField("ranges", BinaryType()), StructField("wanted", BinaryType())]
    )
    return _reduced(_reduced(packets, parts, PACKET, solve), parts, schema, per_id)


def _row_ranges(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> bytes:
    """Packed (row hash, first, last) with the ranges of each row merged."""
    rows, firsts, lasts = [], [], []
    for r in np.unique(row):
        a, b = merged(first[row == r], last[row == r])
        rows.append(np.full(len(a), r, dtype="<i8"))
        firsts.append(a.astype("<u4"))
        lasts.append(b.astype("<u4"))
    return pack([np.concatenate(c) for c in (rows, firsts, lasts)]) if rows else b""


# 3. corpus order -------------------------------------------------------------------------------


def _entry_packets(joined: DataFrame, length: int, parts: int, hot: np.ndarray) -> DataFrame:
    """Kind 0: dictionary entries with their bytes, to their seed's part (of hot seeds each
    string by itself, to its content's part). Kind 1: the known ranges, to their id's part."""

    def make():
        entries: list[tuple] = []
        ranges: list[list[np.ndarray]] = []
        size = [0]

        def flush():
            if entries:
                seed, key, row, start, count = (
                    np.array([e[i] for e in entries], dtype=t)
                    for i, t in enumerate(("<u8", "<i8", "<i8", "<u4", "<u4"))
                )
                part = np.array([e[6] for e in entries], dtype=np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    at = order[a:b]
                    head = len(at).to_bytes(4, "little") + pack([c[at] for c in (seed, key, row, start, count)])
                    yield 0, int(part[at[0]]), head + b"".join(entries[i][5] for i in at)
            if ranges:
                columns = [np.concatenate(c) for c in zip(*ranges, strict=True)]
                yield from dealt(1, part_of(columns[0], parts), columns)
            entries.clear()
            ranges.clear()
            size[0] = 0

        def rows(keys=None, ids=None, hashes=None, texts=None, known=None, wanted=None):
            if keys is None:
                yield from flush()
                return
            for key, row, text, blob, want in zip(keys, hashes, texts, known, wanted, strict=True):
                if blob:
                    r, first, last = unpack([blob], RANGES[1:])
                    at = r == row
                    n = int(at.sum())
                    ranges.append([np.full(n, key, dtype="<i8"), r[at], first[at], last[at]])
                    size[0] += 24 * n
                if want:
                    data = _encoded(text)
                    r, start, count, seed = unpack([want], WANTED[1:])
                    at = np.flatnonzero(r == row)
                    by_seed = part_of(seed[at], parts).tolist()
                    is_hot = _among(seed[at], hot).tolist()
                    for i, part, one in zip(at.tolist(), by_seed, is_hot, strict=True):
                        a, n = int(start[i]), int(count[i])
                        if one:
                            places = part_of(string_hash(eights(data), np.arange(a, a + n), length), parts).tolist()
                            entries.extend(
                                (seed[i], key, row, a + j, 1, data[a + j : a + j + length], p)
                                for j, p in enumerate(places)
                            )
                            size[0] += n * (length + 32)
                        else:
                            entries.append((seed[i], key, row, a, n, data[a : a + n + length - 1], part))
                            size[0] += n + length + 32
                if size[0] >= FLUSH_BYTES:
                    yield from flush()

        return rows

    return map_slices(joined.select(*SOURCE, "ranges", "wanted"), PACKET, make, finish=True)


def repeats_among(entries: list[np.ndarray], data: np.ndarray, length: int) -> list[np.ndarray]:
    """(id, row hash, start) of the strings of entries (seed, id, row hash, start, strings, offset
    in ``data``) that also start at an earlier place."""
    seed, key, row, start, count, offset = entries
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(offset, count) + inside
    key, row, place = np.repeat(key, count), np.repeat(row, count), np.repeat(start, count) + inside
    eight = eights(data)
    digest = string_hash(eight, at, length) ^ np.repeat(seed, count)
    # only strings whose hash occurs again are ordered by place
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    twice = np.zeros(len(d), dtype=bool)
    twice[1:] = d[1:] == d[:-1]
    twice[:-1] |= twice[1:]
    some = order[twice]
    if not len(some):
        return [key[:0], row[:0], place[:0]]
    at, digest, key, row, place = at[some], digest[some], key[some], row[some], place[some]
    order, first, same = _first_of_groups([digest], [key, row, place])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    equal = np.ones(len(order), dtype=bool)
    for o in [*range(0, length - 8, 8), length - 8]:
        equal &= eight[at[order] + o] == eight[at[head] + o]
    repeat = ~first & ~same & equal
    # strings that share a hash with an earlier one of other bytes: compared as bytes
    seen: dict[bytes, tuple] = {}
    for i in np.flatnonzero(~equal).tolist():
        j = order[i]
        text, here = data[at[j] : at[j] + length].tobytes(), (key[j], row[j], place[j])
        repeat[i] = seen.setdefault(text, here) != here
    found = order[repeat]
    return [key[found], row[found], place[found]]


def _ordered(packets: DataFrame, parts: int, length: int) -> DataFrame:
    """(key, ranges): all ranges of starts that repeat, per id."""

    def solve(held):
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        buffers, base = [], 0
        for blob in held.pop(0, []):
            n, at = int.from_bytes(blob[:4], "little"), 4
            for column, t in zip(columns, ("<u8", "<i8", "<i8", "<u4", "<u4"), strict=False):
                column.append(np.frombuffer(blob, t, n, at))
                at += n * np.dtype(t).itemsize
            sizes = columns[4][-1].astype(np.int64) + length - 1
            columns[5].append(base + np.cumsum(sizes) - sizes)
            buffers.append(blob[at:])
            base += len(buffers[-1])
        if buffers:
            data = np.frombuffer(b"".join(buffers), dtype=np.uint8)
            buffers.clear()
            seed, key, row, start, count, offset = (np.concatenate(c) for c in columns)
            order = np.argsort(seed, kind="stable")
            strings = np.cumsum(count[order])
            change = np.flatnonzero(np.r_[True, seed[order][1:] != seed[order][:-1]])
            a = 0
            while a < len(order):
                # whole seeds until the chunk holds enough strings
                reached = np.searchsorted(strings, (strings[a - 1] if a else 0) + CHUNK_STRINGS)
                after = np.searchsorted(change, reached, side="right")
                b = int(change[after]) if after < len(change) else len(order)
                at = order[a:b]
                found = repeats_among(
                    [seed[at], key[at], row[at], start[at].astype(np.int64), count[at].astype(np.int64), offset[at]],
                    data,
                    length,
                )
                place = found[2].astype("<u4")
                yield from dealt(1, part_of(found[0], parts), [found[0], found[1], place, place])
                a = b
        for blob in held.get(1, ()):
            yield 1, int(part_of(unpack([blob], RANGES)[0][:1], parts)[0]), blob

    def per_id(held):
        key, row, first, last = unpack(held.get(1, []), RANGES)
        for k, at in _per_id(key):
            yield k, _row_ranges(row[at], first[at], last[at])

    schema = StructType([StructField("key", LongType()), StructField("ranges", BinaryType())])
    return _reduced(_reduced(packets, parts, PACKET, solve), parts, schema, per_id)


# 4. documents ----------------------------------------------------------------------------------


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 and ``spans`` (removed
    byte runs ``[start, end)``). ``length`` is at least 24."""
    parts = shuffle_parts(docs.sparkSession)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("row"),
        F.col(text_col).alias("text"),
    ).select(*SOURCE)
    seeds, hot = repeated_seeds(source, length, parts, hot_rows)
    texts = source.repartition(parts, "key")
    entries = _dictionary(
        _dictionary_packets(texts.join(seeds.hint("shuffle_hash"), "key"), length, parts, hot), parts, hot
    )
    ranges = _ordered(
        _entry_packets(texts.join(entries.hint("shuffle_hash"), "key"), length, parts, hot), parts, length
    )
    both = texts.join(ranges.hint("shuffle_hash"), "key", "left").select(*SOURCE, "ranges")
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType(
        [docs.schema[id_col]]
        + [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
        + [StructField("kept_sha256", StringType()), StructField("spans", ArrayType(span))]
    )

    def make():
        def rows(keys, ids, hashes, texts, blobs):
            for doc, row, text, blob in zip(ids, hashes, texts, blobs, strict=True):
                data = _encoded(text)
                kept, spans, at = hashlib.sha256(), [], 0
                if blob:
                    r, first, last = unpack([blob], RANGES[1:])
                    mine = r == row
                    a, b = merged(first[mine].astype(np.int64), last[mine].astype(np.int64) + length - 1)
                    spans = list(zip(a.tolist(), (b + 1).tolist(), strict=True))
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                yield (
                    doc,
                    len(data),
                    sum(b - a for a, b in spans),
                    len(spans),
                    kept.hexdigest(),
                    [{"start": a, "end": b} for a, b in spans],
                )

        return rows

    return map_slices(both, schema, make)
