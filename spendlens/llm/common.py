"""Helpers shared by the corpus operators: row mapping in bounded slices, words, scratch tables."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spendlens.session import scratch_path

# Rows of one slice handed to a Python function: bounded by text size and by count.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 2000

_UPPER = bytes(range(0x41, 0x5B))
# A-Z to a-z, everything else unchanged.
ASCII_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
# A-Z to a-z and every ASCII byte that is no letter or digit to a space: what is left between
# spaces are the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
ITEM_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def item_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(ITEM_WORDS).split()


def space_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() separates at exactly those bytes."""
    return data.split()


def slices(sizes: list[int], limit_bytes: int = SLICE_BYTES, limit_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Cut consecutive rows into ranges of at most ``limit_rows`` rows and about ``limit_bytes``."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > limit_bytes or i - start >= limit_rows):
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def map_slices(
    df: DataFrame,
    schema: StructType,
    make: Callable[[], Callable[..., Iterable[tuple]]],
    finish: bool = False,
) -> DataFrame:
    """Apply a Python function to the rows of ``df`` in slices of bounded size, without a shuffle.

    ``make()`` runs once per task and returns ``fn(*columns)``: lists of one slice's values,
    giving the output rows as tuples in the order of ``schema``. With ``finish`` the function is
    called once more per task, without arguments, after the last slice.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        fn = make()

        def out(rows):
            rows = list(rows)
            for i in range(0, len(rows), 20_000):
                part = list(zip(*rows[i : i + 20_000], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(part, arrow, strict=True)], schema=arrow
                )

        for batch in batches:
            sizes = [16] * batch.num_rows
            for c in batch.columns:
                sizes = [a + b for a, b in zip(sizes, _byte_lengths(c), strict=True)]
            for a, b in slices(sizes):
                yield from out(fn(*(c.slice(a, b - a).to_pylist() for c in batch.columns)))
        if finish:
            yield from out(fn())

    return df.mapInArrow(run, schema)


def extended(
    df: DataFrame, schema: StructType, make: Callable[[], Callable[..., Iterable[tuple]]], *inputs: str
) -> DataFrame:
    """``df`` with the columns of ``schema`` behind its own, one value tuple per row from
    ``fn(*inputs)`` of a slice. The columns of ``df`` pass through as they are: they become no
    Python objects, but for the inputs."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    at = [df.columns.index(c) for c in inputs]

    def run(batches):
        import pyarrow as pa

        fn = make()
        for batch in batches:
            sizes = [16] * batch.num_rows
            for c in batch.columns:
                sizes = [a + b for a, b in zip(sizes, _byte_lengths(c), strict=True)]
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                made = zip(*fn(*(part.column(i).to_pylist() for i in at)), strict=True)
                new = [pa.array(c, type=f.type) for c, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema([*batch.schema, *arrow]))

    return df.mapInArrow(run, StructType([*df.schema.fields, *schema.fields]))


def _byte_lengths(column) -> list[int]:
    """Bytes of each text or binary value; zero for other types."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
        return [n or 0 for n in pc.binary_length(column).to_pylist()]
    return [0] * len(column)


def worker_state(name: str) -> types.ModuleType:
    """A holder that lives as long as the Python worker process, for caches kept between tasks."""
    return sys.modules.setdefault(f"_spendlens_llm_{name}", types.ModuleType(name))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage is cut there and
    a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# What may be broadcast: at most so many rows and bytes of a side whose size has been counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def is_small(df: DataFrame, *strings: str) -> bool:
    """Whether a count of rows and of the bytes of ``strings`` lies under the bounds above."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(16))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def small(df: DataFrame, *strings: str, beyond: str = "merge") -> DataFrame:
    """``df`` with a broadcast hint if it is small, else with a merge-join hint, which leaves hot
    keys to AQE's skew-join splitting, or the one given."""
    return F.broadcast(df) if is_small(df, *strings) else df.hint(beyond)
