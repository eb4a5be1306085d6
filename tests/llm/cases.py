"""Small documents that hold the odd cases every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
    ]
)
# Names that operators use for their own columns.
CLASHES = ("n_words", "id", "row", "key", "fp", "spans", "kept", "hash", "labels", "component_id", "bucket", "words")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(
        "".join(rng.choices("abcdefghij éü", k=rng.randint(2, 8))).strip() or "x" for _ in range(words)
    )


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text."""
    shared = prose(1, 60)
    texts = [
        None,
        "",
        " \n\t ",
        "word",
        "ÀÉ ßÿ 日本語 мир",
        "a" * 5000,
        "ab " * 2000,
        shared,
        shared,
        f"{prose(2, 30)}\n{shared}\n{prose(3, 30)}",
        f"{prose(4, 30)} {shared} {prose(5, 30)}",
        prose(6, 400),
        prose(6, 399) + " changed",
        prose(7, 60_000),
        "x\x00y\x1cz   . . . !!! \U0001f600 ퟿",
    ]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated rows
    rows += [(100, shared, None, None, None), (None, shared, "en", "s1", 5), (None, prose(8, 50), None, None, None)]
    return rows


def frame(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    if clashes:
        for c in CLASHES:
            df = df.selectExpr("*", f"'clash' AS {c}")
    return df
