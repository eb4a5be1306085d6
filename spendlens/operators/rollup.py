"""Daily rollup of the transactions, kept by the ingest.

One row per user, day, category, sub-category, merchant, subscription flag and sign: the sum of the
amounts and the number of transactions. Sums and counts merge, so a batch writes the rollup of its
own rows and the reader's aggregates add the batches up. The dashboard's functions (``operators.analytics``) take
rollup rows in place of transactions, as these keep day, sign and names apart and carry their
number of transactions in ``n_rows``: same results, from far fewer rows. Single transactions (the
ten largest) are not in it.

Zero and null amounts are rows without an amount: their days count as active days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.dates import add_calendar_features

KEYS = ["user_id", "transaction_date", "category", "sub_category", "activity_description", "is_subscription"]
ROLLUP = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("transaction_date", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("activity_description", T.StringType()),
        T.StructField("is_subscription", T.BooleanType()),
        T.StructField("sign", T.IntegerType()),
        T.StructField("amount_spent", T.DecimalType(28, 2)),
        T.StructField("n_rows", T.LongType()),
        T.StructField("user_bucket", T.IntegerType()),
    ]
)


def daily_rollup(rows: DataFrame) -> DataFrame:
    """The rollup of transactions with their user bucket."""
    amount = F.col("amount_spent")
    sign = F.when(amount > 0, 1).when(amount < 0, -1).otherwise(0).cast("int")
    day = F.date_trunc("day", F.col("transaction_date")).cast("timestamp_ntz")
    return (
        rows.withColumns({"transaction_date": day, "sign": sign})
        .groupBy(*KEYS, "sign", "user_bucket")
        .agg(F.sum("amount_spent").cast("decimal(28,2)").alias("amount_spent"), F.count(F.lit(1)).alias("n_rows"))
        .select(*ROLLUP.fieldNames())
    )


def merged_rollup(parts: DataFrame) -> DataFrame:
    """Rollup rows of several batches added up."""
    return (
        parts.groupBy(*KEYS, "sign", "user_bucket")
        .agg(F.sum("amount_spent").cast("decimal(28,2)").alias("amount_spent"), F.sum("n_rows").alias("n_rows"))
        .select(*ROLLUP.fieldNames())
    )


def rollup_rows(parts: DataFrame) -> DataFrame:
    """Rollup rows as the dashboard's functions take them, with the calendar columns. A key that came
    in several batches is as many rows: the functions add up amounts and ``n_rows``, so their own
    aggregates merge it, and the rollup is not shuffled by its whole key first."""
    return add_calendar_features(parts.select(*ROLLUP.fieldNames()))
