"""Recurring charges as a state that is added to, instead of a scan of the history.

A state row holds what ``recurring_merchants`` needs of a (user, merchant): its months, count, sum,
least and greatest amount. All of these merge, so a batch writes the state of its own rows, and
the state of everything is the merge of the batches' rows: far fewer than the transactions, in
folders by user bucket, so that the state of some users is read from their folders alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.skew import join_back
from spendlens.schema import MONEY

KEYS = ["user_id", "merchant"]
STATE = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("merchant", T.StringType()),
        T.StructField("months", T.ArrayType(T.IntegerType())),  # year * 12 + month - 1
        T.StructField("n_transactions", T.LongType()),
        T.StructField("total", T.DecimalType(38, 2)),
        T.StructField("least", MONEY),
        T.StructField("greatest", MONEY),
        T.StructField("user_bucket", T.IntegerType()),
    ]
)


def batch_state(rows: DataFrame) -> DataFrame:
    """State rows of transactions with their user bucket (expenses with a merchant only)."""
    day = F.to_date("transaction_date")
    exp = rows.filter((F.col("amount_spent") > 0) & F.col("activity_description").isNotNull())
    return exp.groupBy("user_id", F.col("activity_description").alias("merchant"), "user_bucket").agg(
        # a missing date is no month
        F.collect_set((F.year(day) * 12 + F.month(day) - 1).cast("int")).alias("months"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.sum("amount_spent").cast("decimal(38,2)").alias("total"),
        F.min("amount_spent").alias("least"),
        F.max("amount_spent").alias("greatest"),
    ).select(*STATE.fieldNames())


def merged_state(state: DataFrame, min_months: int = 3, tolerance_pct: int = 5, verdict: bool = True) -> DataFrame:
    """One state row per (user, merchant), with ``is_recurring`` by the rule of ``recurring_merchants``.
    One aggregate over one read of the state; a key gathers one array of months per batch."""
    merged = state.groupBy(*KEYS, "user_bucket").agg(
        F.array_distinct(F.flatten(F.collect_list("months"))).alias("months"),
        F.sum("n_transactions").alias("n_transactions"), F.sum("total").cast("decimal(38,2)").alias("total"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
    ).select(*STATE.fieldNames())
    if not verdict:
        return merged
    steady = (F.col("greatest") - F.col("least")) * F.col("n_transactions") * 100 <= F.lit(tolerance_pct) * F.col("total")
    return merged.withColumn("is_recurring", (F.size("months") >= min_months) & steady)


def with_recurring(tx: DataFrame, state: DataFrame) -> DataFrame:
    """``tx`` with ``is_recurring`` of each expense's (user, merchant), by a state that counted
    these rows; hot pairs are split over several tasks (``skew.join_back``)."""
    per_key = state.select("user_id", F.col("merchant").alias("activity_description"), F.col("is_recurring").alias("_rec"),
                           F.col("n_transactions").alias("_n"))
    eligible = (F.col("amount_spent") > 0) & F.col("activity_description").isNotNull()
    out = join_back(tx, per_key, ["user_id", "activity_description"], "_n", "transaction_id", eligible)
    return out.withColumn("is_recurring", F.coalesce(F.col("_rec") & (F.col("amount_spent") > 0), F.lit(False))).drop("_rec", "_n")
