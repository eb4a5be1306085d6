"""Running totals and numbering per group that stay balanced when one group is very large.

Normal groups: one window over (group; day, id), a single shuffle of the rows. A group with more
than ``hot_rows`` rows would be one task's work; the hot groups (few by construction, see
``hot_keys``) are cut into chunks (calendar day x ``id div chunk_rows``), which keeps the
(day, id) order, and their prefix sum is built in three levels:

1. chunk totals (a partial aggregate per map task),
2. per group, the running sum of *day* totals (one row per day: bounded by the calendar),
   and per (group, day), the running sum of chunk totals (rows per day / chunk_rows),
3. per chunk (at most ``chunk_rows`` rows), the running sum of the rows, plus the offset of
   the previous days and chunks.

A null value counts as zero; null group keys are a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.skew import MAX_HOT_KEYS
from spendlens.session import checkpoint_root

_LAST_DAY = "9999-12-31"  # undated rows sort after every date (SQL's NULLS LAST)


HOT_ROWS = 1_000_000


def hot_keys(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups with more than ``max(hot_rows, rows / MAX_HOT_KEYS)`` rows: at most MAX_HOT_KEYS,
    so their list may be broadcast. Written to the checkpoint folder, as it is used twice."""
    checkpoint_root(df.sparkSession)
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.filter(F.col("_n") > max(hot_rows, total // MAX_HOT_KEYS)).drop("_n")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_h_{k}"]) for k in keys])


def _named(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_h_{k}" for k in keys})


def running_sum(
    df: DataFrame,
    value: str,
    by: list[str],
    date_col: str,
    id_col: str,
    out: str,
    first_of: list[str] | None = None,
    chunk_rows: int = 4096,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``by`` in (date, id) order.

    ``first_of`` columns get the value of the group's first row as ``first_<name>``.
    ``id_col`` must be unique within a group. The result does not depend on ``chunk_rows`` or
    ``hot_rows``.
    """
    first_of = first_of or []
    day = F.coalesce(F.to_date(date_col), F.lit(_LAST_DAY).cast("date"))
    rows = df.withColumns({"_rd": day, "_rv": F.coalesce(F.col(value), F.lit(0))})
    w = Window.partitionBy(*by).orderBy("_rd", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def plain(part: DataFrame) -> DataFrame:
        firsts = {f"first_{c}": F.first(c).over(w) for c in first_of}
        return part.withColumns({out: F.sum("_rv").over(w), **firsts}).drop("_rd", "_rv")

    hot = hot_keys(df, by, hot_rows)
    if hot.isEmpty():
        return plain(rows)
    hot = F.broadcast(_named(hot, by))
    normal = plain(rows.join(hot, _same(rows, hot, by), "left_anti"))
    chunked = _chunked_sum(rows.join(hot, _same(rows, hot, by), "left_semi"), by, id_col, out, first_of, chunk_rows)
    return normal.unionByName(chunked)


def _chunked_sum(rows: DataFrame, by: list[str], id_col: str, out: str, first_of: list[str], chunk_rows: int) -> DataFrame:
    rows = rows.withColumn("_rb", F.floor(F.col(id_col) / chunk_rows).cast("long"))
    keys = [*by, "_rd", "_rb"]

    # One scalar min_by per carried column (struct buffers would force a sort-based
    # aggregate; scalar ones keep the hash aggregate with map-side partials).
    chunks = rows.groupBy(*keys).agg(
        F.sum("_rv").alias("_cs"), *[F.min_by(c, F.col(id_col)).alias(f"_cf_{c}") for c in first_of]
    )
    days = chunks.groupBy(*by, "_rd").agg(
        F.sum("_cs").alias("_ds"), *[F.min_by(f"_cf_{c}", F.col("_rb")).alias(f"_df_{c}") for c in first_of]
    )
    w_day = Window.partitionBy(*by).orderBy("_rd")
    whole = w_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    days = days.select(
        *by, "_rd",
        F.coalesce(F.sum("_ds").over(w_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_doff"),
        *[F.first(f"_df_{c}").over(whole).alias(f"first_{c}") for c in first_of],
    )
    w_chunk = Window.partitionBy(*by, "_rd").orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*keys, F.coalesce(F.sum("_cs").over(w_chunk), F.lit(0)).alias("_coff"))
    days = _named(days, [*by, "_rd"])
    offsets = chunks.join(days, _same(chunks, days, [*by, "_rd"])).select(
        *keys, (F.col("_doff") + F.col("_coff")).alias("_off"), *[f"first_{c}" for c in first_of]
    )

    w_row = Window.partitionBy(*keys).orderBy(id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = _named(offsets, keys)
    res = rows.join(offsets, _same(rows, offsets, keys)).withColumn(out, F.col("_off") + F.sum("_rv").over(w_row))
    return res.drop("_rd", "_rb", "_rv", "_off", *[f"_h_{k}" for k in keys])


def running_available_credit(tx: DataFrame, by: list[str] | None = None, chunk_rows: int = 4096,
                             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Available credit after each transaction (X8): the first row keeps the statement
    value; each later row adds its own amount to the previous row's value, i.e.
    ``first available + running sum(amount) - first amount``. A missing amount changes nothing;
    without the first row's available credit the user's values are unknown (null)."""
    by = ["user_id"] if by is None else by
    r = running_sum(tx, "amount_spent", by, "transaction_date", "transaction_id", "_run",
                    first_of=["available_credit", "amount_spent"], chunk_rows=chunk_rows, hot_rows=hot_rows)
    value = F.col("first_available_credit") + F.col("_run") - F.coalesce("first_amount_spent", F.lit(0))
    return r.withColumn("running_available_credit", value).drop("_run", "first_available_credit", "first_amount_spent")


def numbered_parts(df: DataFrame, key: list[str], max_rows: int, date_col: str = "transaction_date",
                   id_col: str = "transaction_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``ordinal`` (1, 2, ... per ``key`` in (date, id) order) and ``part``
    (``(ordinal - 1) div max_rows``): consecutive parts of exactly ``max_rows`` rows, the last one
    shorter. A key of at most ``max_rows`` rows is one part."""
    numbered = running_sum(df.withColumn("_one", F.lit(1)), "_one", key, date_col, id_col, "ordinal", hot_rows=hot_rows)
    return numbered.drop("_one").withColumn("part", F.floor((F.col("ordinal") - 1) / max_rows).cast("long"))
