"""Dashboard analytics over the transactions table, for all users at once.

Every function takes ``by``: the grouping prefix. ``by=["user_id"]`` computes each user's
figures in one job (the per-user dashboard); ``by=[]`` computes one figure for the whole
input. Money is summed as DECIMAL (exact, order independent) and cast to DOUBLE last.

Sign convention: positive amount = expense, negative = payment or return; zero and null
amounts are neither, but their days still count as active days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.format import balance_caption, currency, transaction_label

EXPENSES, PAYMENTS = "Expenses", "Payments"


def _amt() -> Column:
    return F.col("amount_spent")


def _n_rows(df: DataFrame) -> Column:
    """Number of transactions: rows, or what rollup rows stand for (``operators.rollup``)."""
    return F.sum("n_rows") if "n_rows" in df.columns else F.count(F.lit(1))


def _money(c: Column) -> Column:
    return c.cast("double")


def period_filter(df: DataFrame, years: Sequence[int] | None = None, months: Sequence[str] | None = None) -> DataFrame:
    """Rows whose year and month name are both selected.

    ``None`` selects every value (rows without a date still drop out, as a null year never
    matches); an empty selection yields no rows. On a table partitioned by ``year`` the year
    predicate prunes directories.
    """
    cond = F.col("year").isNotNull() & F.col("month_name").isNotNull()
    if years is not None:
        cond = cond & (F.col("year").isin(list(years)) if len(years) else F.lit(False))
    if months is not None:
        cond = cond & (F.col("month_name").isin(list(months)) if len(months) else F.lit(False))
    return df.filter(cond)


def expenses(df: DataFrame) -> DataFrame:
    return df.filter(_amt() > 0)


def payments(df: DataFrame) -> DataFrame:
    """Negative amounts, made positive."""
    return df.filter(_amt() < 0).withColumn("amount_spent", F.abs(_amt()))


def with_kind(df: DataFrame) -> DataFrame:
    """Expenses and payments side by side: ``kind`` plus the positive ``value``."""
    kind = F.when(_amt() > 0, F.lit(EXPENSES)).when(_amt() < 0, F.lit(PAYMENTS))
    return df.withColumn("kind", kind).withColumn("value", F.abs(_amt())).filter(F.col("kind").isNotNull())


def _rank_top(df: DataFrame, k: int, by: Sequence[str], order: list[Column]) -> DataFrame:
    """Keep the first ``k`` rows per ``by`` group in ``order`` and number them 1..k.

    Per group: ``row_number() <= k`` (planned with a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most k rows per map task). Whole input: ordered limit
    (TakeOrderedAndProject), then numbering of the k survivors.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))


def _share(value: str, by: Sequence[str]) -> Column:
    """value / total of value within ``by``, on already aggregated rows (few rows per group).

    ``value`` is a DECIMAL sum, so the total is exact; the division is done in DOUBLE.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    total = _money(F.sum(F.col(value)).over(w))
    return F.when(total != 0, _money(F.col(value)) / total).otherwise(F.lit(None).cast("double"))


# --------------------------------------------------------------------------- overview

def overview(df: DataFrame, by: Sequence[str] = (), approx_days: bool = False) -> DataFrame:
    """Active days, total spending/payments, balance and average daily figures.

    Two-level aggregation instead of ``countDistinct``: first per (by, day) - the partial
    aggregate collapses each map task's rows to one per day, so a hot user is spread over
    its days - then per ``by`` over the day rows. ``approx_days=True`` counts days with
    ``approx_count_distinct`` (HyperLogLog++) in a single aggregation instead.
    """
    by = list(by)
    if approx_days:
        agg = df.groupBy(*by).agg(
            F.approx_count_distinct(F.to_date("transaction_date")).alias("active_days"),
            F.coalesce(F.sum(F.when(_amt() > 0, _amt())), F.lit(0)).alias("_spend"),
            F.coalesce(F.sum(F.when(_amt() < 0, -_amt())), F.lit(0)).alias("_pay"),
        )
    else:
        daily = df.groupBy(*by, F.to_date("transaction_date").alias("_day")).agg(
            F.sum(F.when(_amt() > 0, _amt())).alias("_spend"),
            F.sum(F.when(_amt() < 0, -_amt())).alias("_pay"),
        )
        agg = daily.groupBy(*by).agg(
            F.count("_day").alias("active_days"),
            F.coalesce(F.sum("_spend"), F.lit(0)).alias("_spend"),
            F.coalesce(F.sum("_pay"), F.lit(0)).alias("_pay"),
        )
    days = F.col("active_days")
    return agg.select(
        *by,
        days,
        _money(F.col("_spend")).alias("total_spending"),
        _money(F.col("_pay")).alias("total_payments"),
        _money(F.col("_spend") - F.col("_pay")).alias("balance"),
        F.when(days > 0, _money(F.col("_spend")) / days).otherwise(F.lit(0.0)).alias("avg_daily_spend"),
        F.when(days > 0, _money(F.col("_pay")) / days).otherwise(F.lit(0.0)).alias("avg_daily_payments"),
    )


def overview_cards(ov: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The five card texts of an ``overview`` result."""
    return ov.select(
        *by,
        currency(F.col("total_spending")).alias("total_spending_text"),
        currency(F.col("total_payments")).alias("total_payments_text"),
        currency(F.col("balance")).alias("balance_text"),
        balance_caption(F.col("balance")).alias("balance_caption"),
        currency(F.col("avg_daily_spend")).alias("avg_daily_spend_text"),
        currency(F.col("avg_daily_payments")).alias("avg_daily_payments_text"),
    )


# --------------------------------------------------------------------------- top-k

def top_transactions(df: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The k largest expenses (ties by transaction id) with a ``MERCHANT (Mon dd)`` label."""
    order = [_amt().desc(), F.col("transaction_id").asc()]
    top = _rank_top(expenses(df), k, list(by), order)
    return top.select(
        *by,
        "rank",
        "transaction_id",
        F.to_date("transaction_date").alias("transaction_date"),
        "activity_description",
        "category",
        _money(_amt()).alias("amount_spent"),
        transaction_label(F.col("activity_description"), F.col("transaction_date")).alias("label"),
    )


def subcategory_top(df: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Top-k sub-categories by spending; share is of the top-k sum (what the pie shows)."""
    by = list(by)
    sums = (
        expenses(df)
        .filter(F.col("sub_category").isNotNull())
        .groupBy(*by, "sub_category")
        .agg(F.sum(_amt()).alias("_total"))
    )
    top = _rank_top(sums, k, by, [F.col("_total").desc(), F.col("sub_category").asc()])
    return top.select(
        *by, "rank", "sub_category", _money(F.col("_total")).alias("total_spent"), _share("_total", by).alias("share")
    )


def top_merchants(df: DataFrame, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent merchants among expenses (ties by name)."""
    by = list(by)
    counts = (
        expenses(df)
        .filter(F.col("activity_description").isNotNull())
        .groupBy(*by, F.col("activity_description").alias("merchant"))
        .agg(_n_rows(df).alias("transaction_count"))
    )
    return _rank_top(counts, k, by, [F.col("transaction_count").desc(), F.col("merchant").asc()]).select(
        *by, "rank", "merchant", "transaction_count"
    )


# --------------------------------------------------------------------------- group totals

def category_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    sums = (
        expenses(df)
        .filter(F.col("category").isNotNull())
        .groupBy(*by, "category")
        .agg(F.sum(_amt()).alias("_total"), _n_rows(df).alias("n_transactions"))
    )
    return sums.select(
        *by, "category", _money(F.col("_total")).alias("total_spent"), "n_transactions", _share("_total", by).alias("share")
    )


def daily_series(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily spending and daily payments on one date axis; a series is null on days it lacks."""
    by = list(by)
    return (
        df.filter(F.col("transaction_date").isNotNull())
        .groupBy(*by, F.to_date("transaction_date").alias("transaction_date"))
        .agg(
            _money(F.sum(F.when(_amt() > 0, _amt()))).alias("daily_spending"),
            _money(F.sum(F.when(_amt() < 0, -_amt()))).alias("daily_payments"),
        )
        .filter(F.col("daily_spending").isNotNull() | F.col("daily_payments").isNotNull())
    )


def monthly_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals by month name (the same month of different years adds up), per kind."""
    by = list(by)
    return (
        with_kind(df)
        .filter(F.col("month").isNotNull() & F.col("month_name").isNotNull())
        .groupBy(*by, "kind", F.col("month").alias("month_no"), "month_name")
        .agg(_money(F.sum("value")).alias("total"))
    )


def weekday_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals by weekday name, Sunday = 1, per kind."""
    by = list(by)
    return (
        with_kind(df)
        .filter(F.col("transaction_date").isNotNull() & F.col("day_of_week").isNotNull())
        .groupBy(*by, "kind", F.dayofweek("transaction_date").cast("int").alias("dow_no"), "day_of_week")
        .agg(_money(F.sum("value")).alias("total"))
    )


MAGNITUDES = 64


def subscription_costs(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Subscription spending per merchant over the whole selection, with ``rank`` (1 = largest).

    Per group a window numbers its merchants. Without groups all merchants are one list: each is
    numbered within its magnitude, behind the counts of the greater magnitudes, not in one task.
    There are at most ``MAGNITUDES`` per power of ten, so their counts may be broadcast."""
    by = list(by)
    sums = (
        expenses(df)
        .filter(F.col("is_subscription") & F.col("activity_description").isNotNull())
        .groupBy(*by, "activity_description")
        .agg(F.sum(_amt()).alias("_total"))
    )
    order = [F.col("_total").desc(), F.col("activity_description").asc()]
    if by:
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    else:
        sums = sums.withColumn("_size", F.floor(F.log10(F.col("_total").cast("double")) * MAGNITUDES).cast("int"))
        above = sums.groupBy("_size").agg(F.count(F.lit(1)).alias("_n")).select(
            "_size", (F.sum("_n").over(Window.orderBy(F.col("_size").desc())) - F.col("_n")).alias("_above")
        )
        within = F.row_number().over(Window.partitionBy("_size").orderBy(*order))
        ranked = sums.withColumn("_at", within).join(F.broadcast(above), "_size").withColumn("rank", F.col("_above") + F.col("_at"))
    return ranked.select(*by, "rank", "activity_description", _money(F.col("_total")).alias("amount_spent"))


def available_years(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The years with rows, with ``rank`` in ascending order; a list of years is short."""
    years = df.select(*by, "year").filter(F.col("year").isNotNull()).distinct()
    w = Window.partitionBy(*by).orderBy("year")
    return years.select(*by, F.row_number().over(w).alias("rank"), "year")


def available_months(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return (
        df.select(*by, F.col("month").alias("month_no"), "month_name")
        .filter(F.col("month_no").isNotNull() & F.col("month_name").isNotNull())
        .distinct()
    )
