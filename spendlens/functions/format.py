"""Presentation strings computed in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def currency(x: Column) -> Column:
    """``$1,234.50``; negatives read ``$-1,234.50`` (half-even rounding of the double value)."""
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), 2))


def balance_caption(balance: Column) -> Column:
    """``+$12.00 (Owing)`` when positive, ``+$0.00 (Credit)`` at zero, ``$-3.00 (Credit)`` below."""
    b = balance.cast("double")
    return F.concat(
        F.when(b >= 0, F.lit("+")).otherwise(F.lit("")),
        currency(b),
        F.when(b > 0, F.lit(" (Owing)")).otherwise(F.lit(" (Credit)")),
    )


def transaction_label(desc: Column, date: Column) -> Column:
    """``UBER (Jan 07)``; null when either part is null."""
    return F.concat(desc, F.lit(" ("), F.date_format(date, "MMM dd"), F.lit(")"))
