"""Row identity used to skip already stored transactions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens.schema import NO_AMOUNT, NO_DATE, NO_DESC
from spendlens.functions.text import utrim


def norm_desc(c: Column) -> Column:
    """Description as compared for duplicates: trimmed and lower-cased."""
    return F.lower(utrim(c))


def dedup_key(date: Column, desc: Column, amount: Column) -> Column:
    """Readable ``YYYY-MM-DD-desc-amount`` key with placeholders for missing parts.

    The key is for display only. Joins compare the three parts null-safely instead, since
    ``-`` both separates the parts and signs the amount (``a``/-5 and ``a-``/5 collide).
    """
    return F.concat_ws(
        "-",
        F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit(NO_DATE)),
        F.coalesce(norm_desc(desc), F.lit(NO_DESC)),
        F.coalesce(amount.cast("decimal(18,2)").cast("string"), F.lit(NO_AMOUNT)),
    )
