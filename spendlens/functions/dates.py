"""Calendar features from a transaction timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_calendar_features(df: DataFrame, col: str = "transaction_date") -> DataFrame:
    """year, month, day, month_name (``January``) and day_of_week (``Sunday``); null date -> nulls."""
    d = F.col(col)
    return df.withColumns(
        {
            "month": F.month(d).cast("int"),
            "day": F.dayofmonth(d).cast("int"),
            "month_name": F.date_format(d, "MMMM"),
            "day_of_week": F.date_format(d, "EEEE"),
            "year": F.year(d).cast("int"),
        }
    )
