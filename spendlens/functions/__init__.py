"""Column-level functions (all native Spark expressions, no Python UDFs)."""

from spendlens.functions.clean import (
    clean_transactions,
    parse_bool,
    parse_date,
    parse_money,
    strip_column_names,
    utrim,
)
from spendlens.functions.dates import add_calendar_features
from spendlens.functions.format import balance_caption, currency, transaction_label
from spendlens.functions.keys import dedup_key, norm_desc
from spendlens.functions.text import strip_fences

__all__ = [
    "add_calendar_features", "balance_caption", "clean_transactions", "currency", "dedup_key",
    "norm_desc", "parse_bool", "parse_date", "parse_money", "strip_column_names", "strip_fences",
    "transaction_label", "utrim",
]
