"""Typing and cleaning of raw transaction records.

``clean_transactions`` is the one entry point: it accepts all-text records (a JSON
extraction) or already typed rows (a stored table) and returns the typed table columns.
It is idempotent, so stored rows can be cleaned again on load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.dates import add_calendar_features
from spendlens.functions.text import utrim
from spendlens.schema import MONEY, TRUTHY

DATE_COLUMNS = ("transaction_date", "posting_date")
MONEY_COLUMNS = ("amount_spent", "credit_limit", "available_credit")
BOOL_COLUMNS = ("is_subscription",)

# Accepted text layouts of a date, tried in order, each with the shape a value must have to
# be tried at all (a failed parse is costly; a shape test is not). Anything else is null.
DATE_FORMATS = (
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("MMM d, yyyy", r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"),
)
# ISO date and time, as the JSON export writes it; read by a cast.
DATE_TIME_RE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"


def parse_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text -> timestamp without time zone; bad or missing values -> null.

    Each row is parsed on its own by its shape (month first, ISO, ISO with a time, named month);
    timestamps and dates pass through.
    """
    if isinstance(dtype, (T.TimestampNTZType,)):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    s = utrim(c.cast("string"))
    parsed = F.coalesce(*[F.when(s.rlike(shape), F.try_to_timestamp(s, F.lit(fmt))) for fmt, shape in DATE_FORMATS])
    timed = F.when(s.rlike(DATE_TIME_RE), s.try_cast("timestamp_ntz"))
    return F.coalesce(parsed.cast("timestamp_ntz"), timed)


def parse_money(c: Column, dtype: T.DataType | None = None) -> Column:
    """Text or number -> DECIMAL(18,2) (half-up); ``1,234.56``, ``$5``, ``(5)``, ``inf``, ``nan`` -> null."""
    if isinstance(dtype, T.DecimalType):
        return c.cast(MONEY)
    if isinstance(dtype, T.NumericType):
        # NaN and infinities have no decimal value and become null.
        return c.try_cast(MONEY)
    return utrim(c.cast("string")).try_cast(MONEY)


def parse_bool(c: Column, dtype: T.DataType | None = None) -> Column:
    """Lower-cased text in {true, 1, t, y, yes} -> true; anything else, or null -> false.

    The text is not trimmed first, so ``' true'`` and ``1.0`` read as false.
    """
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(F.lower(c.cast("string")).isin(*TRUTHY), F.lit(False))


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim column names (done first so a padded name is still typed)."""
    return df.toDF(*[c.strip() for c in df.columns])


def clean_transactions(df: DataFrame) -> DataFrame:
    """Type dates, money and the flag, trim text, and derive calendar features.

    Columns absent from the input are skipped (their features are not derived); unknown
    columns are kept (string ones trimmed).
    """
    df = strip_column_names(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    exprs: dict[str, Column] = {}
    for name in DATE_COLUMNS:
        if name in types:
            exprs[name] = parse_date(F.col(name), types[name])
    for name in MONEY_COLUMNS:
        if name in types:
            exprs[name] = parse_money(F.col(name), types[name])
    for name in BOOL_COLUMNS:
        if name in types:
            exprs[name] = parse_bool(F.col(name), types[name])
    typed = set(exprs)
    for f in df.schema.fields:
        if f.name not in typed and isinstance(f.dataType, T.StringType):
            exprs[f.name] = utrim(F.col(f.name))
    out = df.withColumns(exprs)
    if "transaction_date" in types:
        out = add_calendar_features(out, "transaction_date")
    return out
