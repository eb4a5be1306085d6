"""Schemas and fixed dimension values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the semantics being reproduced; kept in natural order)
# ---------------------------------------------------------------------------

# Category guide: category -> sub-categories.
TAXONOMY = [
    ("Living Expenses", ["Rent", "Utilities", "Groceries", "Dining Out", "Transportation"]),
    ("Personal & Lifestyle", ["Clothing", "Personal Care", "Entertainment", "Fitness", "Travel"]),
    ("Financial", ["Loan Payments", "Credit Card Payments", "Savings", "Insurance", "Bank Fees"]),
    ("Healthcare", ["Doctor Visits", "Pharmacy", "Dental", "Vision"]),
    ("Subscriptions", ["Streaming", "Software", "Memberships"]),
    ("Amazon", ["Amazon"]),
    ("Other", ["Other"]),
]

# Calendar orders: months January-first, weekdays Sunday-first.
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
WEEKDAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Lower-cased texts read as a true subscription flag.
TRUTHY = ["true", "1", "t", "y", "yes"]

# Placeholders of the row key for missing parts.
NO_DATE, NO_DESC, NO_AMOUNT = "no_date", "no_desc", "no_amount"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# Field order of one raw extraction record (all text before typing).
RAW_FIELDS = [
    "customer_id", "f_name", "l_name", "address", "transaction_date", "posting_date",
    "activity_description", "category", "sub_category", "amount_spent", "credit_limit",
    "available_credit", "is_subscription",
]
RAW_RECORD = T.StructType([T.StructField(f, T.StringType(), True) for f in RAW_FIELDS])
RAW_ARRAY = T.ArrayType(RAW_RECORD)

MONEY = T.DecimalType(18, 2)

# Columns written to the transactions table after user_id, in table order.
INSERT_COLUMNS = [
    "customer_id", "f_name", "l_name", "address", "transaction_date", "posting_date",
    "activity_description", "category", "sub_category", "amount_spent", "credit_limit",
    "available_credit", "is_subscription", "month", "day", "month_name", "day_of_week", "year",
]

TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("f_name", T.StringType()),
        T.StructField("l_name", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("transaction_date", T.TimestampNTZType()),
        T.StructField("posting_date", T.TimestampNTZType()),
        T.StructField("activity_description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("amount_spent", MONEY),
        T.StructField("credit_limit", MONEY),
        T.StructField("available_credit", MONEY),
        T.StructField("is_subscription", T.BooleanType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("month_name", T.StringType()),
        T.StructField("day_of_week", T.StringType()),
        T.StructField("year", T.IntegerType()),
    ]
)
TX_COLUMNS = [f.name for f in TRANSACTIONS.fields]

USERS = T.StructType(
    [
        T.StructField("user_id", T.LongType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("display_name", T.StringType()),
        T.StructField("picture_url", T.StringType()),
    ]
)

# Declared text lengths of the stored columns (characters).
TEXT_LIMITS = {
    "customer_id": 255, "f_name": 100, "l_name": 100, "address": 500,
    "category": 100, "sub_category": 100, "month_name": 20, "day_of_week": 20,
}
USER_TEXT_LIMITS = {"email": 255, "display_name": 255}


def taxonomy_df(spark: SparkSession) -> DataFrame:
    """The (category, sub_category) guide as a 24-row dimension (fixed size, safe to broadcast)."""
    rows = [(c, s) for c, subs in TAXONOMY for s in subs]
    return spark.createDataFrame(rows, "category string, sub_category string")


def month_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, m) for i, m in enumerate(MONTH_NAMES)], "month_no int, month_name string"
    )


def weekday_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i + 1, d) for i, d in enumerate(WEEKDAY_NAMES)], "dow_no int, day_of_week string"
    )
