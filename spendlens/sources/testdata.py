"""The driver's TPC-H-like tables seen as a card-transactions table.

``orders`` is the transaction, ``customer`` the card holder, ``nation`` the address and
``part`` the merchant: ``p_partkey = o_orderkey mod count(part)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.dates import add_calendar_features
from spendlens.operators.running import numbered_parts
from spendlens.schema import MONEY, TX_COLUMNS
from spendlens.sources.extraction import DOCUMENT_ROWS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tx_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy plan of the transactions table built from orders/customer/nation/part.

    Join strategies are left to Catalyst and AQE: ``customer`` and ``part`` grow with the
    scale factor and are broadcast only when their measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``; ``nation`` is a fixed 25-row dimension.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    n_part = part.select(F.count(F.lit(1))).scalar()  # uncorrelated scalar subquery, run once

    day = F.to_date("o_orderdate")
    amount = F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    tx = (
        orders.withColumn("merchant_key", F.pmod(F.col("o_orderkey"), n_part))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(part, F.col("merchant_key") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("c_name").alias("customer_id"),
            F.substring_index("c_name", "#", 1).alias("f_name"),
            F.substring_index("c_name", "#", -1).alias("l_name"),
            F.col("n_name").alias("address"),
            day.cast("timestamp_ntz").alias("transaction_date"),
            F.date_add(day, 1).cast("timestamp_ntz").alias("posting_date"),
            F.upper("p_name").alias("activity_description"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("sub_category"),
            amount.cast(MONEY).alias("amount_spent"),
            F.abs("c_acctbal").cast(MONEY).alias("credit_limit"),
            F.col("c_acctbal").cast(MONEY).alias("available_credit"),
            (F.col("p_size") <= 5).alias("is_subscription"),
        )
    )
    return add_calendar_features(tx).select(*TX_COLUMNS)


# SQL text of the same mapping, for DuckDB oracles (a CTE named ``tx``).
TX_SQL = """
tx AS (
  SELECT
    o.o_orderkey AS transaction_id,
    o.o_custkey AS user_id,
    c.c_name AS customer_id,
    split_part(c.c_name, '#', 1) AS f_name,
    split_part(c.c_name, '#', 2) AS l_name,
    n.n_name AS address,
    CAST(CAST(o.o_orderdate AS DATE) AS TIMESTAMP) AS transaction_date,
    CAST(CAST(o.o_orderdate AS DATE) + 1 AS TIMESTAMP) AS posting_date,
    upper(p.p_name) AS activity_description,
    p.p_type AS category,
    p.p_brand AS sub_category,
    CAST(CASE WHEN o.o_orderstatus = 'P' THEN -o.o_totalprice ELSE o.o_totalprice END AS DECIMAL(18,2)) AS amount_spent,
    CAST(abs(c.c_acctbal) AS DECIMAL(18,2)) AS credit_limit,
    CAST(c.c_acctbal AS DECIMAL(18,2)) AS available_credit,
    p.p_size <= 5 AS is_subscription,
    CAST(month(o.o_orderdate) AS INTEGER) AS month,
    CAST(day(o.o_orderdate) AS INTEGER) AS day,
    monthname(o.o_orderdate) AS month_name,
    dayname(o.o_orderdate) AS day_of_week,
    CAST(year(o.o_orderdate) AS INTEGER) AS year
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
)
"""


# ---------------------------------------------------------------------------
# Ingest scenarios over the same tables (whole tables, split by date)
# ---------------------------------------------------------------------------

# Stored history ends before HISTORY_END; the new upload starts at UPLOAD_START, so the
# statements of the year in between are uploaded a second time.
HISTORY_END = "1998-01-01"
UPLOAD_START = "1997-01-01"


def raw_upload(tx: DataFrame) -> DataFrame:
    """Rows of ``tx`` as an extraction delivers them: all text, dates ``MM-dd-yyyy``,
    descriptions lower-cased and padded (as a re-upload may spell them), plus the uploader id."""
    def txt(c):
        return F.col(c).cast("string")

    return tx.select(
        F.col("user_id"),
        txt("customer_id").alias("customer_id"),
        txt("f_name").alias("f_name"),
        txt("l_name").alias("l_name"),
        txt("address").alias("address"),
        F.date_format("transaction_date", "MM-dd-yyyy").alias("transaction_date"),
        F.date_format("posting_date", "MM-dd-yyyy").alias("posting_date"),
        F.concat(F.lit(" "), F.lower("activity_description"), F.lit("\t")).alias("activity_description"),
        txt("category").alias("category"),
        txt("sub_category").alias("sub_category"),
        txt("amount_spent").alias("amount_spent"),
        txt("credit_limit").alias("credit_limit"),
        txt("available_credit").alias("available_credit"),
        txt("is_subscription").alias("is_subscription"),
    )


def history_part(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("transaction_date") < F.lit(HISTORY_END).cast("timestamp_ntz"))


def upload_part(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("transaction_date") >= F.lit(UPLOAD_START).cast("timestamp_ntz"))


def _email(name_col):
    return F.concat(F.lower(F.regexp_replace(name_col, "#", ".")), F.lit("@example.com"))


def users_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users known before HISTORY_END: every customer with an earlier order."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    early = orders.filter(F.col("o_orderdate") < F.lit(HISTORY_END).cast("timestamp_ntz")).select(
        F.col("o_custkey").alias("c_custkey")
    )
    return customer.join(early, "c_custkey", "left_semi").select(
        F.col("c_custkey").alias("user_id"),
        _email(F.col("c_name")).alias("email"),
        F.col("c_name").alias("display_name"),
        F.concat(F.lit("https://img.example.com/"), F.col("c_custkey").cast("string"), F.lit(".png")).alias("picture_url"),
    )


def customer_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The email of every customer, whether a known user or not."""
    return read_table(spark, sf_dir, "customer").select(_email(F.col("c_name")).alias("email"))


def user_updates_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins from HISTORY_END on: one profile update per order (seq = order key); the
    picture is missing on orders with status P."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer")
    late = orders.filter(F.col("o_orderdate") >= F.lit(HISTORY_END).cast("timestamp_ntz"))
    return late.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        _email(F.col("c_name")).alias("email"),
        F.concat(F.col("c_name"), F.lit(" ("), F.col("o_orderpriority"), F.lit(")")).alias("display_name"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://img.example.com/"), F.col("c_custkey").cast("string"), F.lit("/"),
                            F.col("o_orderkey").cast("string"), F.lit(".png")))
        .alias("picture_url"),
        F.col("o_orderkey").alias("seq"),
    )


def raw_orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders rendered as messy extraction text: several date layouts, signs, thousands
    separators, currency marks, flag spellings and padded text."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    price = F.col("o_totalprice").cast(MONEY).cast("string")
    shape = F.pmod(k, F.lit(8))
    date_txt = (
        F.when(shape == 0, F.date_format(d, "MM-dd-yyyy"))
        .when(shape == 1, F.concat(F.lit(" "), F.date_format(d, "M-d-yyyy")))
        .when(shape == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(shape == 3, F.date_format(d, "dd-MM-yyyy"))
        .when(shape == 4, F.lit(""))
        .when(shape == 5, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T10:20:30.000")))
        .when(shape == 6, F.date_format(d, "M/d/yyyy"))
        .otherwise(F.date_format(d, "MMM d, yyyy"))
    )
    amount_txt = (
        F.when(F.pmod(k, 6) == 0, price)
        .when(F.pmod(k, 6) == 1, F.format_number(F.col("o_totalprice"), 2))
        .when(F.pmod(k, 6) == 2, F.concat(F.lit("+"), price))
        .when(F.pmod(k, 6) == 3, F.concat(F.lit("$"), price))
        .when(F.pmod(k, 6) == 4, F.concat(price, F.lit("e0")))
        .otherwise(F.concat(F.lit(" -"), price, F.lit(" ")))
    )
    flag_txt = F.element_at(
        F.array(*[F.lit(x) for x in ["true", "TRUE", " true", "1", "yes", "no", "0"]]), (F.pmod(k, 7) + 1).cast("int")
    )
    return o.select(
        k.alias("transaction_id"),
        date_txt.alias("transaction_date"),
        amount_txt.alias("amount_spent"),
        flag_txt.alias("is_subscription"),
        F.concat(F.lit(" \t"), F.col("o_orderpriority"), F.lit(" \n")).alias("activity_description"),
    )


# ---------------------------------------------------------------------------
# Event uploads for the incremental-ingest job
# ---------------------------------------------------------------------------

# The first upload covers events before FIRST_UPLOAD_END (one document per user and day);
# the second covers events from SECOND_UPLOAD_START on (one document per user and week),
# so the days in between arrive twice in differently cut documents.
FIRST_UPLOAD_END = "2024-01-21"
SECOND_UPLOAD_START = "2024-01-15"


def event_records(events: DataFrame) -> DataFrame:
    """Events as extraction records of the event's user (purchases are subscriptions)."""
    return events.select(
        "user_id",
        "ts",
        "event_id",
        F.struct(
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("customer_id"),
            F.lit("user").alias("f_name"),
            F.col("user_id").cast("string").alias("l_name"),
            F.lit("").alias("address"),
            F.date_format("ts", "MM-dd-yyyy").alias("transaction_date"),
            F.date_format("ts", "MM-dd-yyyy").alias("posting_date"),
            F.upper("event_type").alias("activity_description"),
            F.lit("Other").alias("category"),
            F.lit("Other").alias("sub_category"),
            F.col("value").cast(MONEY).cast("string").alias("amount_spent"),
            F.lit("").alias("credit_limit"),
            F.lit("").alias("available_credit"),
            (F.col("event_type") == "purchase").cast("string").alias("is_subscription"),
        ).alias("_r"),
    )


def event_documents(events: DataFrame, period: str, max_rows: int = DOCUMENT_ROWS) -> DataFrame:
    """Fenced JSON documents of events per (user, ``period``) with records in time order, in
    consecutive parts of at most ``max_rows`` records: (doc_id, user_id, text)."""
    recs = event_records(events).withColumn("_p", F.date_trunc(period, "ts"))
    recs = numbered_parts(recs, ["user_id", "_p"], max_rows, "ts", "event_id")
    grouped = recs.groupBy("user_id", "_p", "part").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "_r"))).alias("_items")
    )
    return grouped.select(
        F.concat_ws("-", F.lit(period), F.col("user_id").cast("string"), F.date_format("_p", "yyyyMMdd"),
                    F.col("part").cast("string")).alias("doc_id"),
        "user_id",
        F.concat(F.lit("```json\n"), F.to_json(F.transform("_items", lambda x: x["_r"])), F.lit("\n```")).alias("text"),
    )


def event_uploads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = read_table(spark, sf_dir, "events")
    first = ev.filter(F.col("ts") < F.lit(FIRST_UPLOAD_END).cast("timestamp_ntz"))
    second = ev.filter(F.col("ts") >= F.lit(SECOND_UPLOAD_START).cast("timestamp_ntz"))
    return event_documents(first, "day"), event_documents(second, "week")
