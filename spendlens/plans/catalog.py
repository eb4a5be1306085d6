"""Registered queries: key -> ``(spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables (through the stored ``tx`` table or directly) over
their whole extent. Outputs present dates as DATE and money as DOUBLE so the result types
line up with the DuckDB oracle of ``spendlens.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.clean import clean_transactions
from spendlens.functions.dates import add_calendar_features
from spendlens.operators import analytics as A
from spendlens.operators.dedup import add_dedup_key, dedup_report, new_rows, rows_to_insert
from spendlens.operators.enrich import (
    CATEGORY_RULES,
    categorise,
    customer_id,
    flag_recurring,
    normalise_merchant,
    recurring_merchants,
    spending_habits,
    taxonomy_violations,
)
from spendlens.operators.merchants import simplify_merchants
from spendlens.operators.quality import constraint_violations, typing_failures
from spendlens.operators.running import running_available_credit
from spendlens.operators.statement_lines import render_statements, statement_ingest, statement_records, statement_rows
from spendlens.operators.users import upsert_users, user_ids
from spendlens.plans.context import prepare, tx_table
from spendlens.schema import INSERT_COLUMNS
from spendlens.session import scratch_path
from spendlens.sources.extraction import (
    extraction_quarantine,
    extraction_rows,
    json_documents,
    json_payloads,
    json_records,
)
from spendlens.sources.statements import assemble_documents, read_text_documents
from spendlens.sources.tables import (
    assign_ids,
    create_tables,
    drop_tables,
    read_transactions,
    refresh_tables,
    stored_max,
    truncate_tables,
    user_history,
    users_history,
    write_transactions,
    write_users_snapshot,
)
from spendlens.sources.testdata import (
    customer_emails,
    event_documents,
    event_uploads,
    history_part,
    raw_orders_text,
    raw_upload,
    read_table,
    upload_part,
    user_updates_from_tables,
    users_from_tables,
)
from spendlens.sources.user_store import create_user_store, load_user_store, read_user_store, upsert_user_store
from spendlens.streaming.ingest import (
    read_quarantine,
    read_rollup,
    read_with_recurring,
    recurring_state,
    run_ingest_stream,
    run_statement_stream,
)

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the period-filter queries (a user's selection in the dashboard).
PERIOD_YEARS = [1996, 1997]
PERIOD_MONTHS = ["January", "March", "December"]
PER_USER = ["user_id"]


def present(df: DataFrame) -> DataFrame:
    """Timestamps -> DATE, decimals -> DOUBLE (for display and oracle comparison)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.to_date(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's default selection: every dated row."""
    return A.period_filter(tx_table(spark, sf_dir))


def _on_tx(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(_tx(spark, sf_dir))


def q_period_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(A.period_filter(tx_table(spark, sf_dir), PERIOD_YEARS, PERIOD_MONTHS))


def q_period_filter_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present(A.period_filter(tx_table(spark, sf_dir), PERIOD_YEARS, []))


def q_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of every user active in the last 30 days of the data (batch form of S5)."""
    tx = tx_table(spark, sf_dir)
    last = tx.select(F.max("transaction_date")).scalar()
    active = tx.filter(F.col("transaction_date") >= last - F.expr("INTERVAL 30 DAYS")).select("user_id")
    return present(users_history(tx, active))


QUERIES: dict[str, Query] = {
    "category_totals": _on_tx(A.category_totals),
    "category_totals_per_user": _on_tx(lambda d: A.category_totals(d, PER_USER)),
    "subcategory_top10": _on_tx(lambda d: A.subcategory_top(d, 10)),
    "subcategory_top10_per_user": _on_tx(lambda d: A.subcategory_top(d, 10, PER_USER)),
    "overview_kpis": _on_tx(A.overview),
    "overview_kpis_per_user": _on_tx(lambda d: A.overview(d, PER_USER)),
    "overview_cards_text": _on_tx(lambda d: A.overview_cards(A.overview(d, PER_USER), PER_USER)),
    "top10_transactions": _on_tx(lambda d: A.top_transactions(d, 10)),
    "top10_transactions_per_user": _on_tx(lambda d: A.top_transactions(d, 10, PER_USER)),
    "daily_spend_vs_payments": _on_tx(A.daily_series),
    "monthly_totals": _on_tx(A.monthly_totals),
    "monthly_totals_per_user": _on_tx(lambda d: A.monthly_totals(d, PER_USER)),
    "weekday_totals": _on_tx(A.weekday_totals),
    "weekday_totals_per_user": _on_tx(lambda d: A.weekday_totals(d, PER_USER)),
    "top10_merchants": _on_tx(lambda d: A.top_merchants(d, 10)),
    "top10_merchants_per_user": _on_tx(lambda d: A.top_merchants(d, 10, PER_USER)),
    "subscription_costs": _on_tx(A.subscription_costs),
    "subscription_costs_per_user": _on_tx(lambda d: A.subscription_costs(d, PER_USER)),
    "available_years": _on_tx(A.available_years),
    "available_months": _on_tx(A.available_months),
    "period_filter": q_period_filter,
    "period_filter_empty": q_period_filter_empty,
    "user_history": q_user_history,
}


# --------------------------------------------------------------------------- cleaning, keys, dedup

def q_clean_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    cleaned = clean_transactions(raw_orders_text(spark, sf_dir))
    return present(cleaned.drop("posting_date"))


def q_date_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    ev = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("transaction_date"))
    out = add_calendar_features(ev)
    return out.select("event_id", F.to_date("transaction_date").alias("event_date"), "year", "month", "day",
                      "month_name", "day_of_week")


def q_dedup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_dedup_key(tx_table(spark, sf_dir)).select("transaction_id", "dedup_key")


def _upload(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(incoming cleaned upload, stored history) of the re-upload scenario."""
    tx = tx_table(spark, sf_dir)
    incoming = clean_transactions(raw_upload(upload_part(tx)))
    return incoming, history_part(tx)


def q_dedup_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, history = _upload(spark, sf_dir)
    return present(new_rows(incoming, history).select("user_id", *INSERT_COLUMNS))


def q_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, history = _upload(spark, sf_dir)
    return dedup_report(incoming, history)


def q_append_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store the history, append the upload's new rows with fresh ids, read the table back."""
    incoming, history = _upload(spark, sf_dir)
    path = scratch_path(spark, "append")
    write_transactions(history, path, mode="errorifexists")
    stored = read_transactions(spark, path, with_bucket=True)
    base = stored_max(spark, path, "transaction_id")  # from file footers, not a scan of the ids
    write_transactions(rows_to_insert(incoming, stored, base=base), path, mode="append", layout=False)
    return present(read_transactions(spark, path).select("user_id", *INSERT_COLUMNS))


def q_user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert the logins after the history into the users known before; new ids left out."""
    prepare(spark)
    snap = upsert_users(users_from_tables(spark, sf_dir), user_updates_from_tables(spark, sf_dir))
    return snap.select(
        F.when(~F.col("is_new"), F.col("user_id")).alias("user_id"), "email", "display_name", "picture_url", "is_new"
    )


def q_user_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert into a bucketed store, in two halves; new ids left out."""
    prepare(spark)
    path = f"{scratch_path(spark, 'user-store')}/users"
    known, updates = users_from_tables(spark, sf_dir), user_updates_from_tables(spark, sf_dir)
    create_user_store(spark, path, 8)
    load_user_store(spark, path, known)
    middle = updates.select(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        upsert_user_store(spark, path, updates.filter(half))
    ids = known.select("email", F.lit(False).alias("_new"))
    out = read_user_store(spark, path).join(ids, "email", "left").withColumn("is_new", F.coalesce("_new", F.lit(True)))
    return out.select(
        F.when(~F.col("is_new"), F.col("user_id")).alias("user_id"), "email", "display_name", "picture_url", "is_new"
    )


def q_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over tables with some rows of every kind of violation."""
    tx, users = tx_table(spark, sf_dir), users_from_tables(spark, sf_dir)
    t, u = F.col("transaction_id"), F.col("user_id")
    tx = tx.unionByName(tx.filter(F.pmod(t, F.lit(17)) == 0)).withColumns({
        "address": F.when(F.pmod(t, F.lit(13)) == 0, F.repeat("address", 200)).otherwise(F.col("address")),
        "user_id": F.when(F.pmod(t, F.lit(11)) != 0, u),
        "transaction_id": F.when(F.pmod(t, F.lit(19)) != 0, t),
    })
    users = users.unionByName(users.filter(F.pmod(u, F.lit(5)) == 0)).withColumns({
        "email": F.when(F.pmod(u, F.lit(7)) != 0, F.col("email")),
        "display_name": F.when(F.pmod(u, F.lit(3)) == 0, F.repeat("display_name", 20)).otherwise(F.col("display_name")),
    })
    return constraint_violations(tx, users)


def q_user_ids_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the emails of all customers, known ones and others."""
    prepare(spark)
    emails = customer_emails(spark, sf_dir)
    return user_ids(users_from_tables(spark, sf_dir), emails)


def q_one_user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one user: the one with the smallest id."""
    tx = tx_table(spark, sf_dir, with_bucket=True)
    return present(user_history(tx, tx.select(F.min("user_id")).first()[0]))


def q_clean_padded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column names with blanks around them are still typed."""
    prepare(spark)
    raw = raw_orders_text(spark, sf_dir)
    padded = raw.toDF(*[f" {c}  " if i % 2 else f"{c}\t" for i, c in enumerate(raw.columns)])
    return present(clean_transactions(padded).drop("posting_date"))


def q_surrogate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh ids above the stored ones, dense and in (date, old id) order."""
    tx = tx_table(spark, sf_dir)
    old = tx.select(F.col("transaction_id").alias("old_id"), "transaction_date")
    new = assign_ids(old, tx, "transaction_id", order=["transaction_date", "old_id"])
    return new.select("old_id", "transaction_id")


def q_catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables created, written and counted through the catalog."""
    tx = tx_table(spark, sf_dir)
    root = scratch_path(spark, "store")
    names = [f"{n}_{root[-12:]}" for n in ("transactions", "users")]
    create_tables(spark, root, *names)
    write_transactions(tx, f"{root}/transactions")
    write_users_snapshot(spark, root, users_from_tables(spark, sf_dir))
    refresh_tables(spark, root, *names)
    counts = [
        spark.table(n).agg(F.lit(label).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"))
        for n, label in zip(names, ("transactions", "users"), strict=True)
    ]
    return counts[0].unionByName(counts[1])


def q_emptied_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables written, emptied, written again and dropped: their rows after each step, null
    where the catalog has no such table."""
    tx, users = tx_table(spark, sf_dir), users_from_tables(spark, sf_dir)
    root = scratch_path(spark, "emptied")
    names = {n: f"{n}_{root[-12:]}" for n in ("transactions", "users")}
    counts = []

    def fill() -> None:
        write_transactions(tx, f"{root}/transactions")
        write_users_snapshot(spark, root, users)
        refresh_tables(spark, root, *names.values())

    steps = [lambda: create_tables(spark, root, *names.values()), fill, lambda: truncate_tables(spark, root, *names.values()),
             fill, lambda: drop_tables(spark, root, *names.values())]
    for n, step in enumerate(steps, start=1):
        step()
        for label, name in names.items():
            counts.append((n, label, spark.table(name).count() if spark.catalog.tableExists(name) else None))
    return spark.createDataFrame(counts, "step int, table_name string, n_rows long")


def q_folder_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per benchmark item, written to a folder and read back whole."""
    prepare(spark)
    path = scratch_path(spark, "folder")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    items.write.partitionBy("item_id").text(path, lineSep="|")
    docs = read_text_documents(spark, f"{path}/*")
    return docs.select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "text")


QUERIES.update(
    {
        "clean_types": q_clean_types,
        "date_features": q_date_features,
        "dedup_keys": q_dedup_keys,
        "dedup_new_rows": q_dedup_new_rows,
        "dedup_report": q_dedup_report,
        "append_history": q_append_history,
        "user_upsert": q_user_upsert,
        "user_store": q_user_store,
        "constraint_violations": q_constraint_violations,
        "user_ids_by_email": q_user_ids_by_email,
        "one_user_history": q_one_user_history,
        "clean_padded_names": q_clean_padded_names,
        "surrogate_ids": q_surrogate_ids,
        "catalog_tables": q_catalog_tables,
        "emptied_tables": q_emptied_tables,
        "folder_documents": q_folder_documents,
    }
)


# --------------------------------------------------------------------------- JSON and statement text

def q_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx -> fenced JSON response documents -> parse -> clean: the round trip equals tx."""
    docs = json_documents(tx_table(spark, sf_dir))
    rows = clean_transactions(extraction_rows(docs))
    return present(rows.select("user_id", *INSERT_COLUMNS))


def q_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_records(tx_table(spark, sf_dir), keep=["transaction_id", "user_id"])


def q_statement_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tx -> statement pages -> documents -> line extraction: the round trip equals tx."""
    pages = render_statements(tx_table(spark, sf_dir), lines_per_page=2)
    docs = assemble_documents(pages, ["user_id", "statement_year", "statement_month"], "\n")
    rows = statement_rows(docs)
    return present(
        rows.select(
            "user_id", "transaction_date", "posting_date", F.col("raw_description").alias("activity_description"),
            "amount_spent", "credit_limit", F.col("statement_available_credit").alias("available_credit"),
        )
    )


def q_json_export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON export read back as response documents and cleaned: equals tx."""
    records = json_records(tx_table(spark, sf_dir), keep=["user_id"])
    docs = records.select("user_id", F.concat(F.lit("["), "record", F.lit("]")).alias("text"))
    return present(clean_transactions(extraction_rows(docs)).select("user_id", *INSERT_COLUMNS))


def q_statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body pages and extracted lines of every statement (two lines a page)."""
    pages = render_statements(tx_table(spark, sf_dir), lines_per_page=2)
    keys = ["user_id", "statement_year", "statement_month"]
    lines = statement_rows(assemble_documents(pages, keys, "\n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines"))
    bodies = pages.filter("page_no > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_body_pages"))
    return bodies.join(lines, keys)


def _statements(tx: DataFrame) -> DataFrame:
    """Statement documents of ``tx`` whose holder line reads "Customer <number>"."""
    named = tx.withColumn("customer_id", F.replace("customer_id", F.lit("#"), F.lit(" ")))
    keys = ["user_id", "statement_year", "statement_month"]
    return assemble_documents(render_statements(named, lines_per_page=2), keys, "\n")


def q_statement_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statement_records(_statements(tx_table(spark, sf_dir)))
    return present(rows.select("user_id", *INSERT_COLUMNS))


def q_statement_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all years from UPLOAD_START on, ingested over the stored history."""
    tx = tx_table(spark, sf_dir)
    new = statement_ingest(_statements(upload_part(tx)), history_part(tx))
    return present(new.select("user_id", "transaction_date", "activity_description", "amount_spent", "is_subscription"))


QUERIES.update(
    {
        "json_export_roundtrip": q_json_export_roundtrip,
        "statement_pages": q_statement_pages,
        "statement_records": q_statement_records,
        "statement_ingest": q_statement_ingest,
        "json_extract": q_json_extract,
        "json_export": q_json_export,
        "statement_extract": q_statement_extract,
    }
)


# --------------------------------------------------------------------------- enrichment rules

def q_customer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    c = read_table(spark, sf_dir, "customer").select(
        "c_custkey", F.substring_index("c_name", "#", 1).alias("f_name"), F.substring_index("c_name", "#", -1).alias("l_name")
    )
    return c.withColumn("customer_id", customer_id(F.col("f_name"), F.col("l_name")))


def merchant_descriptors(tx: DataFrame) -> DataFrame:
    """Card descriptors as printed on statements: merchant name followed by '*', '#' or a
    wide gap and location/reference text."""
    k = F.pmod(F.col("transaction_id"), 5)
    raw = (
        F.when(k == 0, F.concat(F.col("activity_description"), F.lit("* "), F.col("address")))
        .when(k == 1, F.concat(F.col("activity_description"), F.lit(" #"), F.col("transaction_id").cast("string")))
        .when(k == 2, F.concat(F.lit("Amzn Mktp "), F.col("activity_description")))
        .when(k == 3, F.concat(F.col("activity_description"), F.lit("*paypal")))
        .otherwise(F.concat(F.col("activity_description"), F.lit("  "), F.col("sub_category")))
    )
    return tx.select("transaction_id", raw.alias("raw_description"))


def q_merchant_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = merchant_descriptors(tx_table(spark, sf_dir))
    return d.withColumn("merchant", normalise_merchant(F.col("raw_description")))


def q_merchant_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors with places, references, aliases and names that only look like one."""
    tx = tx_table(spark, sf_dir)
    k, desc, place = F.pmod("transaction_id", F.lit(7)), F.col("activity_description"), F.col("address")
    raw = (
        F.when(k == 0, F.concat_ws(" ", desc, place))
        .when(k == 1, F.concat_ws(" ", F.lower(desc), place, F.format_string("%06d", "transaction_id")))
        .when(k == 2, F.concat_ws(" ", F.lit("Uber  trip"), place))
        .when(k == 3, F.concat_ws(" ", F.lit("Schubert Hall"), place))
        .when(k == 4, F.concat(desc, F.lit("* "), F.col("sub_category")))
        .when(k == 5, F.concat(F.lit("PayPal *"), desc))
        .otherwise(F.concat_ws(" ", F.lit("Tuberia"), F.format_string("#%d", "transaction_id")))
    )
    return simplify_merchants(tx.select("transaction_id", raw.alias("raw_description")))


# Merchant words put behind the descriptions, so that every kind of rule fires.
SHOP_WORDS = ("Grocery", "*COFFEE* 12", "uber eats", "Uber trip", "gas  station", "PARENT hub", "SPRING", "amazon coffee",
              "", "monthly fee", "COFFEEHOUSE", "Netflix", "credit card payment")


def merchant_texts(tx: DataFrame) -> DataFrame:
    """(transaction_id, activity_description) with merchant words behind the part names."""
    k = F.pmod("transaction_id", F.lit(len(SHOP_WORDS)))
    word = F.element_at(F.array(*[F.lit(w) for w in SHOP_WORDS]), (k + 1).cast("int"))
    return tx.select("transaction_id", F.concat_ws(" ", "activity_description", word).alias("activity_description"))


def q_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return categorise(merchant_texts(tx_table(spark, sf_dir)))


def q_categorise_many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a rule table too large for one expression: equal rows."""
    rules = CATEGORY_RULES + [(f"UNKNOWN SHOP {i}", "Other", "Other") for i in range(250)]
    return categorise(merchant_texts(tx_table(spark, sf_dir)), rules=rules)


def q_taxonomy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows in three carry the pair their merchant words give; the rest keep the table's."""
    tx = tx_table(spark, sf_dir).select("transaction_id", "category", "sub_category")
    ruled = categorise(merchant_texts(tx_table(spark, sf_dir))).select(
        "transaction_id", F.col("category").alias("_c"), F.col("sub_category").alias("_s")
    )
    keep = F.pmod("transaction_id", F.lit(3)) == 0
    mixed = tx.join(ruled, "transaction_id").select(
        F.when(keep, F.col("category")).otherwise(F.col("_c")).alias("category"),
        F.when(keep, F.col("sub_category")).otherwise(F.col("_s")).alias("sub_category"),
    )
    return taxonomy_violations(mixed)


def q_running_available_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = running_available_credit(tx_table(spark, sf_dir))
    return r.select("transaction_id", "user_id", F.col("running_available_credit").cast("double"))


def q_running_available_credit_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh amount is missing, first rows of users among them."""
    tx = tx_table(spark, sf_dir).withColumn(
        "amount_spent", F.when(F.pmod("transaction_id", F.lit(7)) != 0, F.col("amount_spent"))
    )
    r = running_available_credit(tx)
    return r.select("transaction_id", "user_id", F.col("running_available_credit").cast("double"))


def q_recurring_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurring_merchants(tx_table(spark, sf_dir))


def q_spending_habits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spending_habits(_tx(spark, sf_dir))


QUERIES.update(
    {
        "customer_ids": q_customer_ids,
        "merchant_normalise": q_merchant_normalise,
        "merchant_tokens": q_merchant_tokens,
        "categorise": q_categorise,
        "categorise_many_rules": q_categorise_many_rules,
        "taxonomy_violations": q_taxonomy_violations,
        "running_available_credit": q_running_available_credit,
        "running_available_credit_nulls": q_running_available_credit_nulls,
        "recurring_merchants": q_recurring_merchants,
        "spending_habits": q_spending_habits,
    }
)


# --------------------------------------------------------------------------- streaming ingest

def q_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two uploads land one after the other; an availableNow stream ingests each arrival.
    The overlapping days are skipped the second time; the table holds every event once."""

    prepare(spark)
    root = scratch_path(spark, "ingest")
    landing, tx_path, log_path, ckpt = f"{root}/landing", f"{root}/transactions", f"{root}/ingest_log", f"{root}/_ckpt"
    for n, upload in enumerate(event_uploads(spark, sf_dir), start=1):
        upload.write.option("compression", "gzip").json(f"{landing}/upload_id={n}")
        run_ingest_stream(spark, landing, tx_path, log_path, ckpt)
    return present(read_transactions(spark, tx_path).select("user_id", *INSERT_COLUMNS))


def q_ingest_same_bytes_two_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the events is uploaded by its user and later, byte for byte, by another
    one: both have the rows."""
    prepare(spark)
    root = scratch_path(spark, "two-users")
    docs = event_documents(read_table(spark, sf_dir, "events"), "month")
    docs.write.option("compression", "gzip").json(f"{root}/landing/upload_id=1")
    # The very bytes that landed, not the documents made anew.
    docs = spark.read.schema(docs.schema).json(f"{root}/landing/upload_id=1")
    other = docs.withColumn("user_id", F.col("user_id") + 1_000_000)
    other.write.option("compression", "gzip").json(f"{root}/landing/upload_id=2")
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt")
    return present(read_transactions(spark, f"{root}/tx").select("user_id", *INSERT_COLUMNS))


def q_ingest_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as answers, one in five of them a valid array, one empty, one cut
    off, one with text behind it: what the ingest keeps aside, and why."""
    prepare(spark)
    root = scratch_path(spark, "quarantine")
    record = F.lit('[{"activity_description": "x", "amount_spent": "1"}]')
    k = F.pmod("doc_id", F.lit(5))
    text = (
        F.when(k == 0, record).when(k == 1, F.lit("[]")).when(k == 2, F.substring(record, 1, 30))
        .when(k == 3, F.concat(record, F.lit(" thanks"))).otherwise(F.col("text"))
    )
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("user_id"), text.alias("text")
    )
    docs.write.json(f"{root}/landing/upload_id=1")
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt")
    stored = read_transactions(spark, f"{root}/tx").select(F.col("user_id").alias("doc_id"), F.lit("stored").alias("reason"))
    aside = read_quarantine(spark, f"{root}/log").select(F.col("user_id").alias("doc_id"), "reason")
    return stored.unionByName(aside)


_STATEMENT_STORES: dict[tuple[str, str], str] = {}


def statement_store(spark: SparkSession, sf_dir: str) -> str:
    """A store filled from statement files in two uploads, of the history and of the years after,
    which overlap; filled once per session and scale directory."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _STATEMENT_STORES:
        tx = tx_table(spark, sf_dir)
        root = scratch_path(spark, "statements")
        for n, part in enumerate((history_part(tx), upload_part(tx)), start=1):
            period = F.format_string("%04d-%02d", "statement_year", "statement_month")
            head = F.concat(F.lit("Account: "), F.col("user_id").cast("string"), F.lit("\nStatement period: "), period, F.lit("\n"))
            files = _statements(part).select(F.concat(head, "text", F.lit("\f")).alias("value"))
            files.write.option("maxRecordsPerFile", 5000).text(f"{root}/landing/upload_id={n}")
            run_statement_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt")
        _STATEMENT_STORES[key] = root
    return _STATEMENT_STORES[key]


def q_statement_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement files to stored rows by a stream: every transaction once, recurring charges
    flagged by all rows, those stored before the third month too."""
    rows = read_with_recurring(spark, f"{statement_store(spark, sf_dir)}/tx")
    return present(rows.select("user_id", "transaction_date", "activity_description", "amount_spent", "is_subscription"))


def q_recurring_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the ingest of the statement files kept: that of a scan of all rows."""
    state = recurring_state(spark, f"{statement_store(spark, sf_dir)}/tx")
    return state.select(
        "user_id", "merchant", F.size("months").cast("long").alias("n_months"), "n_transactions",
        F.col("least").cast("double").alias("min_amount"), F.col("greatest").cast("double").alias("max_amount"),
        (F.col("total").cast("double") / F.col("n_transactions")).alias("avg_amount"), "is_recurring",
    )


def q_constraint_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per customer, four in five with a row that the table does not take: what became of
    each."""
    prepare(spark)
    root = scratch_path(spark, "constraints")
    k = F.pmod("c_custkey", F.lit(5))
    customers = read_table(spark, sf_dir, "customer")
    record = F.to_json(F.struct(
        F.when(k == 1, F.repeat("c_name", 20)).otherwise(F.col("c_name")).alias("customer_id"),
        F.col("c_name").alias("activity_description"),
        F.when(k == 2, F.lit("1e20")).otherwise(F.col("c_acctbal").cast("string")).alias("amount_spent"),
        F.lit("01-15-2024").alias("transaction_date"),
    ))
    docs = customers.select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.when(k == 4, -F.col("c_custkey")).when(k != 3, F.col("c_custkey")).alias("user_id"),
        F.concat(F.lit("["), record, F.lit("]")).alias("text"),
    )
    docs.write.json(f"{root}/landing/upload_id=1")
    users = customers.select(F.col("c_custkey").alias("user_id"))
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt", users=users)
    stored = read_transactions(spark, f"{root}/tx").select(F.col("user_id").cast("string").alias("doc_id"), F.lit("stored").alias("outcome"))
    return stored.unionByName(read_quarantine(spark, f"{root}/log").select("doc_id", F.col("reason").alias("outcome")))


def _on_rollup(fn: Callable[[DataFrame], DataFrame]) -> Query:
    """A dashboard output from the rollup that the ingest of the statement files kept."""
    return lambda spark, sf_dir: fn(A.period_filter(read_rollup(spark, f"{statement_store(spark, sf_dir)}/tx")))


QUERIES.update(
    {
        "rollup_overview_per_user": _on_rollup(lambda d: A.overview(d, PER_USER)),
        "rollup_daily_series": _on_rollup(A.daily_series),
        "rollup_monthly_totals": _on_rollup(A.monthly_totals),
        "rollup_weekday_totals_per_user": _on_rollup(lambda d: A.weekday_totals(d, PER_USER)),
        "rollup_top10_merchants_per_user": _on_rollup(lambda d: A.top_merchants(d, 10, PER_USER)),
    }
)
QUERIES["constraint_ingest"] = q_constraint_ingest
QUERIES["statement_stream"] = q_statement_stream
QUERIES["recurring_state"] = q_recurring_state
QUERIES["incremental_ingest"] = q_incremental_ingest
QUERIES["ingest_same_bytes_two_users"] = q_ingest_same_bytes_two_users
QUERIES["ingest_quarantine"] = q_ingest_quarantine


# --------------------------------------------------------------------------- more outputs

def q_adviser_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array per user for an external adviser."""
    return json_payloads(_tx(spark, sf_dir), ["user_id"])


def q_extraction_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents read as model responses, with some made blank, cut off, followed by
    text or holding a null: every one that is no array of objects has its reason."""
    prepare(spark)
    array = F.lit('[{"activity_description": "x"}]')
    k = F.pmod("doc_id", F.lit(7))
    text = (
        F.when(k == 1, F.lit(" ")).when(k == 2, F.lit('[{"activity_description": "x"')).when(k == 3, F.concat(array, F.lit(" ok")))
        .when(k == 4, F.lit("[null]")).when(k == 5, F.concat(F.lit("```json"), array, F.lit("```"))).otherwise(F.col("text"))
    )
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return extraction_quarantine(docs).select("doc_id", "reason")


QUERIES.update(
    {
        "daily_spend_vs_payments_per_user": _on_tx(lambda d: A.daily_series(d, PER_USER)),
        "adviser_payloads": q_adviser_payloads,
        "extraction_quarantine": q_extraction_quarantine,
    }
)


def q_recurring_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_recurring(tx_table(spark, sf_dir)).select("transaction_id", "user_id", "activity_description", "is_recurring")


QUERIES["recurring_flags"] = q_recurring_flags


def q_typing_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values present in the messy order text that did not parse, per typed column."""
    prepare(spark)
    return typing_failures(raw_orders_text(spark, sf_dir))


QUERIES["typing_failures"] = q_typing_failures
