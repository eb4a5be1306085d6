"""Statement text -> transaction rows, deterministically.

Line form: ``Jan 01 Jan 02 UBER* TRIP TORONTO ON 12.50`` (transaction date, posting date,
description, amount); a credit is marked by a trailing ``CR`` or a leading minus. The
statement's credit limit and available credit come from its header lines; the year of the
``Mon dd`` dates from the document's ``statement_year``/``statement_month``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.text import has_text, utrim
from spendlens.schema import MONEY

# Fixed patterns of the statement layout.
DATED_RE = r"(?m)^[A-Z][a-z]{2} \d{1,2} [A-Z][a-z]{2} \d{1,2}\b.*$"
FIELDS_RE = r"^([A-Z][a-z]{2} \d{1,2}) ([A-Z][a-z]{2} \d{1,2}) (.+) (-?\$?-?[\d,]+\.\d{2})( CR)?[ \t]*$"
# What joins a line's fields after one match; it stands in no statement text.
FIELD_SEPARATOR = "\x1f"
CREDIT_LIMIT_RE = r"(?i)credit limit:?\s*\$?\s*([\d,]+\.\d{2})"
AVAILABLE_RE = r"(?i)available credit:?\s*\$?\s*(-?[\d,]+\.\d{2})"


def _amount(text: Column) -> Column:
    return F.regexp_replace(text, "[$,]", "").try_cast(MONEY)


MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec "
MONTH_DAY_RE = r"^[A-Z][a-z]{2} \d{1,2}$"


def _plain_date(month_day: Column, year: Column) -> Column:
    """``Jan 05`` and a year of four digits as a date, null for anything else: a cast of an ISO text takes
    a fraction of the time that a date pattern does."""
    month = F.instr(F.lit(MONTHS), F.substring(month_day, 1, 4)) + 3
    iso = F.concat_ws("-", year.cast("string"), (month / 4).cast("int").cast("string"), F.substring(month_day, 5, 2))
    return F.when((month > 3) & year.between(1000, 9999) & month_day.rlike(MONTH_DAY_RE), iso.try_cast("date"))


def complete_date(month_day: Column, statement_year: Column, statement_month: Column | None) -> Column:
    """``Jan 05`` + statement year -> date (X2). With the statement month known, a date more
    than six months away belongs to the neighbouring year (December rows of a January
    statement fall in the previous year)."""
    d = F.coalesce(_plain_date(month_day, statement_year), F.to_date(
        F.try_to_timestamp(F.concat(month_day, F.lit(" "), statement_year.cast("string")), F.lit("MMM d yyyy"))))
    if statement_month is None:
        return d.cast("timestamp_ntz")
    gap = F.month(d) - statement_month
    shift = F.when(gap > 6, -12).when(gap < -6, 12).otherwise(0)
    return F.add_months(d, shift).cast("timestamp_ntz")


def _dated_lines(docs: DataFrame, text_col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per line that begins with two dates: the documents' other columns, ``position`` in
    the document, the ``line`` and ``_f``, its five fields (null when it does not parse), matched
    once."""
    keep = [c for c in docs.columns if c != text_col]
    lines = docs.withColumns(extra or {}).select(
        *keep, *(extra or {}), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(DATED_RE), 0)).alias("position", "line")
    )
    joined = F.regexp_replace("line", FIELDS_RE, FIELD_SEPARATOR.join(["$1", "$2", "$3", "$4", "$5"]))
    fields = F.split(joined, FIELD_SEPARATOR)
    return lines.withColumn("_fields", fields).withColumn("_f", F.when(F.size("_fields") == 5, F.col("_fields"))).drop("_fields")


def unparsed_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines that begin like a transaction but are none: the documents' columns, position, line."""
    return _dated_lines(docs, text_col).filter(F.col("_f").isNull()).drop("_f")


# The text of a line that looks like a transaction but does not parse, where such rows are asked for.
UNPARSED = "_unparsed"


def statement_rows(docs: DataFrame, text_col: str = "text", year_col: str = "statement_year",
                   month_col: str | None = "statement_month", unparsed: bool = False) -> DataFrame:
    """One row per transaction line, in statement order (``position``), with the raw
    line, typed dates, description, signed amount and the statement's credit figures.
    Lines that look like transactions but do not parse are given by ``unparsed_lines``; with
    ``unparsed`` they are rows too, without values and with their text as ``_unparsed``."""
    keep = [c for c in docs.columns if c != text_col]
    text = F.col(text_col)
    lines = _dated_lines(docs, text_col, {
        "credit_limit": _amount(F.regexp_extract(text, CREDIT_LIMIT_RE, 1)),
        "statement_available_credit": _amount(F.regexp_extract(text, AVAILABLE_RE, 1)),
    })
    f = F.col("_f")
    if not unparsed:
        lines = lines.filter(f.isNotNull())
    amount = _amount(f[3])
    is_credit = (f[4] != "") | (amount < 0)
    month = F.col(month_col) if month_col and month_col in docs.columns else None
    year = F.col(year_col)
    return lines.select(
        *keep, "position", "line",
        complete_date(f[0], year, month).alias("transaction_date"),
        complete_date(f[1], year, month).alias("posting_date"),
        utrim(f[2]).alias("raw_description"),
        # Debits positive, credits/returns negative.
        F.when(is_credit, -F.abs(amount)).otherwise(F.abs(amount)).alias("amount_spent"),
        "credit_limit", "statement_available_credit",
        *([F.when(f.isNull(), F.col("line")).alias(UNPARSED)] if unparsed else []),
    )


def fill_unknown_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unknown text fields become '' (X11); dates and numbers stay null."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


HOLDER_RE = r"(?im)^card holder:?[ \t]*(.*?)[ \t]*$"
# First name, and whatever follows it.
HOLDER_NAMES_RE = r"^(\S+)(?:\s+(.*))?$"


def statement_reasons(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``reason``: why a statement gives no rows, null for a usable one."""
    blank = ~F.coalesce(has_text(F.col(text_col)), F.lit(False))
    reason = F.when(blank, F.lit("empty")).when(F.col("user_id").isNull(), F.lit("no_account"))
    return docs.withColumn("reason", reason.when(F.col("statement_year").isNull(), F.lit("no_period")))


def statement_records(docs: DataFrame, text_col: str = "text", unparsed: bool = False) -> DataFrame:
    """Statement lines as typed transaction rows with every table column: the holder from
    the header, split into names, and the customer id from them (X3), the merchant simplified
    (X4), category by rule (X5, X6), unknown text '' (X11), available credit running from the
    statement value (X8, within the statement). ``is_subscription`` is false here: it needs the
    user's history, see ``statement_ingest``. With ``unparsed`` the lines that do not parse are rows
    as well, their text in ``_unparsed``: a text is then cut into lines once for both."""
    from spendlens.functions.dates import add_calendar_features
    from spendlens.operators.enrich import customer_id, first_rule, normalise_merchant, padded_alias_words, padded_words

    keys = [c for c in docs.columns if c != text_col]
    # The holder is a document column, carried through the line explode (no join back), and so are the
    # names and the id made of it: once per statement, not per line.
    with_holder = docs.withColumn("_holder", utrim(F.regexp_extract(F.col(text_col), HOLDER_RE, 1)))
    first, last = F.regexp_extract("_holder", HOLDER_NAMES_RE, 1), F.regexp_extract("_holder", HOLDER_NAMES_RE, 2)
    with_holder = with_holder.withColumns({"f_name": F.when(first != "", first), "l_name": F.when(last != "", last)})
    named = F.when(F.col("_holder") != "", customer_id(F.col("f_name"), F.col("l_name")))
    with_holder = with_holder.withColumn("customer_id", named).drop("_holder")
    # The merchant and the words are columns, so the aliases and the category rules reference them
    # instead of repeating their expressions once per alias or rule. The rules see the words of the whole description,
    # which an alias may cut, and behind a border that no phrase crosses those of the merchant.
    raw = F.col("raw_description")
    rows = statement_rows(with_holder, text_col, unparsed=unparsed).withColumn("_alias_words", padded_alias_words(raw))
    rows = rows.withColumn("_merchant", normalise_merchant(raw, padded=F.col("_alias_words")))
    rows = rows.withColumn("_padded", padded_words(F.concat_ws(" . ", "raw_description", "_merchant")))
    rows = rows.withColumn("_cat", first_rule(F.col("_padded")))
    cat = F.col("_cat")
    # One statement: a bounded group. Numbers first: names of documents that begin alike sort slowly.
    texts = {f.name for f in docs.schema.fields if f.dataType.simpleString() == "string"}
    stmt = Window.partitionBy(*sorted(keys, key=lambda k: k in texts)).orderBy("position")
    upto = stmt.rowsBetween(Window.unboundedPreceding, 0)
    # Lines that do not parse have no amount and are not the first of their statement.
    amount = F.coalesce("amount_spent", F.lit(0))
    amount = F.when(F.col(UNPARSED).isNull(), amount) if unparsed else amount
    out = rows.select(
        *keys, "position",
        "customer_id", "f_name", "l_name",
        F.lit(None).cast("string").alias("address"),
        "transaction_date", "posting_date",
        F.col("_merchant").alias("activity_description"),
        cat["category"].alias("category"),
        cat["sub_category"].alias("sub_category"),
        "amount_spent", "credit_limit",
        (F.col("statement_available_credit") + F.sum(amount).over(upto) - F.first(amount, ignorenulls=unparsed).over(upto))
        .try_cast(MONEY).alias("available_credit"),
        F.lit(False).alias("is_subscription"),
        *([UNPARSED] if unparsed else []),
    )
    out = fill_unknown_text(out, ["customer_id", "f_name", "l_name", "address"])
    return add_calendar_features(out)


def statement_ingest(docs: DataFrame, history: DataFrame, text_col: str = "text") -> DataFrame:
    """Statement text to rows for the transactions table: extracted, new rows only (J1), with ids
    above the stored ones in (document, position) order (K1) and ``is_subscription`` from the
    recurring merchants of the user's stored and new rows together (X9). Of the history only the
    rows of the new rows' users are aggregated, to one state row per merchant; a store that keeps
    that state (``streaming.ingest``) does not read them at all.

    The extracted rows are written once to the shared folder: the dedup sizes them and reads them
    again, which would extract every statement twice."""
    from spendlens.operators.dedup import new_rows
    from spendlens.operators.recurring import batch_state, merged_state, with_recurring
    from spendlens.schema import TX_COLUMNS
    from spendlens.session import scratch_path
    from spendlens.sources.tables import assign_ids, user_bucket, user_buckets

    extracted, path = statement_records(docs, text_col), scratch_path(docs.sparkSession, "statement-rows")
    extracted.write.parquet(path)
    fresh = new_rows(docs.sparkSession.read.schema(extracted.schema).parquet(path), history)
    fresh = assign_ids(fresh, history, "transaction_id", order=["doc_id", "position"]).select(*TX_COLUMNS)
    buckets = user_buckets(docs.sparkSession)

    def state(rows: DataFrame) -> DataFrame:
        return batch_state(rows.withColumn("user_bucket", user_bucket(F.col("user_id"), buckets)))

    mine = history.join(fresh.select("user_id"), "user_id", "left_semi")
    flagged = with_recurring(fresh, merged_state(state(mine).unionByName(state(fresh))))
    return flagged.withColumn("is_subscription", F.col("is_recurring")).select(*TX_COLUMNS)


def render_statements(tx: DataFrame, max_rows: int = 10_000, lines_per_page: int = 25) -> DataFrame:
    """Pages of statement text for rows of ``tx``: one statement per (user, half-year), named by
    its last month; a longer one than ``max_rows`` lines is cut into consecutive statements. The
    header with card holder, credit limit and available credit is page 0. Returns
    (doc_id, user_id, statement_year, statement_month, page_no, text)."""
    from spendlens.operators.running import numbered_parts

    half = F.when(F.col("month") <= 6, F.lit(6)).otherwise(F.lit(12))
    key = ["user_id", "statement_year", "statement_month"]
    docs = numbered_parts(tx.withColumns({"statement_year": F.col("year"), "statement_month": half}), key, max_rows)
    amt = F.col("amount_spent")
    line = F.concat_ws(
        " ",
        F.date_format("transaction_date", "MMM dd"),
        F.date_format("posting_date", "MMM dd"),
        F.col("activity_description"),
        F.concat(F.format_number(F.abs(amt).cast("double"), 2), F.when(amt < 0, F.lit(" CR")).otherwise(F.lit(""))),
    )
    in_part = F.col("ordinal") - 1 - F.col("part") * max_rows
    numbered = docs.select(
        F.concat_ws("-", *[F.col(k).cast("string") for k in (*key, "part")]).alias("doc_id"), *key,
        "customer_id", "credit_limit", "available_credit", in_part.alias("_n"), line.alias("_line"),
        (F.floor(in_part / lines_per_page) + 1).cast("int").alias("page_no"),
    )
    # Header fields ride in the collected (sorted) lines and are read from the first one:
    # collect_list keeps this an object-hash aggregate (a min_by over a struct would sort).
    pages = numbered.groupBy("doc_id", *key, "page_no").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_line", "customer_id", "credit_limit", "available_credit")))
        .alias("_items")
    )
    h = F.element_at("_items", 1)
    header = F.struct(
        F.lit(0).alias("page_no"),
        F.concat(
            F.lit("Card holder: "), h["customer_id"], F.lit("\nCredit Limit: $"),
            F.format_number(h["credit_limit"].cast("double"), 2),
            F.lit("\nAvailable Credit: $"), F.format_number(h["available_credit"].cast("double"), 2),
        ).alias("text"),
    )
    # No line end behind the last line of a page: a page border ends a line.
    body = F.struct(F.col("page_no"), F.array_join(F.transform("_items", lambda x: x["_line"]), "\n").alias("text"))
    # Page 1 also emits the header page 0: one pass over the page groups (no union of two
    # branches that would recompute the window and the aggregate).
    emitted = F.when(F.col("page_no") == 1, F.array(header, body)).otherwise(F.array(body))
    return pages.select("doc_id", *key, F.explode(emitted).alias("_p")).select("doc_id", *key, "_p.page_no", "_p.text")
