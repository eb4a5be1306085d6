"""Deterministic stand-ins for the row rules a model applies to statement lines.

Rule tables are small data, compiled into one native expression (evaluated map-side, no
join); a large rule table is matched by an equi-join on the phrases of each different
description instead, with the same rows as result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.text import utrim
from spendlens.operators.skew import MAX_HOT_KEYS, PIECE_ROWS, join_back
from spendlens.schema import taxonomy_df

# ---------------------------------------------------------------------------
# Fixed rule values
# ---------------------------------------------------------------------------

# Merchant aliases: (whole words of the upper-cased descriptor, merchant name), first match wins.
MERCHANT_ALIASES = [
    ("AMZN", "AMAZON"),
    ("AMAZON", "AMAZON"),
    ("UBER", "UBER"),
    ("NETFLIX", "NETFLIX"),
    ("SPOTIFY", "SPOTIFY"),
    ("APPLE.COM", "APPLE"),
    ("PAYPAL", "PAYPAL"),
]

# Category phrases: (phrase of whole words in the upper-cased merchant, category, sub-category),
# in priority order (first match wins). Amazon comes first: its sub-category is Amazon too.
CATEGORY_RULES = [
    ("AMAZON", "Amazon", "Amazon"),
    ("RENT", "Living Expenses", "Rent"),
    ("HYDRO", "Living Expenses", "Utilities"),
    ("ELECTRIC", "Living Expenses", "Utilities"),
    ("GROCERY", "Living Expenses", "Groceries"),
    ("GROCERIES", "Living Expenses", "Groceries"),
    ("SUPERMARKET", "Living Expenses", "Groceries"),
    ("UBER EATS", "Living Expenses", "Dining Out"),
    ("RESTAURANT", "Living Expenses", "Dining Out"),
    ("COFFEE", "Living Expenses", "Dining Out"),
    ("PIZZA", "Living Expenses", "Dining Out"),
    ("UBER", "Living Expenses", "Transportation"),
    ("TRANSIT", "Living Expenses", "Transportation"),
    ("GAS STATION", "Living Expenses", "Transportation"),
    ("APPAREL", "Personal & Lifestyle", "Clothing"),
    ("SHOES", "Personal & Lifestyle", "Clothing"),
    ("SALON", "Personal & Lifestyle", "Personal Care"),
    ("CINEMA", "Personal & Lifestyle", "Entertainment"),
    ("GYM", "Personal & Lifestyle", "Fitness"),
    ("AIRLINES", "Personal & Lifestyle", "Travel"),
    ("HOTEL", "Personal & Lifestyle", "Travel"),
    ("LOAN", "Financial", "Loan Payments"),
    ("CREDIT CARD PAYMENT", "Financial", "Credit Card Payments"),
    ("PAYMENT", "Financial", "Credit Card Payments"),
    ("SAVINGS", "Financial", "Savings"),
    ("INSURANCE", "Financial", "Insurance"),
    ("FEE", "Financial", "Bank Fees"),
    ("CLINIC", "Healthcare", "Doctor Visits"),
    ("PHARMACY", "Healthcare", "Pharmacy"),
    ("DENTAL", "Healthcare", "Dental"),
    ("OPTICAL", "Healthcare", "Vision"),
    ("NETFLIX", "Subscriptions", "Streaming"),
    ("SPOTIFY", "Subscriptions", "Streaming"),
    ("SOFTWARE", "Subscriptions", "Software"),
    ("MEMBERSHIP", "Subscriptions", "Memberships"),
]
OTHER = ("Other", "Other")

# Descriptor separators: '*', '#', or two or more spaces end the merchant name.
MERCHANT_SPLIT_RE = r"\*|#|\s{2,}"


# --------------------------------------------------------------------------- X3

def customer_id(f_name: Column, l_name: Column) -> Column:
    """``first_last`` in lower case."""
    return F.lower(F.concat_ws("_", utrim(f_name), utrim(l_name)))


# --------------------------------------------------------------------------- X4

# What separates the words in which aliases are looked for: NETFLIX.COM holds NETFLIX.
ALIAS_SPLIT_RE = r"[^\p{L}\p{N}]+"


def alias_words(text: Column) -> Column:
    """The upper-cased words of a descriptor, letters and digits only."""
    return F.filter(F.split(F.upper(text), ALIAS_SPLIT_RE), lambda w: w != "")


def _spaced(text: Column, separators: str) -> Column:
    """The upper-cased words of a text, joined by single spaces. ``split`` compiles its pattern anew for
    every value, ``regexp_replace`` once."""
    return F.trim(F.regexp_replace(F.upper(text), separators, " "))


def alias_phrase(keyword: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in keyword.upper()).split())


def padded_alias_words(desc: Column) -> Column:
    """The words of a descriptor with a blank around each: what ``normalise_merchant`` looks in."""
    return F.concat(F.lit(" "), _spaced(desc, ALIAS_SPLIT_RE), F.lit(" "))


def normalise_merchant(desc: Column, aliases: list[tuple[str, str]] | None = None, padded: Column | None = None) -> Column:
    """Upper-case merchant name: that of the first alias whose words stand in the descriptor, else
    the descriptor up to the first separator (``UBER* TRIP TORONTO ON`` -> ``UBER``; ``SCHUBERT
    HALL`` holds no alias). ``operators.merchants`` also drops trailing places and references.
    ``padded`` are its ``padded_alias_words`` as a column: an expression is evaluated once per alias."""
    up = F.upper(utrim(desc))
    words = padded_alias_words(desc) if padded is None else padded
    expr = utrim(F.regexp_replace(up, f"(?s)(?:{MERCHANT_SPLIT_RE}).*", ""))
    for pattern, merchant in reversed(aliases if aliases is not None else MERCHANT_ALIASES):
        expr = F.when(words.contains(f" {alias_phrase(pattern)} "), F.lit(merchant)).otherwise(expr)
    return F.when(desc.isNull(), F.lit(None).cast("string")).otherwise(expr)


# --------------------------------------------------------------------------- X5, X6

# Characters between the words of a description or a rule phrase: all but A-Z, 0-9, & and the dot.
# Written as what it matches: the negated class takes six times as long in Java's matcher.
WORD_SPLIT_RE = "[\\x00-%'-\\-/:-@\\[-\U0010ffff]+"


def _words(text: Column) -> Column:
    """The upper-cased words of a text, joined by single spaces."""
    return _spaced(text, WORD_SPLIT_RE)


def _phrase(keyword: str) -> str:
    return " ".join(w for w in re.split(WORD_SPLIT_RE, keyword.upper()) if w)


def padded_words(desc: Column) -> Column:
    """The upper-cased words of a text with a blank around each: what ``first_rule`` looks in."""
    return F.concat(F.lit(" "), _words(desc), F.lit(" "))


def first_rule(padded: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """struct(category, sub_category) of the first rule whose phrase stands in ``padded`` as whole
    consecutive words; (Other, Other) when none does (X5, X6). ``padded`` should be a column, as
    an expression would be evaluated once per rule."""
    expr = F.struct(F.lit(OTHER[0]).alias("category"), F.lit(OTHER[1]).alias("sub_category"))
    for kw, cat, sub in reversed(rules if rules is not None else CATEGORY_RULES):
        hit = padded.contains(f" {_phrase(kw)} ")
        expr = F.when(hit, F.struct(F.lit(cat).alias("category"), F.lit(sub).alias("sub_category"))).otherwise(expr)
    return expr


def categorise(df: DataFrame, desc_col: str = "activity_description", rules: list[tuple[str, str, str]] | None = None,
               id_col: str = "transaction_id", max_inline_rules: int = 200) -> DataFrame:
    """Set ``category``/``sub_category`` from the merchant text, by ``first_rule``.

    Up to ``max_inline_rules`` rules: one CASE expression, evaluated in the scan stage. More:
    each different description is cut into its phrases of up to the longest rule's words, these
    are equi-joined with the rules, the first rule per description wins and is joined back with
    hot descriptions split over several tasks. Both ways give the same rows.
    """
    rules = rules if rules is not None else CATEGORY_RULES
    if len(rules) <= max_inline_rules:
        cat = first_rule(F.col("_padded"), rules)
        return df.withColumn("_padded", padded_words(F.col(desc_col))).withColumn("_cat", cat).withColumns(
            {"category": F.col("_cat.category"), "sub_category": F.col("_cat.sub_category")}
        ).drop("_cat", "_padded")
    phrases = [(_phrase(kw), c, s, i) for i, (kw, c, s) in enumerate(rules)]
    rules_df = df.sparkSession.createDataFrame(phrases, "phrase string, category string, sub_category string, priority int")
    longest = max(p.count(" ") + 1 for p, *_ in phrases)
    eligible = F.col(desc_col).isNotNull()
    per_text = df.filter(eligible).groupBy(desc_col).agg(F.count(F.lit(1)).alias("_n"))
    words = F.filter(F.split(_words(F.col(desc_col)), " "), lambda w: w != "")
    grams = per_text.select(desc_col, words.alias("_w")).select(
        desc_col,
        F.explode(F.flatten(F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.transform(F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - n + 1)).otherwise(F.array().cast("array<int>")),
                                  lambda i: F.array_join(F.slice("_w", i, n), " ")),
        ))).alias("phrase"),
    )
    best = grams.join(rules_df, "phrase").groupBy(desc_col).agg(F.min("priority").alias("priority"))
    named = rules_df.drop("phrase").withColumnsRenamed({"category": "_c", "sub_category": "_s"})
    per_text = per_text.join(best.join(named, "priority").drop("priority"), desc_col, "left")
    out = join_back(df.drop("category", "sub_category"), per_text, [desc_col], "_n", id_col, eligible)
    return out.withColumns(
        {"category": F.coalesce("_c", F.lit(OTHER[0])), "sub_category": F.coalesce("_s", F.lit(OTHER[1]))}
    ).drop("_c", "_s", "_n")


# --------------------------------------------------------------------------- X12

def taxonomy_violations(df: DataFrame) -> DataFrame:
    """Rows whose (category, sub_category) is outside the guide, counted per pair.

    Counts are pre-aggregated per pair before the anti-join with the 24-row guide, which is
    a fixed-size broadcast; null parts never match the guide and are reported as well.
    """
    tax = F.broadcast(taxonomy_df(df.sparkSession))
    pairs = df.groupBy("category", "sub_category").agg(F.count(F.lit(1)).alias("n_rows"))
    cond = (pairs["category"] == tax["category"]) & (pairs["sub_category"] == tax["sub_category"])
    return pairs.join(tax, cond, "left_anti")


# --------------------------------------------------------------------------- X9

def recurring_merchants(tx: DataFrame, min_months: int = 3, tolerance_pct: int = 5) -> DataFrame:
    """Per (user, merchant) over expenses: distinct months, count, min/max/avg amount and
    ``is_recurring`` = seen in at least ``min_months`` months at one price (max - min within
    ``tolerance_pct`` % of the mean).

    Two aggregation levels - (user, merchant, month) then (user, merchant) - instead of a
    distinct count, so partial aggregates cut every hot key down map-side.
    """
    exp = tx.filter((F.col("amount_spent") > 0) & F.col("activity_description").isNotNull())
    monthly = exp.groupBy(
        "user_id", F.col("activity_description").alias("merchant"), F.trunc(F.to_date("transaction_date"), "month").alias("_m")
    ).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount_spent").alias("_s"),
        F.min("amount_spent").alias("_lo"), F.max("amount_spent").alias("_hi"),
    )
    agg = monthly.groupBy("user_id", "merchant").agg(
        F.count("_m").alias("n_months"), F.sum("_n").alias("n_transactions"), F.sum("_s").alias("_s"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
    )
    # (hi - lo) <= pct/100 * (s / n)  <=>  (hi - lo) * n * 100 <= pct * s : exact in DECIMAL.
    steady = (F.col("_hi") - F.col("_lo")) * F.col("n_transactions") * F.lit(100) <= F.lit(tolerance_pct) * F.col("_s")
    return agg.select(
        "user_id", "merchant", "n_months", "n_transactions",
        F.col("_lo").cast("double").alias("min_amount"), F.col("_hi").cast("double").alias("max_amount"),
        (F.col("_s").cast("double") / F.col("n_transactions")).alias("avg_amount"),
        ((F.col("n_months") >= min_months) & steady).alias("is_recurring"),
    )


# --------------------------------------------------------------------------- X13

def spending_habits(tx: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per user and (category, sub_category): count, total, average and share of the user's
    spending (X13). The share window runs on aggregated rows (at most one per pair)."""
    by = ["user_id"] if by is None else by
    exp = tx.filter((F.col("amount_spent") > 0) & F.col("category").isNotNull() & F.col("sub_category").isNotNull())
    g = exp.groupBy(*by, "category", "sub_category").agg(F.count(F.lit(1)).alias("n_transactions"),
                                                         F.sum("amount_spent").alias("_s"))
    total = F.sum("_s").over(Window.partitionBy(*by) if by else Window.partitionBy())
    return g.select(
        *by, "category", "sub_category", "n_transactions",
        F.col("_s").cast("double").alias("total_spent"),
        (F.col("_s").cast("double") / F.col("n_transactions")).alias("avg_spent"),
        (F.col("_s").cast("double") / total.cast("double")).alias("share"),
    )


def flag_recurring(tx: DataFrame, min_months: int = 3, tolerance_pct: int = 5,
                   max_hot_keys: int = MAX_HOT_KEYS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows of ``tx`` with ``is_recurring`` from ``recurring_merchants`` joined back on
    (user, merchant); rows that are not expenses get false. The join back splits a hot
    (user, merchant) pair over several tasks (``skew.join_back``)."""
    rec = recurring_merchants(tx, min_months, tolerance_pct).select(
        "user_id", F.col("merchant").alias("activity_description"), F.col("is_recurring").alias("_rec"),
        F.col("n_transactions").alias("_n"),
    )
    # The rows recurring_merchants counted: only these can match.
    eligible = (F.col("amount_spent") > 0) & F.col("activity_description").isNotNull()
    out = join_back(tx, rec, ["user_id", "activity_description"], "_n", "transaction_id", eligible,
                    max_hot_keys, piece_rows)
    flag = F.coalesce(F.col("_rec") & (F.col("amount_spent") > 0), F.lit(False))
    return out.withColumn("is_recurring", flag).drop("_rec", "_n")
