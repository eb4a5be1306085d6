import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendlens.operators.enrich import (CATEGORY_RULES, categorise, customer_id, normalise_merchant,
                                        recurring_merchants, taxonomy_violations)
from spendlens.operators.running import running_available_credit, running_sum


def test_merchant_and_customer(spark):
    df = spark.createDataFrame([("UBER* TRIP TORONTO ON", "Alex", "Juma"), ("AMZN Mktp CA*1X2", " Bo ", None),
                                ("corner store  #12", "a", "b")], "d string, f string, l string")
    got = [(r.m, r.c) for r in df.select(normalise_merchant(F.col("d")).alias("m"),
                                         customer_id(F.col("f"), F.col("l")).alias("c")).collect()]
    assert got == [("UBER", "alex_juma"), ("AMAZON", "bo"), ("CORNER STORE", "a_b")]


TEXTS = {
    "AMAZON RING": ("Amazon", "Amazon"), "NETFLIX": ("Subscriptions", "Streaming"), "BLUE BOLT": ("Other", "Other"),
    "STARBUCKS COFFEE": ("Living Expenses", "Dining Out"), "PARENT HUB": ("Other", "Other"),
    "SPRING AIR": ("Other", "Other"), "CITY GROCERY": ("Living Expenses", "Groceries"), "GROCERYLAND": ("Other", "Other"),
    "uber  eats, toronto": ("Living Expenses", "Dining Out"), "UBER TRIP": ("Living Expenses", "Transportation"),
    "EATS UBER": ("Living Expenses", "Transportation"), "GAS-STATION 12": ("Living Expenses", "Transportation"),
    "STATION GAS": ("Other", "Other"), "MONTHLY FEE": ("Financial", "Bank Fees"), "": ("Other", "Other"), " * ": ("Other", "Other"),
    None: ("Other", "Other"),
}


def test_categorise_has_one_meaning_for_any_number_of_rules(spark):
    rows = [(i * 10 + k, t) for i, t in enumerate(TEXTS) for k in range(3)]
    df = spark.createDataFrame(rows, "transaction_id long, activity_description string")
    want = {i: TEXTS[t] for i, t in rows}
    more = CATEGORY_RULES + [(f"NOMATCH{i} X", "Other", "Other") for i in range(250)]
    for args in ({}, {"max_inline_rules": 0}, {"rules": more}, {"rules": more, "max_inline_rules": 1000}):
        got = {r.transaction_id: (r.category, r.sub_category) for r in categorise(df, **args).collect()}
        assert got == want


def test_taxonomy_violations(spark):
    df = spark.createDataFrame([("Healthcare", "Dental"), ("Healthcare", "Dentist"), (None, "Other")], "category string, sub_category string")
    got = sorted((r.category or "", r.sub_category) for r in taxonomy_violations(df).collect())
    assert got == [("", "Other"), ("Healthcare", "Dentist")]


def test_running_credit_example_and_chunks(spark):
    d = dt.datetime(2024, 1, 1)
    rows = [(1, 1, d, Decimal("10.00"), Decimal("100.00")), (2, 1, d, Decimal("5.00"), Decimal("0")),
            (3, 1, dt.datetime(2024, 1, 2), Decimal("-3.00"), Decimal("0"))]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, transaction_date timestamp_ntz, "
                                     "amount_spent decimal(18,2), available_credit decimal(18,2)")
    got = [float(r.running_available_credit) for r in running_available_credit(df, chunk_rows=1).orderBy("transaction_id").collect()]
    assert got == [100.0, 105.0, 102.0]


def test_running_sum_matches_plain_window(spark):
    df = spark.range(0, 3000).select(
        F.col("id").alias("tid"), (F.col("id") % 3).alias("g"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 7 % 40).cast("int")).cast("timestamp_ntz").alias("d"),
        ((F.col("id") * 37 % 101) - 50).cast("decimal(18,2)").alias("v"),
    )
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("d", "tid").rowsBetween(Window.unboundedPreceding, 0)
    plain = {r.tid: r.s for r in df.select("tid", F.sum("v").over(w).alias("s")).collect()}
    for chunk in (1, 8, 4096):
        for hot in (0, 1500, 10_000):
            fast = {r.tid: r.s for r in running_sum(df, "v", ["g"], "d", "tid", "s", chunk_rows=chunk, hot_rows=hot).collect()}
            assert plain == fast


def test_running_credit_with_missing_values(spark):
    """Missing amounts count nothing, also as a user's first row; a null user is a user."""
    d, e = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = []
    for u in (1, None):
        rows += [(1, u, d, None, Decimal("100.00")), (2, u, d, Decimal("5.00"), None), (3, u, e, None, None),
                 (4, u, e, Decimal("2.00"), None), (5, u, None, Decimal("1.00"), None)]
    rows += [(6, 2, d, Decimal("5.00"), None), (7, 2, e, Decimal("5.00"), Decimal("3.00"))]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, transaction_date timestamp_ntz, "
                                     "amount_spent decimal(18,2), available_credit decimal(18,2)")
    want = {(t, u): v for u in (1, None) for t, v in zip((1, 2, 3, 4, 5), (100.0, 105.0, 105.0, 107.0, 108.0))}
    want |= {(6, 2): None, (7, 2): None}
    for chunk in (1, 8, 4096):
        for hot in (0, 1000):
            got = running_available_credit(df, chunk_rows=chunk, hot_rows=hot).collect()
            assert {(r.transaction_id, r.user_id): r.running_available_credit and float(r.running_available_credit)
                    for r in got} == want


def test_recurring(spark):
    rows = [(1, dt.datetime(2024, m, 3), "NETFLIX", Decimal("15.99")) for m in (1, 2, 3)] + \
           [(1, dt.datetime(2024, m, 3), "SHOP", Decimal(str(10 * m))) for m in (1, 2, 3)]
    df = spark.createDataFrame(rows, "user_id long, transaction_date timestamp_ntz, activity_description string, amount_spent decimal(18,2)")
    got = {r.merchant: (r.n_months, r.is_recurring) for r in recurring_merchants(df).collect()}
    assert got == {"NETFLIX": (3, True), "SHOP": (3, False)}


def test_flag_recurring_joins_back(spark):
    from spendlens.operators.enrich import flag_recurring

    rows = [(i, 1, dt.datetime(2024, m, 3), "NETFLIX", Decimal("15.99")) for i, m in enumerate((1, 2, 3))] + \
           [(9, 1, dt.datetime(2024, 1, 9), "NETFLIX", Decimal("-15.99")), (10, 2, dt.datetime(2024, 1, 9), "NETFLIX", Decimal("15.99"))]
    df = spark.createDataFrame(rows, "transaction_id long, user_id long, transaction_date timestamp_ntz, "
                                     "activity_description string, amount_spent decimal(18,2)")
    got = {r.transaction_id: r.is_recurring for r in flag_recurring(df).collect()}
    assert got == {0: True, 1: True, 2: True, 9: False, 10: False}


def test_merchants_by_whole_tokens_and_suffix_frequency(spark):
    from spendlens.operators.merchants import simplify_merchants

    cities = ["TORONTO ON", "LYON", "Graz"]
    shops = [f"SHOP{chr(65 + i)} {chr(70 + i)}ARM" for i in range(20)]
    texts = [f"{s} {c}" for s in shops for c in cities] + [f"{shops[0]} LYON 0042", "UBER* TRIP TORONTO ON", "TUBERIA", "SCHUBERT HALL",
             "uber eats graz", "AMZN MKTP", "LYON", "  ", "#", None, "12 34", f"{shops[1]}  Graz"]
    df = spark.createDataFrame(list(enumerate(texts)), "transaction_id long, raw_description string")
    got = {r.raw_description: r.merchant for r in simplify_merchants(df).collect()}
    assert len(got) == len(set(texts))
    assert all(got[f"{s} {c}"] == s for s in shops for c in cities)
    assert got[f"{shops[0]} LYON 0042"] == shops[0] and got[f"{shops[1]}  Graz"] == shops[1]
    assert got["UBER* TRIP TORONTO ON"] == got["uber eats graz"] == "UBER" and got["AMZN MKTP"] == "AMAZON"
    assert got["TUBERIA"] == "TUBERIA" and got["SCHUBERT HALL"] == "SCHUBERT HALL" and got["LYON"] == "LYON"
    assert got["  "] == got["#"] == "" and got[None] is None and got["12 34"] == "12"
    assert simplify_merchants(df.limit(0)).count() == 0


def test_longest_alias_wins(spark):
    from pyspark.sql import functions as F

    from spendlens.operators.enrich import alias_words
    from spendlens.operators.merchants import alias_of

    aliases = [("BLUE", "BLUE LTD"), ("BLUE BIRD", "BIRD INC"), ("BLUE BIRD CAFE", "CAFE")]
    df = spark.createDataFrame([(t,) for t in ("blue bird cafe x", "BLUE BIRD", "blue-bird house", "BLUE CAFE", "BLUEBIRD", "")], "t string")
    got = [r[0] for r in df.select(alias_of(alias_words(F.col("t")), aliases)).collect()]
    assert got == ["CAFE", "BIRD INC", "BIRD INC", "BLUE LTD", None, None]


def test_alias_inside_a_word_is_none(spark):
    from pyspark.sql import functions as F

    from spendlens.operators.enrich import normalise_merchant

    df = spark.createDataFrame([("SCHUBERT HALL",), ("TUBERIA",), ("UBER* TRIP",), ("x*paypal",), ("APPLE.COM/BILL",), ("Netflix.com",), ("ÉUBER",)], "t string")
    got = [r[0] for r in df.select(normalise_merchant(F.col("t"))).collect()]
    assert got == ["SCHUBERT HALL", "TUBERIA", "UBER", "PAYPAL", "APPLE", "NETFLIX", "ÉUBER"]


def test_the_state_is_merged_in_one_read(spark):
    from spendlens.operators.recurring import STATE, merged_state

    parts = [(1, "GYM", [24289, 24290], 2, 20, 10, 10, 3), (1, "GYM", [24290, 24291], 2, 20, 10, 10, 3), (2, "BAR", [], 1, 5, 5, 5, 4)]
    names = STATE.fieldNames()
    rows = spark.createDataFrame(parts, "user_id long, merchant string, months array<int>, n_transactions long, total int, least int, "
                                 "greatest int, user_bucket int")
    state = merged_state(rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in STATE.fields]))
    got = {r.user_id: (sorted(r.months), r.n_transactions, float(r.total), r.is_recurring) for r in state.collect()}
    assert got == {1: ([24289, 24290, 24291], 4, 40.0, True), 2: ([], 1, 5.0, False)} and names[2] == "months"
    assert "Join" not in state._jdf.queryExecution().executedPlan().toString()


def test_statements_are_extracted_once_for_an_ingest(spark):
    """The rows of the dedup come from the stored extraction, not from the texts a second time."""
    from unittest import mock

    from spendlens.operators import dedup
    from spendlens.operators.statement_lines import statement_ingest
    from spendlens.schema import TRANSACTIONS

    text = "Card holder: Ada Doe\nCredit Limit: $1,000.00\nAvailable Credit: $500.00\nJan 05 Jan 06 TEA ROOM 12.50"
    docs = spark.createDataFrame([("d1", 1, text, 2024, 1)],
                                 "doc_id string, user_id long, text string, statement_year int, statement_month int")
    with mock.patch.object(dedup, "new_rows", side_effect=dedup.new_rows) as called:
        rows = statement_ingest(docs, spark.createDataFrame([], TRANSACTIONS)).collect()
    plan = called.call_args[0][0]._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "regexp" not in plan
    assert [(r.transaction_id, r.user_id, float(r.amount_spent), r.is_subscription) for r in rows] == [(1, 1, 12.5, False)]


def test_words_are_cut_at_every_character_but_letters_digits_ampersand_and_dot(spark):
    from spendlens.operators.enrich import _phrase, padded_words

    texts = ["A&W.CO-1/2", "x:@y[z]{~}", "caf\u00e9 \U0001f355pizza", "\x00\x1fB%'(+,", "..&", "", "\U0010ffffQ"]
    want = [" " + " ".join("".join(c if c in "&." or (c.isascii() and c.isalnum()) else " " for c in t.upper()).split()) + " " for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in sorted(df.select("i", padded_words(F.col("t"))).collect())] == want
    assert [f" {_phrase(t)} " for t in texts] == want


def test_the_words_of_a_statement_line_are_cut_once_for_all_aliases(spark):
    from spendlens.operators.enrich import ALIAS_SPLIT_RE
    from spendlens.operators.statement_lines import statement_records

    docs = spark.createDataFrame([("d", 1, 2024, 3, "Mar 01 Mar 02 NETFLIX.COM 5.00")],
                                 "doc_id string, user_id long, statement_year int, statement_month int, text string")
    records = statement_records(docs)
    assert records._jdf.queryExecution().optimizedPlan().toString().count(ALIAS_SPLIT_RE) == 1
    assert records.first().activity_description == "NETFLIX"
