import datetime as dt

from spendlens.functions import clean_transactions
from spendlens.operators.statement_lines import statement_rows
from spendlens.sources.extraction import extraction_quarantine, extraction_rows
from spendlens.sources.statements import assemble_documents, empty_documents

REC = '{"activity_description": "UBER", "amount_spent": 12.5, "transaction_date": "01-15-2024", "is_subscription": true}'


def test_document_shapes(spark):
    docs = spark.createDataFrame(
        [
            ("array", f"[{REC}, {REC}]"),
            ("empty", "[]"),
            ("fenced", f"```json\n[{REC}]\n```"),
            ("object", REC),
            ("malformed", "[{oops"),
            ("mixed", f"[{REC}, 5]"),
            ("trailing", f"[{REC}] thanks"),
            ("two", f"[{REC}], [{REC}]"),
            ("quotes", "[{'amount_spent': '5'}]"),
            ("null", f"[null, {REC}]"),
            ("blank", "  "),
        ],
        "doc_id string, text string",
    )
    rows = clean_transactions(extraction_rows(docs))
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {"array": 2, "fenced": 1}
    r = rows.filter("doc_id = 'fenced'").first()
    assert float(r.amount_spent) == 12.5 and r.is_subscription and r.transaction_date == dt.datetime(2024, 1, 15)
    q = {r.doc_id: r.reason for r in extraction_quarantine(docs).collect()}
    assert q == {"object": "not_an_array", "malformed": "malformed", "mixed": "malformed",
                 "trailing": "malformed", "two": "malformed", "quotes": "malformed", "null": "null_record", "blank": "empty"}


def test_pages_and_lines(spark):
    pages = spark.createDataFrame(
        [
            ("d1", 2, "Dec 31 Jan 02 SHOP  TORONTO 1,234.50\nJan 03 Jan 04 REFUND 5.00 CR\n"),
            ("d1", 1, "Credit Limit: $5,000.00\nAvailable Credit: $4,200.10\nDec 30 Dec 31 UBER* TRIP 12.50\n"),
            ("d2", 1, ""),
            ("d3", 1, "nothing here\n"),
        ],
        "doc_id string, page_no int, text string",
    )
    docs = assemble_documents(pages)
    assert {r.doc_id for r in docs.collect()} == {"d1", "d3"}
    assert [r.doc_id for r in empty_documents(pages).collect()] == ["d2"]
    docs = docs.selectExpr("*", "2024 AS statement_year", "1 AS statement_month")
    rows = sorted(statement_rows(docs).collect(), key=lambda r: r.position)
    assert [r.raw_description for r in rows] == ["UBER* TRIP", "SHOP  TORONTO", "REFUND"]
    assert [float(r.amount_spent) for r in rows] == [12.5, 1234.5, -5.0]
    assert rows[0].transaction_date == dt.datetime(2023, 12, 30)  # December of a January statement
    assert rows[2].transaction_date == dt.datetime(2024, 1, 3)
    assert float(rows[0].credit_limit) == 5000.0 and float(rows[0].statement_available_credit) == 4200.10


def test_statement_records_fill_every_column(spark):
    from spendlens.operators.statement_lines import statement_records

    docs = spark.createDataFrame(
        [("d1", 2024, 1, "Card holder: Alex Juma\\nCredit Limit: $1,000.00\\nAvailable Credit: $100.00\\n"
                        "Jan 02 Jan 03 UBER* TRIP TORONTO ON 10.00\\nJan 04 Jan 05 NETFLIX.COM 5.00\\n"
                        "Jan 06 Jan 07 PAYMENT THANK YOU 3.00 CR\\n")],
        "doc_id string, statement_year int, statement_month int, text string").selectExpr(
        "doc_id", "statement_year", "statement_month", "replace(text, '\\\\n', '\\n') AS text")
    rows = sorted(statement_records(docs).collect(), key=lambda r: r.position)
    assert [r.activity_description for r in rows] == ["UBER", "NETFLIX", "PAYMENT THANK YOU"]
    assert [(r.category, r.sub_category) for r in rows] == [
        ("Living Expenses", "Transportation"), ("Subscriptions", "Streaming"), ("Financial", "Credit Card Payments")]
    assert [float(r.available_credit) for r in rows] == [100.0, 105.0, 102.0]
    assert (rows[0].customer_id, rows[0].f_name, rows[0].l_name) == ("alex_juma", "Alex", "Juma")
    assert rows[0].address == "" and rows[0].month_name == "January"


def test_page_borders_end_lines_and_odd_lines_are_reported(spark):
    from spendlens.operators.statement_lines import unparsed_lines

    pages = spark.createDataFrame(
        [("d", 2, "Jan 03 Jan 04 LYFT $3.00\nJan 05 Jan 06 NO AMOUNT"), ("d", 1, "Jan 01 Jan 02 UBER 12.50"),
         ("d", 0, "Available Credit: $10.00"), ("e", 1, ""), ("e", 2, "")],
        "doc_id string, page_no int, text string")
    docs = assemble_documents(pages, page_end="\n").selectExpr("*", "2024 AS statement_year", "1 AS statement_month")
    assert [r.doc_id for r in docs.collect()] == ["d"]
    rows = sorted(statement_rows(docs).collect(), key=lambda r: r.position)
    assert [(r.raw_description, float(r.amount_spent)) for r in rows] == [("UBER", 12.5), ("LYFT", 3.0)]
    assert [r.line for r in unparsed_lines(docs).collect()] == ["Jan 05 Jan 06 NO AMOUNT"]


def test_one_payload_per_user_and_consecutive_parts(spark):
    import json

    from spendlens.sources.extraction import json_payloads

    df = spark.sql("SELECT id AS transaction_id, id % 2 AS user_id, TIMESTAMP_NTZ'2024-01-01' + make_interval(0, 0, 0, CAST(50 - id AS INT)) "
                   "AS transaction_date, 'x' AS activity_description FROM range(50)")
    whole = {r.user_id: [x["transaction_id"] for x in json.loads(r.payload)] for r in json_payloads(df, ["user_id"]).collect()}
    assert whole == {u: [i for i in range(49, -1, -1) if i % 2 == u] for u in (0, 1)}
    parts = json_payloads(df, ["user_id"], max_rows=10).collect()
    assert sorted((r.user_id, r.part, r.n_records) for r in parts) == [(u, p, 10 if p < 2 else 5) for u in (0, 1) for p in (0, 1, 2)]
    assert [x["transaction_id"] for r in sorted(parts, key=lambda r: r.part) if r.user_id == 0 for x in json.loads(r.payload)] == whole[0]
