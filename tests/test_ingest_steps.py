"""Steps of an ingest batch: lines cut once, keys of one upload not shuffled, ids as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD = "Card holder: Ann Lee\nCredit Limit: $1,000.00\nAvailable Credit: $100.00\n"


def _plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_that_do_not_parse_come_with_the_rows_and_no_line_is_shuffled(spark):
    from spendlens.operators.statement_lines import UNPARSED, statement_reasons, statement_records, unparsed_lines

    texts = {
        "a": HEAD + "Jan 03 Jan 04 BROKEN\nJan 05 Jan 06 TEA 2.00\nJan 07 Jan 08 CUT\nJan 09 Jan 10 RENT 30.00",
        "b": HEAD + "Jan 05 Jan 06 TEA 5.00 CR\nJan 07 Jan 08 TEA 1.00",
        "c": " \r\n\t ",
    }
    rows = [(d, 1, t, 7, 2024, 1) for d, t in texts.items()]
    schema = "doc_id string, user_id long, text string, upload_id long, statement_year int, statement_month int"
    docs = spark.createDataFrame(rows, schema).repartition(3, "doc_id")
    assert {r.doc_id: r.reason for r in statement_reasons(docs).collect()} == {"a": None, "b": None, "c": "empty"}
    both = statement_records(docs, unparsed=True)
    assert _plan(both).count("Exchange") == 1  # that of the documents
    plain = statement_records(docs)
    got = both.filter(f"{UNPARSED} is null").drop(UNPARSED)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # A line that does not parse is not the first of its statement and changes no running credit.
    assert [r.available_credit for r in got.filter("doc_id = 'a'").orderBy("position").collect()] == [Decimal("100.00"), Decimal("130.00")]
    aside = [(r.doc_id, r.position, r[UNPARSED]) for r in both.filter(f"{UNPARSED} is not null").collect()]
    assert sorted(aside) == sorted((r.doc_id, r.position, r.line) for r in unparsed_lines(docs).collect())
    assert [a[2] for a in sorted(aside)] == ["Jan 03 Jan 04 BROKEN", "Jan 07 Jan 08 CUT"]


def test_keys_of_one_upload_are_not_shuffled(spark, monkeypatch):
    from spendlens.operators.dedup import new_rows_by_upload

    schema = "user_id long, transaction_date timestamp_ntz, activity_description string, amount_spent decimal(18,2), upload_id long"

    def rows(*found):
        return spark.sql("select timestamp_ntz'2024-01-05' as d").crossJoin(
            spark.createDataFrame(list(found), "user_id long, desc string, upload_id long")
        ).selectExpr("user_id", "d as transaction_date", "desc as activity_description",
                     "cast(1 as decimal(18,2)) as amount_spent", "upload_id").to(spark.createDataFrame([], schema).schema)

    frame = type(spark.range(0))
    unions, union = [], frame.unionByName
    monkeypatch.setattr(frame, "unionByName", lambda *a, **k: unions.append(1) or union(*a, **k))
    stored = rows((1, "TEA", 1), (1, "RENT", 3), (2, "OLD", None), (3, "TEA", 5), (3, "TEA", 2))
    own = rows((1, "tea ", 3), (1, "RENT", 3), (1, "RENT", 3), (2, "OLD", 3), (3, "TEA", 3), (1, "NEW", 3), (4, "TEA", 3))
    new = [(r.user_id, r.activity_description) for r in new_rows_by_upload(own, stored).collect()]
    assert sorted(new) == [(1, "NEW"), (1, "RENT"), (1, "RENT"), (4, "TEA")]
    assert not unions
    # Several uploads, or an upload not known, are compared among themselves.
    mixed = rows((1, "NEW", 3), (1, "NEW", 4), (5, "X", None))
    new = [(r.user_id, r.upload_id) for r in new_rows_by_upload(mixed, stored).collect()]
    assert sorted(new, key=str) == [(1, 3), (5, None)] and unions


def test_ids_are_read_without_the_other_columns(spark):
    from spendlens.sources.tables import assign_ids

    rows = spark.range(0, 50, 1, 4).selectExpr("49 - id as k", "cast(id as string) as text")
    out = assign_ids(rows, rows, "tid", base=10, order=["k"])
    plan = _plan(out.selectExpr("max(tid)"))
    assert "text" not in plan.split("ReadSchema: ", 1)[1].split(">", 1)[0]
    assert [(r.k, r.tid) for r in out.orderBy("k").collect()] == [(k, k + 11) for k in range(50)]


def test_the_state_tables_of_a_batch_take_one_shuffle(spark, monkeypatch):
    import uuid

    from spendlens.session import checkpoint_root
    from spendlens.streaming import ingest

    plans, write = {}, ingest._write
    monkeypatch.setattr(ingest, "_write", lambda df, path, *a: plans.update({path.rpartition("/")[2]: _plan(df)}) or write(df, path, *a))
    root = f"{checkpoint_root(spark)}/test-one-shuffle-{uuid.uuid4().hex[:8]}"
    text = '[{"activity_description": "TEA", "amount_spent": "2.00", "transaction_date": "01-05-2024"}]'
    docs = spark.createDataFrame([("a", 1, text)], "doc_id string, user_id long, text string")
    ingest.ingest_batch(docs, f"{root}/tx", f"{root}/log", 0)
    assert {t: plans[t].count("Exchange") for t in ("tx_recurring", "tx_digests", "tx_rollup")} == {
        "tx_recurring": 1, "tx_digests": 1, "tx_rollup": 1}
    assert ingest.read_rollup(spark, f"{root}/tx").count() == 1


def test_a_named_month_is_dated_as_by_the_date_pattern(spark):
    from spendlens.operators.statement_lines import complete_date

    days = [f"{m} {d}" for m in ("Jan", "Feb", "Apr", "Sep", "Dec", "Abc", "JAN", "anF") for d in ("1", "01", "29", "30", "31", "0", "32", " 5", "5 ", "5x", "", "100")]
    rows = [(md, y) for md in [*days, "", None, "Jan", "Janu 5"] for y in (2023, 2024, 1999, 999, 10000, 0, None)]
    df = spark.createDataFrame(rows, "md string, y int")
    pattern = F.to_date(F.try_to_timestamp(F.concat("md", F.lit(" "), F.col("y").cast("string")), F.lit("MMM d yyyy")))
    got = df.select("md", "y", F.to_date(complete_date(F.col("md"), F.col("y"), None)).alias("d"), pattern.alias("want")).collect()
    assert [r for r in got if r.d != r.want] == []
    assert sum(r.d is not None for r in got) > 50


def test_no_pattern_is_compiled_per_statement_line(spark):
    """``split`` by more than a character compiles its pattern for every value; the holder's names are
    found once per statement, before its lines."""
    from spendlens.operators.enrich import alias_words, padded_alias_words
    from spendlens.operators.statement_lines import HOLDER_NAMES_RE, statement_records

    docs = spark.createDataFrame([("d", 1, 2024, 3, "Card holder: Ada B Doe\nMar 01 Mar 02 GYM  #3 5.00\nMar 02 Mar 03 A*B 6.00")],
                                 "doc_id string, user_id long, statement_year int, statement_month int, text string")
    records = statement_records(docs)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "split(upper" not in plan and "split(trim" not in plan
    assert plan.rindex("Generate") < plan.index(HOLDER_NAMES_RE)  # a plan reads from the last step to the first
    got = [(r.activity_description, r.f_name, r.l_name, r.customer_id) for r in records.orderBy("position").collect()]
    assert got == [("GYM", "Ada", "B Doe", "ada_b doe"), ("A", "Ada", "B Doe", "ada_b doe")]
    texts = ["", "  ", "a", " .a--b ", "É1 x", "#", None, "a b\nc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    joined = F.concat(F.lit(" "), F.array_join(alias_words(F.col("t")), " "), F.lit(" "))
    assert [r for r in df.select(padded_alias_words(F.col("t")).alias("a"), joined.alias("b")).collect() if r.a != r.b] == []


def test_the_keys_of_a_batch_are_profiled_in_one_pass(spark, tmp_path):
    from unittest import mock

    from spendlens.operators import dedup
    from spendlens.streaming import ingest

    def docs(n, text):
        return spark.createDataFrame([(f"d{n}", 1, f'[{{"activity_description": "{text}", "amount_spent": "1.00", "transaction_date": "01-05-2024"}}]', n)],
                                     "doc_id string, user_id long, text string, upload_id long")
    passes = mock.Mock(side_effect=dedup.key_profile)
    with mock.patch.object(ingest, "key_profile", passes), mock.patch.object(dedup, "key_profile", passes):
        for n, text in enumerate(("TEA", "TEA ", "GYM")):
            ingest.ingest_batch(docs(n, text), f"{tmp_path}/tx", f"{tmp_path}/log", n)
    assert passes.call_count == 3
    rows = ingest.read_stored(spark, f"{tmp_path}/tx").collect()
    assert sorted((r.activity_description, r.upload_id) for r in rows) == [("GYM", 2), ("TEA", 0)]
