import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from spendlens.functions import clean_transactions, parse_bool, parse_date, parse_money, strip_fences, utrim


def _one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_dates(spark):
    got = _one_col(spark, ["01-15-2024", " 01-15-2024", "1-5-2024", "2024-01-15", "13-01-2024", "02-30-2024", "", None],
                   parse_date)
    d = [dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 15)]
    assert got == d + [None] * 4


def test_money(spark):
    vals = ["12", " 12 ", "1e3", "+5", "-5", "2.675", "-0.001", "1,234.56", "$5", "(5.00)", "12-", "1d", "inf", "nan",
            "", None]
    got = _one_col(spark, vals, parse_money)
    exp = [Decimal("12.00"), Decimal("12.00"), Decimal("1000.00"), Decimal("5.00"), Decimal("-5.00"), Decimal("2.68"),
           Decimal("0.00")] + [None] * 9
    assert got == exp


def test_bool(spark):
    vals = ["true", "TRUE", "1", "t", "Y", "yes", " true", "1.0", "on", "0", "", None]
    assert _one_col(spark, vals, parse_bool) == [True] * 6 + [False] * 6


def test_text_trim(spark):
    got = _one_col(spark, ["  a b ", "\ta\n", " x ", "y　"], utrim)
    assert got == ["a b", "a", "x", "y"]


def test_fences(spark):
    got = _one_col(spark, ['```json\n[{"a":1}]\n```', "  [ ]  ", "json[1]"], strip_fences)
    assert [g.strip() for g in got] == ['[{"a":1}]', "[ ]", "[1]"]


def test_clean_is_idempotent_and_strips_names(spark):
    raw = spark.createDataFrame(
        [(" a ", "01-15-2024", "12.5", "yes"), ("b", "bad", "x", "0")],
        "` activity_description ` string, transaction_date string, amount_spent string, is_subscription string",
    )
    once = clean_transactions(raw)
    twice = clean_transactions(once)
    assert "activity_description" in once.columns
    assert sorted(once.collect()) == sorted(twice.collect())
    r = once.filter("activity_description = 'a'").first()
    assert (r.year, r.month, r.day, r.month_name, r.day_of_week) == (2024, 1, 15, "January", "Monday")
    bad = once.filter("activity_description = 'b'").first()
    assert bad.year is None and bad.month_name is None and bad.amount_spent is None and bad.is_subscription is False
