import datetime as dt
from decimal import Decimal

from spendlens.operators.dedup import dedup_report, new_rows, rows_to_insert

D = dt.datetime(2024, 1, 15)
SCHEMA = "transaction_id long, user_id long, transaction_date timestamp_ntz, activity_description string, amount_spent decimal(18,2)"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _new(spark, incoming, stored, limit=None):
    kw = {} if limit is None else {"broadcast_limit": limit}
    return sorted((r.user_id, r.activity_description) for r in new_rows(_df(spark, incoming), _df(spark, stored), **kw).collect())


def test_dedup_cases(spark):
    stored = [
        (1, 1, D, "Coffee", Decimal("5.00")),
        (2, 1, None, None, None),
        (3, 1, D, "a-", Decimal("5.00")),
        (4, 1, D, "tea", Decimal("3.00")),
    ]
    incoming = [
        (None, 1, D, "  COFFEE ", Decimal("5")),  # case/padding differ, 5 == 5.00 -> skipped
        (None, 2, D, "Coffee", Decimal("5.00")),  # other user -> inserted
        (None, 1, None, None, None),  # nulls equal stored nulls -> skipped
        (None, 1, D, "a", Decimal("-5.00")),  # would collide as a string key -> inserted
        (None, 1, D, "tea", Decimal("3.00")),  # two equal rows, one stored -> both skipped
        (None, 1, D, "tea", Decimal("3.00")),
        (None, 1, D, "new", Decimal("1.00")),  # two equal rows, none stored -> both inserted
        (None, 1, D, "new", Decimal("1.00")),
    ]
    expected = [(1, "a"), (1, "new"), (1, "new"), (2, "Coffee")]
    assert _new(spark, incoming, stored) == expected
    # Same result through the shuffled plan (no broadcast reduction).
    assert _new(spark, incoming, stored, limit=0) == expected


def test_report_and_ids(spark):
    stored = _df(spark, [(10, 1, D, "x", Decimal("1.00"))])
    inc = _df(spark, [(None, 1, D, "x", Decimal("1.00")), (None, 1, D, "y", Decimal("2.00"))])
    rep = dedup_report(inc, stored).collect()
    assert [(r.user_id, r.incoming, r.inserted, r.skipped) for r in rep] == [(1, 2, 1, 1)]
    # Rows to insert carry ids above the stored maximum.
    from spendlens.functions import clean_transactions

    ins = rows_to_insert(clean_transactions(inc.drop("transaction_id").withColumns({
        "customer_id": inc.activity_description, "f_name": inc.activity_description, "l_name": inc.activity_description,
        "address": inc.activity_description, "posting_date": inc.transaction_date, "category": inc.activity_description,
        "sub_category": inc.activity_description, "credit_limit": inc.amount_spent, "available_credit": inc.amount_spent,
        "is_subscription": inc.activity_description.isNull()})), stored).collect()
    assert len(ins) == 1 and ins[0].transaction_id > 10


def test_reingest_inserts_nothing(spark):
    rows = [(1, 1, D, "x", Decimal("1.00")), (2, 1, D, "x", Decimal("1.00"))]
    assert new_rows(_df(spark, rows), _df(spark, rows)).count() == 0
