import datetime as dt
from decimal import Decimal

import pytest

from spendlens.operators import analytics as A
from spendlens.schema import TRANSACTIONS

D = dt.datetime


def _tx(spark, rows):
    """rows: (id, user, date, desc, category, sub, amount, is_sub)."""
    full = []
    for i, u, d, desc, cat, sub, amt, sb in rows:
        y = d.year if d else None
        m = d.month if d else None
        mn = d.strftime("%B") if d else None
        dw = d.strftime("%A") if d else None
        full.append((i, u, "c", "f", "l", "", d, d, desc, cat, sub, None if amt is None else Decimal(amt), None, None, sb,
                     m, d.day if d else None, mn, dw, y))
    return spark.createDataFrame(full, TRANSACTIONS)


@pytest.fixture(scope="module")
def tx(spark):
    return _tx(spark, [
        (1, 1, D(2023, 1, 2), "A", "Food", "Groceries", "10.00", False),
        (2, 1, D(2024, 1, 3), "B", "Food", "Dining", "20.00", True),
        (3, 1, D(2024, 1, 3), "C", None, None, "-5.00", False),
        (4, 1, D(2024, 3, 4), "D", "Fun", "Games", "0.00", False),
        (5, 1, D(2024, 3, 5), "E", "Fun", "Games", None, False),
        (6, 2, D(2024, 2, 6), "A", "Food", "Groceries", "7.50", True),
    ])


def test_overview_counts_zero_and_null_days(spark, tx):
    r = {x.user_id: x for x in A.overview(A.period_filter(tx), ["user_id"]).collect()}[1]
    assert r.active_days == 4 and r.total_spending == 30.0 and r.total_payments == 5.0 and r.balance == 25.0
    assert r.avg_daily_spend == 7.5 and r.avg_daily_payments == 1.25


def test_overview_empty_selection_gives_zeros(spark, tx):
    r = A.overview(A.period_filter(tx, [2024], [])).collect()
    assert len(r) == 1 and (r[0].active_days, r[0].total_spending, r[0].avg_daily_spend) == (0, 0.0, 0.0)
    assert A.period_filter(tx, [], ["January"]).count() == 0


def test_cards_text(spark):
    ov = spark.createDataFrame([(1234.5, 0.0, 1234.5, 0.125, 0.0), (0.0, 3.0, -3.0, 0.0, 1.5)],
                               "total_spending double, total_payments double, balance double, "
                               "avg_daily_spend double, avg_daily_payments double")
    rows = A.overview_cards(ov).collect()
    assert (rows[0].total_spending_text, rows[0].balance_caption) == ("$1,234.50", "+$1,234.50 (Owing)")
    assert (rows[1].balance_text, rows[1].balance_caption) == ("$-3.00", "$-3.00 (Credit)")


def test_month_names_add_across_years_and_missing_months_absent(spark, tx):
    rows = {(r.kind, r.month_name): r.total for r in A.monthly_totals(tx).collect()}
    assert rows[("Expenses", "January")] == 30.0 and rows[("Payments", "January")] == 5.0
    assert ("Expenses", "March") not in rows  # zero/null amounts are neither kind
    assert all(r.month_no for r in A.monthly_totals(tx).collect())


def test_null_category_dropped_and_sums_agree(spark, tx):
    cats = {r.category: r.total_spent for r in A.category_totals(tx).collect()}
    assert None not in cats and cats == {"Food": 37.5}
    daily = sum(r.daily_spending or 0 for r in A.daily_series(tx).collect())
    ov = A.overview(tx).first()
    assert daily == ov.total_spending == sum(cats.values())


def test_top_k_ties_break_by_key(spark):
    rows = [(i, 1, D(2024, 1, 1), f"M{i:02d}", "c", "s", "5.00", False) for i in range(12)]
    top = A.top_transactions(_tx(spark, rows), 10).collect()
    assert [r.transaction_id for r in sorted(top, key=lambda r: r.rank)] == list(range(10))
    merch = A.top_merchants(_tx(spark, rows), 10, ["user_id"]).collect()
    assert sorted(r.merchant for r in merch) == [f"M{i:02d}" for i in range(10)]


def test_subcategory_share_is_of_top_k(spark, tx):
    rows = A.subcategory_top(tx, 1).collect()
    assert len(rows) == 1 and rows[0].share == 1.0


def test_approx_days_close_to_exact(spark, tx):
    exact = A.overview(A.period_filter(tx), ["user_id"]).orderBy("user_id").collect()
    approx = A.overview(A.period_filter(tx), ["user_id"], approx_days=True).orderBy("user_id").collect()
    assert [r.active_days for r in exact] == [r.active_days for r in approx]
    assert [r.total_spending for r in exact] == [r.total_spending for r in approx]


def test_dashboard_shares_one_selection(spark, tx):
    from spendlens.plans.dashboard import Dashboard

    with Dashboard(tx, years=[2024], months=["January", "March"], by=["user_id"]) as d:
        outs = {k: sorted(map(tuple, v.collect())) for k, v in d.all().items()}
        assert d.selection.is_cached
    sel = A.period_filter(tx, [2024], ["January", "March"])
    assert outs["overview"] == sorted(map(tuple, A.overview(sel, ["user_id"]).collect()))
    assert outs["categories"] == sorted(map(tuple, A.category_totals(sel, ["user_id"]).collect()))
    assert not d.selection.is_cached
