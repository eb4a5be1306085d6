"""Physical-plan shape checks: the scale properties the operators are built for."""

import datetime as dt
from decimal import Decimal

import pytest

from spendlens.operators import analytics as A
from spendlens.operators.dedup import new_rows
from spendlens.operators.running import running_available_credit
from spendlens.operators.users import upsert_users
from spendlens.plans.context import tx_table
from spendlens.sources.tables import user_history


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tx(spark, sf_small):
    return tx_table(spark, sf_small)


def test_top_k_per_user_limits_before_shuffle(tx):
    plan = _plan(A.top_transactions(tx, 10, ["user_id"]))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_overview_has_no_expand(tx):
    plan = _plan(A.overview(tx, ["user_id"]))
    assert "Expand" not in plan and "HashAggregate" in plan


def test_running_credit_uses_hash_aggregates(tx):
    plan = _plan(running_available_credit(tx))  # no hot user: one shuffle and a window
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    plan = _plan(running_available_credit(tx, hot_rows=0))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_user_lookup_and_period_filter_push_down(tx):
    scan = _plan(user_history(tx, 42))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,42)]" in scan
    pruned = _plan(A.period_filter(tx, [1996], ["March"]))
    assert "PartitionFilters: [isnotnull(year" in pruned and "(year" in pruned


def test_dedup_streams_history_through_broadcast_semi_join(spark):
    d = dt.datetime(2024, 1, 1)
    schema = "transaction_id long, user_id long, transaction_date timestamp_ntz, activity_description string, amount_spent decimal(18,2)"
    hist = spark.createDataFrame([(i, i % 7, d, "x", Decimal("1.00")) for i in range(50)], schema)
    inc = spark.createDataFrame([(None, 1, d, "x", Decimal("1.00"))], schema)
    plan = _plan(new_rows(inc, hist))
    assert "LeftSemi" in plan and "LeftAnti" in plan
    assert plan.count("BroadcastExchange") >= 2  # upload keys into the semi-join, matched keys into the anti-join


def test_upsert_merges_once(spark):
    users = spark.createDataFrame([(1, "a@x", "A", None)], "user_id long, email string, display_name string, picture_url string")
    upd = spark.createDataFrame([("a@x", "B", None, 1)], "email string, display_name string, picture_url string, seq long")
    plan = _plan(upsert_users(users, upd))
    assert plan.count("FullOuter") == 1 and "Union" not in plan


def test_dedup_pushes_the_upload_user_range_into_the_history_scan(tx):
    """History read from Parquet: only the upload's user range is scanned (row groups of
    other users are skipped by their statistics)."""
    upload = tx.filter("user_id between 100 and 120")
    scan = _plan(new_rows(upload, tx))
    assert "GreaterThanOrEqual(user_id,100)" in scan and "LessThanOrEqual(user_id,120)" in scan
