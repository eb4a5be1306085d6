"""One key holding a third of all rows: results stay exact and the hot key's rows are not
gathered in one task.

The fixture is the sf0.001 transactions table with every third row moved to one card holder
(user 0). Expected values come from pandas over the same rows (brute force on a small input).
"""

from __future__ import annotations

import io
from contextlib import contextmanager
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spendlens.operators import analytics as A
from spendlens.operators.running import running_available_credit
from spendlens.operators.users import latest_updates
from spendlens.sources.extraction import json_payloads
from spendlens.sources.testdata import tx_from_tables

HOT = 0


@pytest.fixture(scope="module")
def hot_tx(spark, sf_small):
    tx = tx_from_tables(spark, sf_small)
    hot = tx.withColumn("user_id", F.when(F.pmod("transaction_id", 3) == 0, F.lit(HOT).cast("long"))
                        .otherwise(F.col("user_id")))
    return hot.persist()


@pytest.fixture(scope="module")
def hot_pd(hot_tx):
    return hot_tx.toPandas()


@contextmanager
def conf(spark, **kv):
    old = {k: spark.conf.get(k, None) for k in kv}
    for k, v in kv.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_fixture_has_a_hot_user(hot_pd):
    share = (hot_pd["user_id"] == HOT).mean()
    assert 0.30 < share < 0.37


def test_running_credit_exact_under_skew(spark, hot_tx, hot_pd):
    got = running_available_credit(hot_tx, chunk_rows=16, hot_rows=50).select("transaction_id", "running_available_credit")
    got = {r.transaction_id: r.running_available_credit for r in got.collect()}

    df = hot_pd.assign(_day=hot_pd["transaction_date"].dt.normalize())
    df = df.sort_values(["user_id", "_day", "transaction_id"], na_position="last")
    want = {}
    for _, g in df.groupby("user_id", sort=False):
        first_avail, first_amt = g["available_credit"].iloc[0], g["amount_spent"].iloc[0]
        run = Decimal(0)
        for tid, amt in zip(g["transaction_id"], g["amount_spent"]):
            run += amt
            want[tid] = first_avail + run - first_amt
    assert got == want


def test_running_credit_spreads_the_hot_user(spark, hot_tx):
    """With partition coalescing off, the hot user's rows leave the final window stage from
    several tasks: for a user with more rows than ``hot_rows`` the shuffle key is (user, day,
    chunk), not the user alone."""
    with conf(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        parts = (
            running_available_credit(hot_tx, chunk_rows=16, hot_rows=50)
            .filter(F.col("user_id") == HOT)
            .select(F.spark_partition_id().alias("p"))
            .distinct()
            .count()
        )
    assert parts > 1


def test_top_k_per_user_under_skew(hot_tx, hot_pd):
    got = A.top_transactions(hot_tx, 10, ["user_id"]).select("user_id", "rank", "transaction_id").collect()
    got = {(r.user_id, r.rank): r.transaction_id for r in got}
    exp = hot_pd[hot_pd["amount_spent"] > 0].sort_values(
        ["user_id", "amount_spent", "transaction_id"], ascending=[True, False, True]
    )
    want = {}
    for uid, g in exp.groupby("user_id"):
        for rank, tid in enumerate(g["transaction_id"].head(10), start=1):
            want[(uid, rank)] = tid
    assert got == want


def test_overview_per_user_under_skew(hot_tx, hot_pd):
    got = {r.user_id: r for r in A.overview(hot_tx, ["user_id"]).collect()}
    df = hot_pd.assign(_day=hot_pd["transaction_date"].dt.date)
    for uid, g in df.groupby("user_id"):
        spend = sum((a for a in g["amount_spent"] if a > 0), Decimal(0))
        pay = sum((-a for a in g["amount_spent"] if a < 0), Decimal(0))
        r = got[uid]
        assert r.active_days == g["_day"].nunique()
        assert r.total_spending == float(spend) and r.total_payments == float(pay)
    assert len(got) == df["user_id"].nunique()


def test_latest_update_of_a_hot_email(spark, hot_tx, hot_pd):
    """One email carries a third of all updates; the highest seq wins (an aggregate with
    map-side partials, not a window over the email's updates)."""
    upd = hot_tx.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("activity_description").alias("display_name"),
        F.col("address").alias("picture_url"),
        F.col("transaction_id").alias("seq"),
    )
    got = {r.email: r.display_name for r in latest_updates(upd).collect()}
    last = hot_pd.sort_values("transaction_id").groupby("user_id").tail(1)
    want = {f"u{u}@example.com": d for u, d in zip(last["user_id"], last["activity_description"])}
    assert got == want
    plan = latest_updates(upd)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_payloads_bounded_and_whole_under_skew(hot_tx, hot_pd):
    out = json_payloads(hot_tx, ["user_id"], max_rows=50).collect()
    assert max(r.n_records for r in out) <= 50
    assert sum(r.n_records for r in out) == len(hot_pd)
    hot_docs = [r for r in out if r.user_id == HOT]
    assert len(hot_docs) > 1
    ids = sorted(int(i) for r in hot_docs for i in pd.read_json(io.StringIO(r.payload))["transaction_id"])
    assert ids == sorted(hot_pd.loc[hot_pd["user_id"] == HOT, "transaction_id"].tolist())


def test_recurring_flags_split_a_hot_merchant(spark, hot_tx):
    """One (user, merchant) pair with a third of the rows: the join back salts it over several
    pieces (small piece size stands in for a large table) and the flags equal the plain join."""
    from spendlens.operators.enrich import flag_recurring, recurring_merchants

    is_hot = F.col("user_id") == HOT
    hot = hot_tx.withColumns({
        "activity_description": F.when(is_hot, F.lit("NETFLIX")).otherwise(F.col("activity_description")),
        # One price: the hot pair is recurring.
        "amount_spent": F.when(is_hot & (F.col("amount_spent") > 0), F.lit(15.99).cast("decimal(18,2)"))
        .otherwise(F.col("amount_spent")),
    })
    rec = recurring_merchants(hot).select("user_id", F.col("merchant").alias("activity_description"), "is_recurring")
    plain = hot.join(rec.withColumnRenamed("is_recurring", "_r"), ["user_id", "activity_description"], "left")
    want = {r.transaction_id: bool(r._r) and r.amount_spent > 0 for r in plain.collect()}
    with conf(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false",
                        "spark.sql.autoBroadcastJoinThreshold": "-1",
                        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        flagged = flag_recurring(hot, max_hot_keys=4, piece_rows=20)
        got = {r.transaction_id: r.is_recurring for r in flagged.collect()}
        parts = flagged.filter(F.col("user_id") == HOT).select(F.spark_partition_id()).distinct().count()
    assert got == want and len(got) == hot.count()
    assert any(want.values())
    assert parts > 1


def test_semi_and_anti_joins_split_a_hot_user(spark, hot_tx, hot_pd):
    """The batch history lookup (semi-join) and the dedup anti-join beyond the broadcast limit
    hand AQE two plain shuffles, so it splits the hot user's partition (small thresholds
    stand in for a large table)."""
    from spendlens.operators.dedup import dedup_report, new_rows
    from spendlens.sources.tables import users_history

    from spendlens.session import scratch_path

    path = scratch_path(spark, "hot")
    hot_tx.repartition(8).write.parquet(path)
    rows = spark.read.parquet(path)  # several files: several map tasks, as a large scan has
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        # Many map tasks feed each join at scale; here coalescing would leave one.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    with conf(spark, **settings):
        hist = users_history(rows, hot_tx.filter(F.col("year") == 1998))
        assert hist.count() == len(hot_pd[hot_pd["user_id"].isin(hot_pd.loc[hot_pd["year"] == 1998, "user_id"])])
        hist.collect()
        assert "skew=true" in hist._jdf.queryExecution().executedPlan().toString()

        # A hot dedup key: the hot user's upload repeats one transaction (a third of the rows).
        same = F.col("user_id") == HOT
        incoming = rows.withColumns({
            "transaction_date": F.when(same, F.lit("1998-03-02").cast("timestamp_ntz")).otherwise(F.col("transaction_date")),
            "activity_description": F.when(same, F.lit("COFFEE")).otherwise(F.col("activity_description")),
            "amount_spent": F.when(same, F.lit(3.5).cast("decimal(18,2)")).otherwise(F.col("amount_spent")),
        })
        stored = incoming.filter(F.col("transaction_date") < F.lit("1997-01-01").cast("timestamp_ntz"))
        shuffled = new_rows(incoming, stored, broadcast_limit=1)  # beyond the limit: shuffled anti-join
        got = sorted(r.transaction_id for r in shuffled.collect())
        assert "skew=true" in shuffled._jdf.queryExecution().executedPlan().toString()
        # The report pre-aggregates per key, so its joins see unique keys on both sides.
        rep = sorted(tuple(r) for r in dedup_report(incoming, stored, broadcast_limit=1).collect())
    assert rep == sorted(tuple(r) for r in dedup_report(incoming, stored).collect())
    hot_rep = [r for r in rep if r[0] == HOT]
    assert hot_rep == [(HOT, int((hot_pd["user_id"] == HOT).sum()), int((hot_pd["user_id"] == HOT).sum()), 0)]
    broadcast = sorted(r.transaction_id for r in new_rows(incoming, stored).collect())
    assert got == broadcast
    assert len(got) == int((hot_pd["transaction_date"] >= "1997-01-01").sum()) + int((hot_pd["user_id"] == HOT).sum()) \
        - int(((hot_pd["user_id"] == HOT) & (hot_pd["transaction_date"] >= "1997-01-01")).sum())


def test_identical_hot_rows_survive_the_shuffled_dedup(spark, hot_tx):
    """One transaction repeated byte-for-byte: beyond the broadcast limit the copies are
    collapsed per input split before the joins and expanded after them; every copy is kept
    (new rows) and flagged (duplicate flags)."""
    from collections import Counter

    from spendlens.operators.dedup import new_rows

    same = F.col("user_id") == HOT
    one = hot_tx.filter(same).orderBy("transaction_id").limit(1)
    copies = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(400))).alias("_n")).drop("_n")
    incoming = hot_tx.filter(~same).unionByName(copies).repartition(8)
    stored = hot_tx.filter(~same & (F.col("transaction_date") < F.lit("1997-01-01").cast("timestamp_ntz")))
    shuffled = Counter(r.transaction_id for r in new_rows(incoming, stored, broadcast_limit=1).collect())
    broadcast = Counter(r.transaction_id for r in new_rows(incoming, stored).collect())
    assert shuffled == broadcast
    hot_id = one.first().transaction_id
    assert shuffled[hot_id] == 400

    from spendlens.operators.dedup import flag_duplicates

    def flags(limit):
        return Counter((r.transaction_id, r.is_duplicate) for r in flag_duplicates(incoming, stored, limit).collect())

    assert flags(1) == flags(2_000_000)
    assert flags(1)[(hot_id, False)] == 400


def test_upload_dedup_same_on_shuffled_and_broadcast_paths(spark, hot_tx):
    """Uploads as the dedup unit, with one transaction repeated 300 times in upload 1 and again
    in upload 2: both paths keep upload 1's copies, skip upload 2's, and agree row for row."""
    from collections import Counter

    from spendlens.operators.dedup import new_rows_by_upload

    same = F.col("user_id") == HOT
    one = hot_tx.filter(same).orderBy("transaction_id").limit(1)
    rep = one.select("*", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("_n")).drop("_n")
    incoming = (
        hot_tx.filter(~same).withColumn("upload_id", F.pmod("transaction_id", 2) + 1)
        .unionByName(rep.withColumn("upload_id", F.lit(1).cast("long")))
        .unionByName(rep.withColumn("upload_id", F.lit(2).cast("long")))
        .repartition(8)
    )
    stored = hot_tx.filter(~same & (F.col("transaction_date") < F.lit("1996-01-01").cast("timestamp_ntz"))) \
        .withColumn("upload_id", F.lit(None).cast("long"))
    shuffled = Counter((r.transaction_id, r.upload_id) for r in new_rows_by_upload(incoming, stored, broadcast_limit=1).collect())
    broadcast = Counter((r.transaction_id, r.upload_id) for r in new_rows_by_upload(incoming, stored).collect())
    assert shuffled == broadcast
    hot_id = one.first().transaction_id
    assert shuffled[(hot_id, 1)] == 300 and shuffled[(hot_id, 2)] == 0
