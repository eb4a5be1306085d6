import datetime as dt
import os
import subprocess
import sys
import uuid
from decimal import Decimal

import pytest

from spendlens.schema import TRANSACTIONS
from spendlens.session import checkpoint_root
from spendlens.sources.tables import (create_tables, drop_tables, latest_users_version, read_transactions,
                                      read_users, refresh_tables, truncate_tables, user_history, write_transactions,
                                      write_users_snapshot)


def _row(i, user, d):
    return (i, user, "c", "f", "l", "", d, d, "X", "c", "s", Decimal("1.00"), None, None, False,
            d.month if d else None, d.day if d else None, d.strftime("%B") if d else None,
            d.strftime("%A") if d else None, d.year if d else None)


def test_store_roundtrip_ddl_and_versions(spark):
    root = f"{checkpoint_root(spark)}/test-store-{uuid.uuid4().hex[:8]}"
    rows = [_row(1, 1, dt.datetime(2023, 5, 1)), _row(2, 2, dt.datetime(2024, 6, 2)), _row(3, 1, None)]
    write_transactions(spark.createDataFrame(rows, TRANSACTIONS), f"{root}/transactions", mode="errorifexists")
    tx = read_transactions(spark, f"{root}/transactions")
    assert tx.count() == 3
    assert tx.filter("year IS NULL").count() == 1  # undated rows read back from the default partition
    assert sorted(r.transaction_id for r in user_history(tx, 1).collect()) == [1, 3]

    name = f"tx_{uuid.uuid4().hex[:6]}"
    create_tables(spark, root, tx_name=name, users_name=f"u_{name}")
    create_tables(spark, root, tx_name=name, users_name=f"u_{name}")  # IF NOT EXISTS
    assert spark.table(name).count() == 3 and spark.table(f"u_{name}").count() == 0

    assert latest_users_version(spark, root) == 0 and read_users(spark, root).count() == 0
    users = spark.createDataFrame([(1, "a@x", "A", None)], "user_id long, email string, display_name string, picture_url string")
    assert write_users_snapshot(spark, root, users) == 1
    assert write_users_snapshot(spark, root, read_users(spark, root).union(users.selectExpr("2L", "'b@x'", "'B'", "NULL"))) == 2
    assert read_users(spark, root).count() == 2
    refresh_tables(spark, root, tx_name=name, users_name=f"u_{name}")
    assert spark.table(f"u_{name}").count() == 2

    truncate_tables(spark, root, tx_name=name, users_name=f"u_{name}")
    assert spark.table(name).count() == 0 and spark.table(f"u_{name}").count() == 0
    assert read_users(spark, root).count() == 0
    write_transactions(spark.createDataFrame(rows[:2], TRANSACTIONS), f"{root}/transactions")
    refresh_tables(spark, root, tx_name=name, users_name=f"u_{name}")
    assert spark.table(name).count() == 2
    drop_tables(spark, root, tx_name=name, users_name=f"u_{name}")
    assert not spark.catalog.tableExists(name)
    assert not os.path.exists(f"{root.removeprefix('file:')}/transactions")


def test_scratch_is_shared_or_refused(spark, monkeypatch):
    from spendlens import session

    class Cluster:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())
    Cluster.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())
    path = session.scratch_path(spark, "x")
    assert spark.sparkContext.applicationId in path and path != session.scratch_path(spark, "x")


def test_scratch_goes_with_the_driver(tmp_path):
    code = (
        "from spendlens.session import get_session, scratch_path\n"
        "s = get_session('local[1]')\n"
        f"s.sparkContext.setCheckpointDir('{tmp_path}')\n"
        "p = scratch_path(s, 'x'); s.range(3).write.parquet(p); print(s.read.parquet(p).count()); s.stop()\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120,
                         cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == "3", out.stderr[-500:]
    assert [f for _, _, files in os.walk(tmp_path) for f in files if f.endswith(".parquet")] == []


def test_read_text_documents(spark, tmp_path):
    from spendlens.sources.statements import read_text_documents

    (tmp_path / "a.txt").write_text("Jan 01 Jan 02 UBER 1.00\nline two\n")
    (tmp_path / "b.txt").write_text("")
    docs = {r.doc_id.rsplit("/", 1)[-1]: r.text for r in read_text_documents(spark, str(tmp_path)).collect()}
    assert docs == {"a.txt": "Jan 01 Jan 02 UBER 1.00\nline two\n"}  # empty files yield no document


def test_stored_max_from_footers(spark, sf_small):
    from pyspark.sql import functions as F

    from spendlens.session import scratch_path
    from spendlens.sources.tables import stored_max, write_transactions
    from spendlens.sources.testdata import tx_from_tables

    path = scratch_path(spark, "maxid")
    write_transactions(tx_from_tables(spark, sf_small), path, mode="errorifexists")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    stored = spark.read.parquet(path)
    assert stored_max(spark, path, "transaction_id") == stored.select(F.max("transaction_id")).first()[0]
    in_1996 = stored.filter("year = 1996").select(F.max("transaction_id")).first()[0]
    assert stored_max(spark, path, "transaction_id", F.col("year") == 1996) == in_1996
    assert stored_max(spark, path, "transaction_id", F.col("year") == 1800) is None
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before


def test_one_users_rows_lie_in_one_bucket(spark, sf_small):
    """A user's lookup and an upload's dedup read the folders of their buckets only."""
    from pyspark.sql import functions as F

    from spendlens.operators.dedup import new_rows, stored_keys
    from spendlens.session import scratch_path
    from spendlens.sources.tables import read_transactions, user_bucket, user_buckets
    from spendlens.sources.testdata import tx_from_tables

    path = scratch_path(spark, "buckets")
    write_transactions(tx_from_tables(spark, sf_small), path, mode="errorifexists")
    tx = read_transactions(spark, path, with_bucket=True)
    users = [r.user_id for r in tx.select("user_id").distinct().limit(5).collect()]
    for u in users:
        mine = tx.select(user_bucket(F.lit(u), user_buckets(spark))).first()[0]
        files = tx.filter(F.col("user_id") == u).select(F.input_file_name().alias("f")).distinct().collect()
        assert files and all(f"user_bucket={mine}/" in r.f for r in files)
        got = user_history(tx, u)
        assert f"user_bucket#" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
        assert got.count() == tx.filter(F.col("user_id") == u).count()
    upload = tx.filter(F.col("user_id") == users[0]).drop("user_bucket").withColumn("amount_spent", F.col("amount_spent") + 1)
    upload = upload.unionByName(tx.filter(F.col("user_id") == users[1]).drop("user_bucket"))
    keys, _ = stored_keys(upload, tx)
    assert "user_bucket" in keys._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert new_rows(upload, tx).count() == tx.filter(F.col("user_id") == users[0]).count()
