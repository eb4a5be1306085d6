import os
import uuid

from spendlens.session import checkpoint_root
from spendlens.sources.tables import read_transactions
from spendlens.streaming.ingest import ingest_batch, run_ingest_stream

REC = ('{"activity_description": "%s", "amount_spent": "%s", "transaction_date": "01-1%d-2024", '
       '"is_subscription": "false"}')


def _doc(doc_id, user, *recs):
    return (doc_id, user, "```json\n[" + ",".join(REC % r for r in recs) + "]\n```")


def test_stream_ingest_and_replay(spark):
    root = f"{checkpoint_root(spark)}/test-ingest-{uuid.uuid4().hex[:8]}"
    docs = spark.createDataFrame(
        [_doc("d1", 1, ("COFFEE", "3.50", 1), ("COFFEE", "3.50", 1)), _doc("d2", 2, ("BOOK", "20", 2))],
        "doc_id string, user_id long, text string")
    docs.write.json(f"{root}/landing")
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt")
    assert read_transactions(spark, f"{root}/tx").count() == 3  # equal rows in one upload are both kept
    # Same files again with a fresh checkpoint: the documents are known, nothing is added.
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt2")
    tx = read_transactions(spark, f"{root}/tx")
    assert tx.count() == 3 and tx.select("transaction_id").distinct().count() == 3


def test_uploads_split_over_batches_and_replayed(spark):
    root = f"{checkpoint_root(spark)}/test-upload-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    # Upload 1 arrives in two batches, each holding one of two equal rows: both are kept.
    b0 = spark.createDataFrame([_doc("a", 1, ("TEA", "2.00", 1)) + (1,)], schema)
    b1 = spark.createDataFrame([_doc("b", 1, ("TEA", "2.00", 1)) + (1,),
                                # Upload 2 in the same batch re-sends the row: skipped.
                                _doc("c", 1, ("TEA", "2.00", 1), ("NEW", "1.00", 1)) + (2,)], schema)
    tx_path, log_path = f"{root}/tx", f"{root}/log"
    ingest_batch(b0, tx_path, log_path, 0)
    ingest_batch(b1, tx_path, log_path, 1)
    got = sorted((r.activity_description, float(r.amount_spent)) for r in read_transactions(spark, tx_path).collect())
    assert got == [("NEW", 1.0), ("TEA", 2.0), ("TEA", 2.0)]
    # Replaying batch 1 (a failure after its write) changes nothing.
    ingest_batch(b1, tx_path, log_path, 1)
    again = read_transactions(spark, tx_path)
    assert sorted((r.activity_description, float(r.amount_spent)) for r in again.collect()) == got
    assert again.select("transaction_id").distinct().count() == 3


def test_ids_ascend_across_batches_from_the_log_mark(spark):
    """Each batch records its highest id in the ingest log; the next batch starts above it
    without scanning the stored ids, and a replay reuses the same base."""
    from pyspark.sql import functions as F

    root = f"{checkpoint_root(spark)}/test-ids-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    b0 = spark.createDataFrame([_doc("a", 1, ("TEA", "2.00", 1), ("BUN", "1.00", 1)) + (1,)], schema)
    b1 = spark.createDataFrame([_doc("b", 2, ("MILK", "3.00", 2)) + (2,)], schema)
    tx_path, log_path = f"{root}/tx", f"{root}/log"
    ingest_batch(b0, tx_path, log_path, 0)
    ingest_batch(b1, tx_path, log_path, 1)
    ingest_batch(b1, tx_path, log_path, 1)  # replay
    tx = read_transactions(spark, tx_path)
    ids = {r.activity_description: r.transaction_id for r in tx.collect()}
    assert len(ids) == 3 and tx.count() == 3
    assert ids["MILK"] > max(ids["TEA"], ids["BUN"])
    marks = spark.read.parquet(log_path).groupBy("ingest_batch").agg(F.max("max_id").alias("m")).collect()
    assert sorted(r.m for r in marks) == sorted([max(ids["TEA"], ids["BUN"]), ids["MILK"]])


def test_same_bytes_of_two_users_and_quarantine(spark):
    """Bytes are skipped per user; what is no answer is kept aside and looked at again."""
    from spendlens.streaming.ingest import read_quarantine

    root = f"{checkpoint_root(spark)}/test-users-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    tx_path, log_path = f"{root}/tx", f"{root}/log"
    text = _doc("a", 1, ("TEA", "2.00", 1))[2]
    bad = [("x", 1, "not json", 1), ("y", 1, text + " thanks", 1), ("z", None, "[null]", 1), ("e", 1, "[]", 1), ("n", 2, None, 1)]
    ingest_batch(spark.createDataFrame([("a", 1, text, 1), *bad], schema), tx_path, log_path, 0)
    ingest_batch(spark.createDataFrame([("b", 2, text, 2), ("c", 1, text, 2)], schema), tx_path, log_path, 1)
    assert sorted(r.user_id for r in read_transactions(spark, tx_path).collect()) == [1, 2]
    kept = sorted((r.doc_id, r.reason) for r in read_quarantine(spark, log_path).collect())
    assert kept == [("n", "empty"), ("x", "not_an_array"), ("y", "malformed"), ("z", "null_record")]
    log = {r.doc_id for r in spark.read.parquet(log_path).collect()}
    assert log == {"a", "b", "e"}
    # A repeated failure is reported again, not taken for done.
    ingest_batch(spark.createDataFrame([("x2", 1, "not json", 3)], schema), tx_path, log_path, 2)
    assert read_quarantine(spark, log_path).filter("doc_id = 'x2'").count() == 1


def test_unnumbered_files_are_one_upload_whatever_the_trigger(spark):
    got = []
    for limit in (1, 64):
        root = f"{checkpoint_root(spark)}/test-trigger-{uuid.uuid4().hex[:8]}"
        docs = spark.createDataFrame([_doc("d1", 1, ("COFFEE", "3.50", 1)), _doc("d2", 1, ("COFFEE", "3.50", 1), ("BOOK", "9", 2))],
                                     "doc_id string, user_id long, text string")
        docs.repartition(2, "doc_id").write.json(f"{root}/landing")
        with open(f"{root.removeprefix('file:')}/landing/part-broken.json", "w") as f:
            f.write('{"doc_id": "d3", "user_id": 1, "text": "[]"\n')
        run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt", max_files_per_trigger=limit)
        got.append(sorted(r.activity_description for r in read_transactions(spark, f"{root}/tx").collect()))
        from spendlens.streaming.ingest import read_quarantine
        assert [r.reason for r in read_quarantine(spark, f"{root}/log").collect()] == ["broken_line"]
    assert got[0] == got[1] == ["BOOK", "COFFEE", "COFFEE"]


def test_ids_follow_the_statement_order(spark):
    from spendlens.sources.tables import assign_ids

    rows = spark.range(0, 500).selectExpr("(id * 7919) % 500 AS k").repartition(7)
    out = assign_ids(rows, rows, "tid", base=40, order=["k"]).collect()
    assert sorted((r.k, r.tid) for r in out) == [(k, 41 + k) for k in range(500)]
    assert assign_ids(rows.limit(0), rows, "tid", base=0, order=["k"]).count() == 0


def test_compaction_keeps_rows_ids_and_dedup(spark):
    from spendlens.streaming.ingest import compact

    root = f"{checkpoint_root(spark)}/test-compact-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    tx_path, log_path = f"{root}/tx", f"{root}/log"
    for n in range(5):
        rows = [_doc(f"d{n}-{u}", u, (f"SHOP{n}", "2.00", n), ("SAME", "1.00", 1)) + (n,) for u in (1, 2)]
        ingest_batch(spark.createDataFrame(rows, schema), tx_path, log_path, n)
    before = sorted(map(tuple, read_transactions(spark, tx_path).collect()), key=str)
    assert len(before) == 12  # five shops of two users, and the shared row once per user
    assert compact(spark, tx_path) == 4
    assert sorted(map(tuple, read_transactions(spark, tx_path).collect()), key=str) == before
    assert len([d for d in os.listdir(tx_path.removeprefix("file:")) if d.startswith("ingest_batch=")]) == 2
    # The newest batch may still be replayed, and later uploads see the compacted rows.
    ingest_batch(spark.createDataFrame(rows, schema), tx_path, log_path, 4)
    ingest_batch(spark.createDataFrame([_doc("late", 1, ("SHOP0", "2.00", 0)) + (9,)], schema), tx_path, log_path, 5)
    assert sorted(map(tuple, read_transactions(spark, tx_path).collect()), key=str) == before
    assert compact(spark, tx_path) in (0, 2)


def _steps(monkeypatch, stop_at):
    """Make the writer stop before its ``stop_at``-th write, commit or removal; returns the count."""
    from spendlens.sources import commits
    from spendlens.streaming import ingest

    count = [0]

    def counted(fn):
        def step(*args, **kwargs):
            count[0] += 1
            if count[0] == stop_at:
                raise RuntimeError("writer lost")
            return fn(*args, **kwargs)

        return step

    monkeypatch.setattr(ingest, "_write", counted(ingest._write))
    for name in ("commit", "remove", "create_small"):
        monkeypatch.setattr(commits, name, counted(getattr(commits, name)))
    return count


def _copied(base):
    """A copy of a store, as the paths of its table and log."""
    import shutil

    root = f"{base}-{uuid.uuid4().hex[:8]}"
    shutil.copytree(base.removeprefix("file:"), root.removeprefix("file:"))
    for name, other in (("tx_commits/.log", "log"), ("log_table", "tx")):
        with open(f"{root.removeprefix('file:')}/{name}", "w") as f:
            f.write(f"{root}/{other}")
        crc = f"{root.removeprefix('file:')}/{name}".rsplit("/", 1)
        if os.path.exists(f"{crc[0]}/.{crc[1]}.crc"):
            os.remove(f"{crc[0]}/.{crc[1]}.crc")
    return f"{root}/tx", f"{root}/log"


def _everything(spark, tx_path, log_path):
    from spendlens.streaming.ingest import read_quarantine, recurring_state

    rows = sorted(map(tuple, read_transactions(spark, tx_path).collect()), key=str)
    aside = sorted((r.doc_id, r.reason) for r in read_quarantine(spark, log_path).collect())
    state = sorted((r.user_id, r.merchant, sorted(r.months), r.n_transactions, r.total, r.is_recurring)
                   for r in recurring_state(spark, tx_path).collect())
    return rows, aside, state


def test_a_writer_stopped_at_any_step_shows_all_of_a_batch_or_nothing(spark, monkeypatch):
    schema = "doc_id string, user_id long, text string, upload_id long"
    first = spark.createDataFrame([_doc("a", 1, ("TEA", "2.00", 1)) + (1,), ("x", 1, "no json", 1)], schema)
    second = spark.createDataFrame([_doc("b", 1, ("TEA", "2.00", 1), ("BUN", "1.00", 2)) + (2,), ("y", 2, "no json", 2)], schema)

    base = f"{checkpoint_root(spark)}/test-atomic-{uuid.uuid4().hex[:8]}"
    ingest_batch(first, f"{base}/tx", f"{base}/log", 0)
    old = _everything(spark, f"{base}/tx", f"{base}/log")

    def store():
        return _copied(base)

    whole = store()
    ingest_batch(second, *whole, 1)
    new = _everything(spark, *whole)
    assert len(old[0]) == 1 and len(new[0]) == 2
    stopped = 0
    for at in range(1, 20):
        paths = store()
        with monkeypatch.context() as m:
            count = _steps(m, at)
            try:
                ingest_batch(second, *paths, 1)
            except RuntimeError:
                stopped += 1
        if count[0] < at:
            break
        # Stopped before the commit: the old rows, and the replay gives the new ones.
        assert _everything(spark, *paths) in (old, new)
        if at in (3, 6):
            ingest_batch(second, *paths, 1)
            assert _everything(spark, *paths) == new
    assert stopped >= 5


def test_a_compaction_stopped_at_any_step_changes_no_rows(spark, monkeypatch):
    from spendlens.streaming.ingest import compact

    schema = "doc_id string, user_id long, text string, upload_id long"
    batches = [
        spark.createDataFrame([_doc(f"d{n}", 1, (f"SHOP{n}", "2.00", n), ("GYM", "5.00", n)) + (n,), (f"x{n}", 1, "bad", n)], schema)
        for n in range(3)
    ]
    late = spark.createDataFrame([_doc("late", 1, ("SHOP0", "2.00", 0)) + (9,)], schema)
    base = f"{checkpoint_root(spark)}/test-swap-{uuid.uuid4().hex[:8]}"
    for n, docs in enumerate(batches):
        ingest_batch(docs, f"{base}/tx", f"{base}/log", n)
    before = _everything(spark, f"{base}/tx", f"{base}/log")
    stopped = 0
    for at in (2, 4, 5, 6, 8, 40):
        tx_path, log_path = _copied(base)
        root = tx_path.rpartition("/")[0]
        with monkeypatch.context() as m:
            _steps(m, at)
            try:
                compact(spark, tx_path)
            except RuntimeError:
                stopped += 1
        assert _everything(spark, tx_path, log_path) == before
        # A replay of a compacted batch does nothing; the next compaction removes what was left.
        ingest_batch(batches[0], tx_path, log_path, 0)
        compact(spark, tx_path)
        assert _everything(spark, tx_path, log_path) == before
        local = root.removeprefix("file:")
        for name in ("tx", "log", "log_quarantine", "tx_recurring", "tx_digests", "tx_rollup"):
            assert len([d for d in os.listdir(f"{local}/{name}") if d.startswith("ingest_batch=")]) == 2
    ingest_batch(late, tx_path, log_path, 5)
    assert _everything(spark, tx_path, log_path) == before
    assert stopped >= 4


def test_the_log_is_pruned_by_the_digests_of_a_batch(spark):
    from spendlens.sources import commits
    from spendlens.streaming import ingest

    root = f"{checkpoint_root(spark)}/test-log-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    docs = spark.createDataFrame([_doc(f"d{i}", i, (f"S{i}", "1.00", 1)) + (1,) for i in range(40)], schema)
    ingest_batch(docs, f"{root}/tx", f"{root}/log", 0)
    log = commits.read_committed(spark, f"{root}/log", "log", ingest.LOG_SCHEMA, commits.committed(spark, f"{root}/tx"))
    assert log.select("sha_prefix").distinct().count() > 5
    one = docs.limit(1).selectExpr("*", "sha2(text, 256) AS content_sha")
    plan = ingest._unseen_documents(one, log)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "sha_prefix" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert ingest._unseen_documents(one, log).count() == 0


def _statement(user, period, *lines):
    return "\n".join([f"Account: {user}", f"Statement period: {period}", "Card holder: Ada Doe",
                      "Credit Limit: $1,000.00", "Available Credit: $500.00", *lines])


def test_statement_files_to_rows(spark):
    """Statements of several in a file, broken lines and headers, replays, and charges that become
    recurring with a later upload."""
    from spendlens.streaming.ingest import read_quarantine, read_with_recurring, run_statement_stream

    root = f"{checkpoint_root(spark)}/test-statements-{uuid.uuid4().hex[:8]}"
    local = root.removeprefix("file:")
    args = (f"{root}/landing", f"{root}/tx", f"{root}/log")

    def land(upload, name, text):
        os.makedirs(f"{local}/landing/upload_id={upload}", exist_ok=True)
        with open(f"{local}/landing/upload_id={upload}/{name}", "w") as f:
            f.write(text)

    land(1, "a.txt", "\f\n".join([
        _statement(7, "2024-01", "Jan 03 Jan 04 UBER EATS TORONTO 20.00", "Jan 05 Jan 06 STREAMCO 9.99", "Jan 05 Jan 07 BROKEN x.yz"),
        _statement(8, "2024-01", "Jan 02 Jan 03 SCHUBERT HALL 30.00 CR"), ""]))
    land(1, "b.txt", "no header\nJan 05 Jan 06 STREAMCO 9.99")
    land(1, "c.txt", "  \n")
    run_statement_stream(spark, *args, f"{root}/ckpt")
    land(2, "d.txt", _statement(7, "2024-03", "Jan 05 Jan 06 STREAMCO 9.99", "Feb 05 Feb 06 STREAMCO 9.99", "Mar 05 Mar 06 STREAMCO 9.99"))
    run_statement_stream(spark, *args, f"{root}/ckpt")
    run_statement_stream(spark, *args, f"{root}/ckpt-fresh")  # all files again: nothing is added
    rows = sorted((r.user_id, r.activity_description, str(r.transaction_date)[:10], float(r.amount_spent), r.is_subscription,
                   r.sub_category) for r in read_with_recurring(spark, f"{root}/tx").collect())
    assert rows == [
        (7, "STREAMCO", "2024-01-05", 9.99, True, "Other"),
        (7, "STREAMCO", "2024-02-05", 9.99, True, "Other"),
        (7, "STREAMCO", "2024-03-05", 9.99, True, "Other"),
        (7, "UBER", "2024-01-03", 20.0, False, "Dining Out"),
        (8, "SCHUBERT HALL", "2024-01-02", -30.0, False, "Other"),
    ]
    stored = read_transactions(spark, f"{root}/tx")
    assert stored.select("transaction_id").distinct().count() == 5
    reasons = sorted({(r.reason, r.text.strip()[:9]) for r in read_quarantine(spark, f"{root}/log").collect()})
    assert reasons == [("empty", ""), ("no_account", "no header"), ("unparsed_line", "Jan 05 Ja")]


def test_recurring_state_is_not_read_from_the_rows(spark):
    from spendlens.operators.enrich import recurring_merchants
    from spendlens.streaming.ingest import recurring_state

    root = f"{checkpoint_root(spark)}/test-state-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    rec = '{"activity_description": "%s", "amount_spent": "%s", "transaction_date": "%s"}'
    for n in range(4):
        records = [rec % ("GYM", "30.00", f"0{n + 1}-02-2024"), rec % ("SHOP", f"{n + 1}.50", f"0{n + 1}-03-2024"),
                   rec % ("GYM", "30.00", "bad date"), rec % ("REFUND", "-3", "01-01-2024")]
        docs = [(f"d{n}-{u}", u, "[" + ",".join(records) + "]", n) for u in (1, 2)]
        ingest_batch(spark.createDataFrame(docs, schema), f"{root}/tx", f"{root}/log", n)
    state = recurring_state(spark, f"{root}/tx")
    files = {f.rsplit("/", 4)[-4].split("=")[0] + "/" + f for f in state.inputFiles()}
    assert files and all("tx_recurring" in f for f in files)
    want = recurring_merchants(read_transactions(spark, f"{root}/tx"))
    got = state.selectExpr("user_id", "merchant", "size(months) AS n_months", "n_transactions", "is_recurring")
    want = want.selectExpr("user_id", "merchant", "n_months", "n_transactions", "is_recurring")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.merchant, r.is_recurring) for r in got.collect()} == {("GYM", True), ("SHOP", False)}
    # The state of one user is read from that user's folders.
    plan = state.filter("user_bucket = 3")._jdf.queryExecution().executedPlan().toString()
    assert "user_bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_rows_that_break_a_constraint_are_put_aside(spark):
    from spendlens.sources import commits
    from spendlens.streaming.ingest import read_quarantine

    root = f"{checkpoint_root(spark)}/test-constraints-{uuid.uuid4().hex[:8]}"
    long = "x" * 101
    records = ['{"activity_description": "OK", "amount_spent": "1"}', '{"f_name": "%s", "amount_spent": "2"}' % long,
               '{"amount_spent": "1e17"}', '{"amount_spent": "inf"}', '{"amount_spent": "3", "credit_limit": "-99999999999999999"}']
    docs = [("a", 1, "[" + ",".join(records) + "]", 1), ("b", None, "[" + records[0] + "]", 1), ("c", 9, "[" + records[0] + "]", 1)]
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    df = spark.createDataFrame(docs, "doc_id string, user_id long, text string, upload_id long")
    ingest_batch(df, f"{root}/tx", f"{root}/log", 0, users=users)
    stored = read_transactions(spark, f"{root}/tx").collect()
    assert sorted(str((r.user_id, r.activity_description)) for r in stored) == ["(1, 'OK')", "(1, None)"]
    aside = sorted((r.doc_id, r.reason) for r in read_quarantine(spark, f"{root}/log").collect())
    assert aside == [("a", "f_name_too_long"), ("a", "out_of_range"), ("a", "out_of_range"), ("b", "null_user_id"), ("c", "unknown_user")]
    (marker,) = commits.committed(spark, f"{root}/tx")
    assert marker["counts"] == {"f_name_too_long": 1, "out_of_range": 2, "null_user_id": 1, "unknown_user": 1}


def test_history_is_read_only_where_a_digest_is_found(spark):
    from spendlens.operators.dedup import KEY_DIGESTS, candidate_history
    from spendlens.sources import commits
    from spendlens.streaming import ingest

    root = f"{checkpoint_root(spark)}/test-digests-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    docs = [_doc(f"d{u}", u, ("TEA", "2.00", 1), (f"S{u}", "3.00", 2)) + (1,) for u in range(30)]
    ingest_batch(spark.createDataFrame(docs, schema), f"{root}/tx", f"{root}/log", 0)
    markers = commits.committed(spark, f"{root}/tx")
    digests = commits.read_committed(spark, f"{root}/tx_digests", "digests", KEY_DIGESTS, markers)
    history = ingest.read_stored(spark, f"{root}/tx", markers)
    assert digests.count() == 60

    def upload(*docs):
        return ingest._answer_rows(spark.createDataFrame([d + (2,) for d in docs], schema))

    fresh = candidate_history(upload(_doc("n", 3, ("NEW", "1.00", 1))), digests, history)
    assert fresh.isEmpty() and "FileScan" not in fresh._jdf.queryExecution().executedPlan().toString()
    again = candidate_history(upload(_doc("n", 3, ("tea ", "2.00", 1)), _doc("m", 8, ("NEW", "1.00", 1))), digests, history)
    assert sorted({r.user_id for r in again.collect()}) == [3]
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "user_bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    # through the ingest: the stored row is skipped, the new one is added
    again_docs = [_doc("n", 3, ("tea ", "2.00", 1), ("NEW", "1.00", 1)) + (2,)]
    ingest_batch(spark.createDataFrame(again_docs, schema), f"{root}/tx", f"{root}/log", 1)
    assert read_transactions(spark, f"{root}/tx").count() == 61


def test_dashboard_from_the_rollup_of_several_batches(spark):
    """The same figures as from the rows, zero amounts and equal rows included, without reading them;
    a compaction adds the batches up."""
    from spendlens.operators import analytics as A
    from spendlens.streaming.ingest import compact, read_rollup

    root = f"{checkpoint_root(spark)}/test-rollup-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    for n in range(3):
        docs = [_doc(f"d{n}-{u}", u, (f"SHOP{n}", "2.00", 1), (f"SHOP{n}", "2.00", 1), ("BACK", f"-{n}.25", 2), ("FREE", "0", 3)) + (n,)
                for u in (1, 2)]
        ingest_batch(spark.createDataFrame(docs, schema), f"{root}/tx", f"{root}/log", n)
    outputs = [lambda d: A.overview(d, ["user_id"]), A.daily_series, A.monthly_totals, A.category_totals,
               lambda d: A.top_merchants(d, 10, ["user_id"]), lambda d: A.weekday_totals(d, ["user_id"])]
    want = [sorted(map(str, f(A.period_filter(read_transactions(spark, f"{root}/tx"))).collect())) for f in outputs]
    for _ in range(2):
        rollup = read_rollup(spark, f"{root}/tx")
        assert all("tx_rollup" in f for f in rollup.inputFiles())
        assert [sorted(map(str, f(A.period_filter(rollup)).collect())) for f in outputs] == want
        compact(spark, f"{root}/tx")
    assert A.overview(rollup, ["user_id"]).first().active_days == 3


def _files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def test_many_small_files_are_one_batch_with_a_file_per_folder(spark):
    from spendlens.sources import commits

    root = f"{checkpoint_root(spark)}/test-small-files-{uuid.uuid4().hex[:8]}"
    docs = [_doc(f"d{u}", u, ("TEA", "2.00", 1), (f"S{u}", "3.00", 2)) for u in range(140)]
    docs = spark.createDataFrame(docs, "doc_id string, user_id long, text string")
    docs.write.option("maxRecordsPerFile", 2).json(f"{root}/landing/upload_id=1")
    run_ingest_stream(spark, f"{root}/landing", f"{root}/tx", f"{root}/log", f"{root}/ckpt")
    assert len(commits.committed(spark, f"{root}/tx")) == 1  # by files there would be two
    assert read_transactions(spark, f"{root}/tx").count() == 280
    for path in ("log", "tx_digests", "tx_recurring", "tx_rollup"):
        files = _files(f"{root}/{path}")
        assert len(files) == len({os.path.dirname(f) for f in files}) <= 16


def test_texts_and_rows_pass_unjoined_where_nothing_came_before(spark):
    from pyspark.sql import functions as F

    from spendlens.operators.dedup import new_rows_by_upload
    from spendlens.sources import commits
    from spendlens.streaming import ingest

    root = f"{checkpoint_root(spark)}/test-unjoined-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    docs = spark.createDataFrame([_doc(f"d{i}", i, (f"S{i}", "1.00", 1)) + (2,) for i in range(5)], schema)
    ingest_batch(docs, f"{root}/tx", f"{root}/log", 0)
    log = commits.read_committed(spark, f"{root}/log", "log", ingest.LOG_SCHEMA, commits.committed(spark, f"{root}/tx"))
    hashed = docs.withColumn("content_sha", F.sha2("text", 256))
    other = hashed.withColumn("user_id", F.col("user_id") + 100)
    assert "Join" not in ingest._unseen_documents(other, log)._jdf.queryExecution().executedPlan().toString()
    # Known: the same document of the upload, and the bytes of an earlier upload, named or not.
    mixed = hashed.withColumn("upload_id", F.when(F.col("user_id") < 2, 2).otherwise(F.col("user_id") - 1).cast("long"))
    mixed = mixed.withColumn("doc_id", F.when(F.col("user_id") != 4, F.col("doc_id")))
    left = sorted((r.user_id, r.upload_id) for r in ingest._unseen_documents(mixed.unionByName(other), log).collect())
    assert left == [(2, 1), *[(u, 2) for u in range(100, 105)]]
    rows = ingest._answer_rows(other.drop("content_sha"))
    new = new_rows_by_upload(rows, ingest.read_stored(spark, f"{root}/tx"), broadcast_limit=1)
    assert "Join" not in new._jdf.queryExecution().executedPlan().toString() and new.count() == 5


def test_neither_log_nor_texts_are_shuffled_for_many_known_documents(spark, monkeypatch):
    from pyspark.sql import functions as F

    from spendlens.sources import commits
    from spendlens.streaming import ingest

    root = f"{checkpoint_root(spark)}/test-known-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    docs = spark.createDataFrame([_doc(f"d{i}", i, (f"S{i}", "1.00", 1)) + (2,) for i in range(6)], schema)
    ingest_batch(docs, f"{root}/tx", f"{root}/log", 0)
    log = commits.read_committed(spark, f"{root}/log", "log", ingest.LOG_SCHEMA, commits.committed(spark, f"{root}/tx"))
    hashed = docs.withColumn("content_sha", F.sha2("text", 256))
    again = hashed.withColumn("upload_id", F.when(F.col("user_id") == 1, 1).otherwise(3).cast("long"))
    again = again.withColumn("doc_id", F.when(F.col("user_id") != 4, F.concat(F.lit("again-"), "doc_id")))
    mixed = again.unionByName(hashed.filter("user_id < 2")).unionByName(hashed.withColumn("user_id", F.col("user_id") + 100))
    want = [(1, 1), *[(u, 2) for u in range(100, 106)]]
    monkeypatch.setattr(ingest, "LOG_BROADCAST_LIMIT", 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = ingest._unseen_documents(mixed, log)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert [line for line in plan.splitlines() if "LeftAnti" in line and "SortMergeJoin" in line] == []
        assert sorted((r.user_id, r.upload_id) for r in left.collect()) == want
        # Beyond the bound of the broadcasts, and with a mark that hits too many, the join is the exact one.
        exact = ingest._unseen_documents(mixed, log, broadcast_limit=3)
        assert "SortMergeJoin" in exact._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.user_id, r.upload_id) for r in exact.collect()) == want
        with monkeypatch.context() as m:
            m.setattr(ingest.F, "xxhash64", lambda *cols: F.lit(7).cast("long"))
            clash = ingest._unseen_documents(mixed, log)
            assert sorted((r.user_id, r.upload_id) for r in clash.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_tables_of_a_batch_are_written_side_by_side(spark, monkeypatch):
    import threading

    from spendlens.streaming import ingest

    root = f"{checkpoint_root(spark)}/test-side-{uuid.uuid4().hex[:8]}"
    docs = spark.createDataFrame([_doc("a", 1, ("TEA", "2.00", 1))], "doc_id string, user_id long, text string")
    all_at_once, write = threading.Barrier(6), ingest._write

    def waiting(*args):
        all_at_once.wait(60)
        write(*args)

    monkeypatch.setattr(ingest, "_write", waiting)
    ingest_batch(docs, f"{root}/tx", f"{root}/log", 0)
    assert read_transactions(spark, f"{root}/tx").count() == 1


def test_the_rollup_is_read_without_a_shuffle(spark):
    from spendlens.operators import analytics as A
    from spendlens.streaming.ingest import read_rollup

    root = f"{checkpoint_root(spark)}/test-rollup-plan-{uuid.uuid4().hex[:8]}"
    schema = "doc_id string, user_id long, text string, upload_id long"
    for n in (1, 2):  # the same key in two batches, with another amount
        docs = spark.createDataFrame([_doc(f"d{n}", 1, ("TEA", f"{n}.50", 1), ("BACK", f"-{n}.00", 1)) + (n,)], schema)
        ingest_batch(docs, f"{root}/tx", f"{root}/log", n)
    rollup = read_rollup(spark, f"{root}/tx")
    assert "Exchange" not in rollup._jdf.queryExecution().executedPlan().toString()
    top = A.top_merchants(A.period_filter(rollup), 10, ["user_id"]).collect()
    assert [r.transaction_count for r in top if "TEA" in tuple(r)] == [2]
    assert A.overview(rollup, ["user_id"]).first().active_days == 1
