from spendlens.operators.users import upsert_users, user_ids


def test_upsert_cases(spark):
    users = spark.createDataFrame(
        [(1, "a@x", "A", "pa"), (2, "b@x", "B", "pb"), (3, "c@x", "C", "pc")],
        "user_id long, email string, display_name string, picture_url string",
    )
    updates = spark.createDataFrame(
        [
            ("a@x", "A2", "pa2", 1),  # known email, new name
            ("b@x", None, None, 2),  # known email, null name overwrites
            ("d@x", "D", "pd", 3),  # new email
            ("c@x", "C1", "pc1", 4),  # two updates: last wins
            ("c@x", "C2", "pc2", 5),
        ],
        "email string, display_name string, picture_url string, seq long",
    )
    snap = {r.email: r for r in upsert_users(users, updates).collect()}
    assert (snap["a@x"].user_id, snap["a@x"].display_name, snap["a@x"].picture_url) == (1, "A2", "pa2")
    assert (snap["b@x"].user_id, snap["b@x"].display_name, snap["b@x"].picture_url) == (2, None, None)
    assert (snap["c@x"].user_id, snap["c@x"].display_name) == (3, "C2")
    assert snap["d@x"].is_new and snap["d@x"].user_id > 3 and not snap["a@x"].is_new
    ids = user_ids(users, spark.createDataFrame([("b@x",)], "email string")).collect()
    assert [r.user_id for r in ids] == [2]


def test_bucketed_store_rewrites_touched_buckets_only(spark):
    import os
    import uuid

    import pytest

    from spendlens.operators.users import user_ids
    from spendlens.session import checkpoint_root
    from spendlens.sources import user_store as U

    path = f"{checkpoint_root(spark)}/test-user-store-{uuid.uuid4().hex[:8]}/users"
    U.create_user_store(spark, path, 16)
    assert U.read_user_store(spark, path).count() == 0
    known = spark.createDataFrame([(i, f"u{i}@x.org", f"N{i}", None) for i in range(1, 101)],
                                  "user_id long, email string, display_name string, picture_url string")
    U.load_user_store(spark, path, known)
    schema = "email string, display_name string, picture_url string, seq long"
    before = U._holders(spark, path)
    n = U.upsert_user_store(spark, path, spark.createDataFrame(
        [("u7@x.org", "old", None, 1), ("u7@x.org", None, "pic", 2), ("new@x.org", "New", None, 1), (None, "none", None, 9)], schema))
    after = U._holders(spark, path)
    assert n in (1, 2) and sum(before.get(b) != f for b, f in after.items()) == n
    assert all(os.path.isdir(f.removeprefix("file:")) for f in after.values())
    rows = {r.email: r for r in U.read_user_store(spark, path).collect()}
    assert len(rows) == 101 and (rows["u7@x.org"].user_id, rows["u7@x.org"].display_name, rows["u7@x.org"].picture_url) == (7, None, "pic")
    assert rows["new@x.org"].user_id > 100 and rows["u8@x.org"].display_name == "N8"
    # A second new user, in whatever bucket, gets an id above all.
    U.upsert_user_store(spark, path, spark.createDataFrame([("newer@x.org", "Newer", None, 1)], schema))
    emails = spark.createDataFrame([("newer@x.org",), ("u9@x.org",), ("no@x.org",)], "email string")
    few = U.read_user_store(spark, path, emails)
    assert few.count() < 60
    ids = {r.email: r.user_id for r in user_ids(few, emails).collect()}
    assert ids["u9@x.org"] == 9 and ids["newer@x.org"] > rows["new@x.org"].user_id and len(ids) == 2
    # An upsert of every bucket takes the place of all markers before it.
    U.upsert_user_store(spark, path, spark.createDataFrame([(f"u{i}@x.org", "same", None, 1) for i in range(1, 101)], schema))
    assert len(U.commits.committed(spark, path)) == 1 and U.read_user_store(spark, path).count() == 102
    # Written but not committed: nothing changes.
    def lost(*args, **kwargs):
        raise RuntimeError("writer lost")

    with pytest.MonkeyPatch.context() as m:
        m.setattr(U.commits, "create_small", lost)
        with pytest.raises(RuntimeError):
            U.upsert_user_store(spark, path, spark.createDataFrame([("u1@x.org", "lost", None, 1)], schema))
    assert U.read_user_store(spark, path).filter("display_name = 'lost'").count() == 0
    assert U.upsert_user_store(spark, path, spark.createDataFrame([], schema)) == 0
