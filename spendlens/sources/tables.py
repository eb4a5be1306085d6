"""Parquet-backed transactions and users tables.

Layout of ``transactions``: directories by ``year`` (period filters prune them) and, below, by
``user_bucket``, a hash of the user in ``spendlens.user.buckets`` values (per-user reads and the
dedup of an upload prune those), files of about the advisory partition size, rows sorted by
(user_id, transaction_id) inside each file, so a per-user scan skips row groups by their min/max
statistics. One directory per user would not scale. Rows without a date live in the default
partition of the year and read back with a null year.

Parquet paths cannot be merged in place and a query may not overwrite a path it reads, so
the users table is versioned: an upsert writes ``users/v=<n+1>`` and readers take the
highest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.schema import INSERT_COLUMNS, TRANSACTIONS, TX_COLUMNS, USERS
from spendlens.session import scratch_path
from spendlens.sources import commits


# --------------------------------------------------------------------------- DDL

def create_tables(spark: SparkSession, root: str, tx_name: str = "transactions", users_name: str = "users") -> None:
    """Register both tables over the folders of the store if absent (S9), with what is stored."""
    for folder in (f"{root}/transactions", users_version_path(root, 0)):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    tx_cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRANSACTIONS.fields) + ", user_bucket int"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {tx_name} ({tx_cols}) USING parquet "
        f"PARTITIONED BY (year, user_bucket) LOCATION '{root}/transactions'"
    )
    u_cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in USERS.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {users_name} ({u_cols}) USING parquet LOCATION '{users_version_path(root, 0)}'")
    refresh_tables(spark, root, tx_name, users_name)


def refresh_tables(spark: SparkSession, root: str, tx_name: str = "transactions", users_name: str = "users") -> None:
    """Make the catalog show what is stored now: the folders of all years, the latest users."""
    spark.catalog.recoverPartitions(tx_name)
    spark.sql(f"ALTER TABLE {users_name} SET LOCATION '{users_version_path(root, latest_users_version(spark, root))}'")
    spark.catalog.refreshTable(tx_name)
    spark.catalog.refreshTable(users_name)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def truncate_tables(spark: SparkSession, root: str, tx_name: str = "transactions", users_name: str = "users") -> None:
    """Empty both tables, transactions first (S10): their files are removed, the tables stay."""
    drop_tables(spark, root, tx_name, users_name)
    create_tables(spark, root, tx_name, users_name)


def drop_tables(spark: SparkSession, root: str, tx_name: str = "transactions", users_name: str = "users") -> None:
    """Drop both tables with their rows. Transactions go first: they reference users."""
    for name, folder in ((tx_name, "transactions"), (users_name, "users")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _remove(spark, f"{root}/{folder}")


# --------------------------------------------------------------------------- transactions

BUCKETS_CONF = "spendlens.user.buckets"


def user_buckets(spark: SparkSession) -> int:
    """Buckets of users per year in the store; a store keeps the number it was written with."""
    return int(spark.conf.get(BUCKETS_CONF, "16"))


def user_bucket(user_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(user_id.cast("long")), F.lit(buckets)).cast("int")


def write_transactions(df: DataFrame, path: str, mode: str = "append", layout: bool = True) -> None:
    """Write rows in table column order (S6), in folders by year and user bucket.

    ``layout=True`` rebalances rows on those two, the folder keys: AQE sizes the write tasks to
    the advisory partition size and splits a large folder over several tasks, so each task writes
    one file of about that size. Rows are then sorted by (user_id, transaction_id) within each
    file. One user's rows lie in one folder per year, in one row group or so per file; period
    filters prune the years. Small incremental appends pass ``layout=False`` (no shuffle; the
    writer still groups rows by folder).
    """
    out = df.select(*TX_COLUMNS).withColumn("user_bucket", user_bucket(F.col("user_id"), user_buckets(df.sparkSession)))
    if layout:
        out = out.hint("rebalance", "year", "user_bucket")
        out = out.sortWithinPartitions("year", "user_bucket", "user_id", "transaction_id")
    out.write.mode(mode).partitionBy("year", "user_bucket").parquet(path)


def read_transactions(spark: SparkSession, path: str, with_bucket: bool = False) -> DataFrame:
    """The stored rows; ``with_bucket`` keeps the folder column that prunes by user. Of a table
    that is written in committed batches (``commits``), the rows of those."""
    schema = T.StructType([*TRANSACTIONS.fields, T.StructField("user_bucket", T.IntegerType())])
    markers = commits.committed(spark, path)
    df = commits.read_committed(spark, path, "rows", schema, markers) if markers else spark.read.schema(schema).parquet(path)
    return df.select(*TX_COLUMNS, *(["user_bucket"] if with_bucket else []))


def user_history(tx: DataFrame, user_id: int | Column) -> DataFrame:
    """One user's rows (S5): the equality is pushed into the Parquet scan and, on a frame read
    with its bucket, only that user's folders are listed for it."""
    out = tx.filter(F.col("user_id") == user_id)
    if "user_bucket" not in tx.columns:
        return out
    value = user_id if isinstance(user_id, Column) else F.lit(user_id)
    return out.filter(F.col("user_bucket") == user_bucket(value, user_buckets(tx.sparkSession))).drop("user_bucket")


def users_history(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Batch form of S5: the history of every user in ``users`` (a semi-join, no duplicates).

    The user ids are not de-duplicated first: a semi-join does not need it, and a distinct
    would come out of its aggregate already partitioned by user_id, which keeps AQE from
    splitting a hot user's rows (its skew-join rule needs two plain shuffles). Small id sets
    are still broadcast by Spark's size threshold.
    """
    return tx.join(users.select("user_id"), "user_id", "left_semi")


def assign_ids(new_rows: DataFrame, existing: DataFrame, id_col: str, base: int | None = None,
               order: list[str] | None = None) -> DataFrame:
    """Surrogate keys (K1): dense above every existing id, in ``order`` when it is given.

    The rows are range-partitioned and sorted by ``order`` and written once to the shared folder, each
    with its partition and its place there, which fixes both; a row's id is the highest existing id,
    plus the rows of the partitions before its own (one count per partition), plus its place in its
    partition. What is written is columns: a reader of few of them does not read the rest. No global window,
    and no part of the id space is spent on gaps. The highest id is a scan of the ids, unless a
    writer that keeps its own high-water mark passes it as ``base``.
    """
    spark = new_rows.sparkSession
    if base is None:
        base = existing.select(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    rows = new_rows.repartitionByRange(*order).sortWithinPartitions(*order) if order else new_rows
    rows = rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    path = scratch_path(spark, "ids")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    counts = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # one per partition
    starts, total = [], int(base)
    for part in range(max(counts, default=0) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    start = F.element_at(F.lit(starts), F.col("_part") + 1)
    # the low 33 bits of monotonically_increasing_id count the rows of a partition from 0
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(id_col, start + place + F.lit(1)).drop("_part", "_at")


_FOOTER_SESSIONS: dict[str, SparkSession] = {}


def stored_max(spark: SparkSession, path: str, column: str, where: Column | None = None):
    """``max(column)`` of a stored Parquet table from its file footers (row-group statistics):
    the cost grows with the number of files, not rows. ``where`` may only reference partition
    columns.

    Parquet's V2 reader answers MIN/MAX from footers when aggregate pushdown is on; it runs in
    a session of its own (same context, caller's runtime settings copied) so the caller's
    reader settings stay as they are. A file without statistics falls back to a column scan.
    """
    app = spark.sparkContext.applicationId
    s = _FOOTER_SESSIONS.get(app)
    if s is None:
        s = _FOOTER_SESSIONS[app] = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if s.conf.isModifiable(k) and s.conf.get(k, None) != v:
            s.conf.set(k, v)
    s.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        return _max_of(s.read.parquet(path), column, where)
    except Exception:  # noqa: BLE001 - missing statistics: read the column instead
        return _max_of(spark.read.parquet(path), column, where)


def _max_of(df: DataFrame, column: str, where: Column | None) -> object:
    if where is not None:
        df = df.filter(where)
    return df.select(F.max(column)).first()[0]


def insert_projection(df: DataFrame, user_id: int | Column | None = None) -> DataFrame:
    """The fixed 18 table columns, with the user id stamped in front."""
    uid = F.col("user_id") if user_id is None else (user_id if isinstance(user_id, Column) else F.lit(user_id))
    return df.select(uid.cast("long").alias("user_id"), *INSERT_COLUMNS)


# --------------------------------------------------------------------------- users

def users_version_path(root: str, version: int) -> str:
    return f"{root}/users/v={version}"


def latest_users_version(spark: SparkSession, root: str) -> int:
    """Highest written users version (0 = none). Lists one folder; no data is read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(f"{root}/users")
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return 0
    versions = [
        int(s.getPath().getName().split("=", 1)[1])
        for s in fs.listStatus(p)
        if s.isDirectory() and s.getPath().getName().startswith("v=")
    ]
    return max(versions, default=0)


def read_users(spark: SparkSession, root: str) -> DataFrame:
    v = latest_users_version(spark, root)
    if v == 0:
        return spark.createDataFrame([], USERS)
    return spark.read.schema(USERS).parquet(users_version_path(root, v))


def write_users_snapshot(spark: SparkSession, root: str, users: DataFrame) -> int:
    """Write the next users version and return its number."""
    v = latest_users_version(spark, root) + 1
    users.select(*[f.name for f in USERS.fields]).write.mode("errorifexists").parquet(users_version_path(root, v))
    return v
