"""Users in buckets by email, rewritten bucket by bucket.

An upsert touches the buckets of its emails only: these are read, merged and written into a folder
of the attempt, and one marker (``commits``) says which buckets it holds. A reader takes each bucket
from the newest marker that has it, so the files of other buckets stay as they are, and an upsert
that is stopped leaves the users as they were. The number of buckets is fixed when the store is
made; a store of very many users takes more of them (a bucket should stay some hundred MB).

Single writer; two racing upserts fail rather than lose one, as a marker is created exclusively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.operators.users import upsert_users
from spendlens.schema import USERS
from spendlens.sources import commits

BUCKETS = 64
PART = "users"
STORED = T.StructType([*USERS.fields, T.StructField("email_bucket", T.IntegerType())])


def email_bucket(email: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(email), F.lit(buckets)).cast("int")


def create_user_store(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    commits.create_small(spark, f"{path}_commits/.buckets", str(buckets))


def _buckets(spark: SparkSession, path: str) -> int:
    return int(commits.read_small(spark, f"{path}_commits/.buckets"))


def _holders(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of each bucket: that of the newest marker with it. Markers are one per upsert since
    the last one that rewrote every bucket."""
    found = {}
    for m in commits.committed(spark, path):
        found.update({b: f"{commits.folder(path, m['attempt'])}/email_bucket={b}" for b in m["buckets"]})
    return found


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], USERS)
    return spark.read.schema(STORED).option("basePath", path).parquet(*sorted(folders)).select(*USERS.fieldNames())


def read_user_store(spark: SparkSession, path: str, emails: DataFrame | None = None) -> DataFrame:
    """All users, or, with ``emails``, those of the buckets of these (S8 reads nothing else)."""
    holders = _holders(spark, path)
    if emails is not None:
        wanted = {r[0] for r in emails.select(email_bucket(F.col("email"), _buckets(spark, path))).distinct().collect()}
        holders = {b: f for b, f in holders.items() if b in wanted}
    return _read(spark, path, list(holders.values()))


def upsert_user_store(spark: SparkSession, path: str, updates: DataFrame, seq: str = "seq") -> int:
    """Merge updates (email, display_name, picture_url, ``seq``) into the store; returns how many
    buckets were rewritten (at most all of them). An update with a null email is left out."""
    n, markers = _buckets(spark, path), commits.committed(spark, path)
    bucketed = updates.filter(F.col("email").isNotNull())
    touched = sorted(r[0] for r in bucketed.select(email_bucket(F.col("email"), n)).distinct().collect())
    if not touched:
        return 0
    holders = _holders(spark, path)
    old = _read(spark, path, [holders[b] for b in touched if b in holders])
    top = max((m["max_id"] for m in markers if m["max_id"] is not None), default=0)
    batch = f"v-{len(commits.names(spark, f'{path}_commits')):012d}"
    attempt = commits.new_attempt(batch)
    merged = upsert_users(old, bucketed, seq, base=top).drop("is_new").withColumn("email_bucket", email_bucket(F.col("email"), n))
    folder = commits.folder(path, attempt)
    merged.hint("rebalance", "email_bucket").write.partitionBy("email_bucket").parquet(folder)
    highest = spark.read.schema(STORED).parquet(folder).agg(F.max("user_id")).first()[0]
    # Markers all of whose buckets are held by newer ones do not count any more.
    covered = set(touched)
    replaced = [m["batch"] for m in markers if set(m["buckets"]) <= covered]
    commits.commit(spark, path, batch, attempt, [PART], max(top, highest), replaced, buckets=touched)
    return len(touched)


def load_user_store(spark: SparkSession, path: str, users: DataFrame) -> None:
    """Fill an empty store with users that have their ids."""
    n = _buckets(spark, path)
    attempt = commits.new_attempt("v-000000000000")
    folder = commits.folder(path, attempt)
    rows = users.select(*USERS.fieldNames()).withColumn("email_bucket", email_bucket(F.col("email"), n))
    rows.hint("rebalance", "email_bucket").write.partitionBy("email_bucket").parquet(folder)
    stored = spark.read.schema(STORED).parquet(folder)
    held = sorted(r[0] for r in stored.select("email_bucket").distinct().collect())
    highest = stored.agg(F.max("user_id")).first()[0]
    commits.commit(spark, path, "v-000000000000", attempt, [PART], highest, buckets=held)
