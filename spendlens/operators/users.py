"""Users by email: batch upsert and id lookup.

Semantics per email: a stored user keeps its id and takes the display name and picture of
its latest update - null values included (an update with a null name clears the name);
an unknown email becomes a new user with a fresh id. Several updates of one email in a
batch: the highest ``seq`` wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def latest_updates(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Last update per email (W4) as an aggregate: ``max_by`` combines map-side, so an email
    with very many updates never gathers them in one task (unlike a row_number window). One
    scalar ``max_by`` per column keeps it a hash aggregate; ``seq`` is unique per email."""
    return (
        updates.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.max_by("display_name", seq).alias("display_name"), F.max_by("picture_url", seq).alias("picture_url"))
    )


def upsert_users(users: DataFrame, updates: DataFrame, seq: str = "seq", base: int | None = None) -> DataFrame:
    """The next users snapshot, with ``is_new`` marking the inserted emails.

    One full outer join on email; new users get ``max(id) + 1 + monotonically_increasing_id()``
    in the same pass (ids stay unique and above the old ones; gaps are allowed). ``base`` is the
    highest id where ``users`` are only some of them.
    """
    upd = latest_updates(updates, seq).withColumn("_present", F.lit(True))
    base = F.coalesce(users.select(F.max("user_id")).scalar(), F.lit(0).cast("long")) if base is None else F.lit(base)
    u, n = users.alias("u"), upd.alias("n")
    return u.join(n, F.col("u.email") == F.col("n.email"), "full_outer").select(
        F.coalesce(F.col("u.user_id"), base + F.lit(1) + F.monotonically_increasing_id()).alias("user_id"),
        F.coalesce(F.col("u.email"), F.col("n.email")).alias("email"),
        # when/otherwise, not coalesce: a present update overwrites with its nulls too.
        F.when(F.col("n._present"), F.col("n.display_name")).otherwise(F.col("u.display_name")).alias("display_name"),
        F.when(F.col("n._present"), F.col("n.picture_url")).otherwise(F.col("u.picture_url")).alias("picture_url"),
        F.col("u.user_id").isNull().alias("is_new"),
    )


def user_ids(users: DataFrame, emails: DataFrame) -> DataFrame:
    """Id of each email in ``emails`` (S8, batch form: inner join on email)."""
    return emails.join(users.select("email", "user_id"), "email", "inner")
