"""Skip rows already stored for the same user, count them, append the rest.

Identity of a transaction: (user_id, calendar date, trimmed lower-case description,
amount as DECIMAL(18,2)), compared null-safely, so missing parts equal missing parts.
Incoming rows are not de-duplicated among themselves: two equal coffees in one upload are
both new, and both skipped when uploaded again.

Plan at scale. The stored history is the large side and an upload is small. A left-anti
join can only build its hash table on the right (history) side, so a plain anti-join would
shuffle all of history for every upload. When the upload is proven small (its rows counted
against ``broadcast_limit``) the history is first reduced with a broadcast left-semi join
against the upload's keys - a map-side scan of four columns with year-partition pruning
and the upload's user-id range pushed into the Parquet scan, no history shuffle - and the
distinct matched keys, a subset of the upload's keys, are broadcast into the anti-join, so
the upload is not shuffled either. Beyond the limit both sides are shuffled on the key (a
sort-merge or shuffled-hash anti-join, which AQE may still demote to a broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spendlens.functions.keys import dedup_key, norm_desc
from spendlens.session import checkpoint_root
from spendlens.sources.tables import assign_ids, insert_projection, user_bucket, user_buckets

KEY_COLUMNS = ["_k_user", "_k_date", "_k_desc", "_k_amt"]
DEFAULT_BROADCAST_LIMIT = 2_000_000  # upload rows
BROADCAST_BYTES = 256 << 20  # bytes of their keys (descriptions have no length limit)


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_k_user": F.col("user_id").cast("long"),
            "_k_date": F.to_date("transaction_date"),
            "_k_desc": norm_desc(F.col("activity_description")),
            "_k_amt": F.col("amount_spent").cast("decimal(18,2)"),
        }
    )


def add_dedup_key(df: DataFrame) -> DataFrame:
    """The readable ``date-desc-amount`` key as a column (display only)."""
    return df.withColumn(
        "dedup_key", dedup_key(F.col("transaction_date"), F.col("activity_description"), F.col("amount_spent"))
    )


def _key_cond(left: DataFrame, right: DataFrame) -> Column:
    # user_id is never null in a stored row; the other parts compare null-safely.
    cond = left["_k_user"] == right["_k_user"]
    for c in KEY_COLUMNS[1:]:
        cond = cond & left[c].eqNullSafe(right[c])
    return cond


def key_profile(incoming: DataFrame, upload_col: str | None = None) -> Row:
    """One pass over the incoming keys: row count, bytes, distinct years (a handful), whether
    undated rows exist, the range of user ids, and their buckets (at most as many as there are); with
    ``upload_col`` also how many rows have an upload, and the range of these. Cache the incoming batch
    when it is costly to recompute. A caller of several functions that take it makes it once for all."""
    own = F.col(upload_col).cast("long") if upload_col else F.lit(None).cast("long")
    keys = with_keys(incoming).select(*KEY_COLUMNS, own.alias("_own"))
    return keys.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.coalesce(F.octet_length("_k_desc"), F.lit(0)) + 40), F.lit(0)).alias("size"),
        F.collect_set(F.year("_k_date")).alias("years"),
        F.max(F.col("_k_date").isNull().cast("int")).alias("undated"),
        F.min("_k_user").alias("lo"),
        F.max("_k_user").alias("hi"),
        F.collect_set(user_bucket(F.col("_k_user"), user_buckets(keys.sparkSession))).alias("buckets"),
        F.count("_own").alias("n_own"), F.min("_own").alias("first_own"), F.max("_own").alias("last_own"),
    ).first()


KEY_DIGESTS = "digest long, user_id long, day date, user_bucket int"


def key_digests(rows: DataFrame) -> DataFrame:
    """One narrow row per stored key: a 64-bit digest of it, its user and day, and the folder column
    ``user_bucket``. What an ingest keeps beside its rows, to look keys up without reading them."""
    k = with_keys(rows)
    return k.select(F.xxhash64(*KEY_COLUMNS).alias("digest"), F.col("_k_user").alias("user_id"), F.col("_k_date").alias("day"),
                    "user_bucket").distinct()


def candidate_history(incoming: DataFrame, digests: DataFrame, history: DataFrame,
                      broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, profile: Row | None = None) -> DataFrame:
    """The part of ``history`` (with its folder columns) that can hold a key of ``incoming``: rows of
    the users, user buckets and years of the digests found. An upload without a stored key reads
    no history at all, and the exact comparison is left to the join that follows.

    The digests are read in the incoming rows' bucket folders only; their join broadcasts the
    incoming digests where these are counted to be few."""
    of = profile or key_profile(incoming)
    near = digests.filter(F.col("user_bucket").isin(of["buckets"]) if of["buckets"] else F.lit(False))
    wanted = with_keys(incoming).select(F.xxhash64(*KEY_COLUMNS).alias("digest"))
    hits = near.join(F.broadcast(wanted) if of["n"] <= broadcast_limit else wanted, "digest", "left_semi")
    found = hits.agg(
        F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.collect_set("user_bucket").alias("buckets"),
        F.collect_set(F.year("day")).alias("years"), F.max(F.col("day").isNull()).alias("undated"),
    ).first()
    if found["lo"] is None:
        return history.filter(F.lit(False))
    year = F.col("year").isin(found["years"]) if found["years"] else F.lit(False)
    if found["undated"]:
        year = year | F.col("year").isNull()
    return history.filter(F.col("user_id").between(found["lo"], found["hi"]) & F.col("user_bucket").isin(found["buckets"]) & year)


def stored_keys(incoming: DataFrame, history: DataFrame, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
                extra: list[str] | None = None, profile: Row | None = None) -> tuple[DataFrame, bool]:
    """Keys of ``history`` (prefixed ``_k_``, plus ``extra`` history columns) that may match
    ``incoming`` (not distinct), and whether the upload was proven small (at most
    ``broadcast_limit`` rows)."""
    inc_rows = with_keys(incoming).select(*KEY_COLUMNS)
    of = profile or key_profile(incoming)
    n, size, years, undated, buckets = of["n"], of["size"], sorted(of["years"]), bool(of["undated"]), sorted(of["buckets"])
    lo, hi, hist = of["lo"], of["hi"], history
    if "user_bucket" in history.columns:
        # Folders of other users' buckets are not read (at most as many values as buckets).
        hist = hist.filter(F.col("user_bucket").isin(buckets) if buckets else F.lit(False))
    if lo is not None and "user_id" in history.columns:
        # Only the batch's users can match. The range is pushed into the Parquet scan, where
        # files sorted by user_id skip the row groups of other users (an upload of one user's
        # statements reads that user's row groups only).
        hist = hist.filter(F.col("user_id").between(lo, hi))
    if "year" in history.columns:
        # A row can only match rows of the same calendar year (or both undated): prune the
        # year directories of a partitioned store.
        cond = F.col("year").isin(years) if years else F.lit(False)
        if undated:
            cond = cond | F.col("year").isNull()
        hist = hist.filter(cond)
    hk = with_keys(hist).select(*KEY_COLUMNS, *(extra or []))
    small = bool(broadcast_limit) and n <= broadcast_limit and size <= BROADCAST_BYTES
    if small:
        # n rows bound the broadcast side (duplicates are harmless in a semi-join build).
        hk = hk.join(F.broadcast(inc_rows), _key_cond(hk, inc_rows), "left_semi")
    return hk, small


def _matched(incoming: DataFrame, history: DataFrame, broadcast_limit: int, unique: bool = False) -> DataFrame:
    """Stored keys that may match the upload. Proven small: distinct and broadcast (after the
    semi-join they are a subset of the upload's keys, so its row count bounds them). Otherwise
    left as plain rows for a shuffled join, so AQE can split a hot key (a distinct would come
    out of its aggregate already partitioned by the key, which its skew-join rule cannot split);
    ``unique=True`` de-duplicates anyway, for joins that must not multiply rows."""
    hk, small = stored_keys(incoming, history, broadcast_limit)
    if small:
        return F.broadcast(hk.distinct())
    return hk.distinct() if unique else hk


def _collapse(incoming: DataFrame) -> DataFrame:
    """Equal rows collapsed to one row per input split with their number of ``_copies`` (a
    partial aggregate): a transaction repeated many times reaches a shuffled join as a few
    rows. AQE sizes join partitions by compressed bytes, which identical rows would hide."""
    return incoming.groupBy(*incoming.columns, F.spark_partition_id().alias("_split")).agg(
        F.count(F.lit(1)).alias("_copies")
    )


def _expand(collapsed: DataFrame, columns: list[str]) -> DataFrame:
    """The collapsed rows again, each as often as it came (at most one split's rows each)."""
    return collapsed.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")).drop(
        "_copy"
    )


def new_rows(incoming: DataFrame, history: DataFrame, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Incoming rows whose key is not stored for the same user.

    Beyond the broadcast limit the anti-join is shuffled; equal incoming rows are collapsed
    before it and expanded after it (``_collapse``), so whatever is still skewed is made of
    distinct rows, whose size AQE sees and splits.
    """
    hk, small = stored_keys(incoming, history, broadcast_limit)
    if small:
        hk = F.broadcast(hk.distinct())
        inc = with_keys(incoming)
        return inc.join(hk, _key_cond(inc, hk), "left_anti").drop(*KEY_COLUMNS)
    inc = with_keys(_collapse(incoming))
    return _expand(inc.join(hk, _key_cond(inc, hk), "left_anti"), incoming.columns)


def flag_duplicates(incoming: DataFrame, history: DataFrame, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Every incoming row with ``is_duplicate``.

    Proven small: one left join on the distinct stored keys, broadcast (so the join cannot
    multiply an incoming row). Beyond the limit: equal rows collapsed (``_collapse``), then a
    semi-join (duplicates) and an anti-join (new rows) with the plain stored key rows - two
    joins AQE can split, where a left join with distinct keys could not be - and expanded.
    """
    hk, small = stored_keys(incoming, history, broadcast_limit)
    if small:
        hk = F.broadcast(hk.distinct()).withColumn("_hit", F.lit(True))
        inc = with_keys(incoming)
        joined = inc.join(hk, _key_cond(inc, hk), "left")
        return joined.select(*[inc[c] for c in incoming.columns],
                             F.coalesce(F.col("_hit"), F.lit(False)).alias("is_duplicate"))
    inc = with_keys(_collapse(incoming))
    dup = inc.join(hk, _key_cond(inc, hk), "left_semi").withColumn("is_duplicate", F.lit(True))
    new = inc.join(hk, _key_cond(inc, hk), "left_anti").withColumn("is_duplicate", F.lit(False))
    return _expand(dup.unionByName(new), [*incoming.columns, "is_duplicate"])


def new_rows_by_upload(incoming: DataFrame, history: DataFrame, upload_col: str = "upload_id",
                       broadcast_limit: int = DEFAULT_BROADCAST_LIMIT, profile: Row | None = None) -> DataFrame:
    """J1 with uploads as the unit, for inputs that may mix or split uploads.

    A row is a duplicate when its key's earliest upload - over the stored rows and the
    incoming rows - is earlier than its own upload. Equal rows of one upload are all kept,
    even when that upload arrives in several batches; a later upload's copy is skipped, even
    within the same batch. Stored rows without an upload id count as earliest.

    Only keys are shuffled to find those that came again: they are checkpointed (the join then has
    two plain shuffles, which AQE can split) and counted. Without any the rows pass untouched; few
    are broadcast. An incoming batch of one upload has nothing earlier of its own: where the stored keys
    are reduced to its own by a broadcast, its keys are not shuffled at all.
    """
    of = profile or key_profile(incoming, upload_col)
    hk, small = stored_keys(incoming, history, broadcast_limit, extra=[upload_col], profile=of)
    own = F.col(upload_col).cast("long")
    keys = hk.select(*KEY_COLUMNS, F.coalesce(own, F.lit(-1)).alias("_k_up"), F.lit(None).cast("long").alias("_k_own"))
    if small and of["n_own"] == of["n"] and of["first_own"] == of["last_own"]:
        keys = keys.withColumn("_k_own", F.lit(of["last_own"]).cast("long"))
    else:
        keys = keys.unionByName(with_keys(incoming).select(*KEY_COLUMNS, own.alias("_k_up"), own.alias("_k_own")))
    first = keys.groupBy(*KEY_COLUMNS).agg(F.min("_k_up").alias("_k_first"), F.max("_k_own").alias("_k_last"))
    checkpoint_root(first.sparkSession)
    again = first.filter(F.col("_k_first") < F.col("_k_last")).drop("_k_last").checkpoint()
    size = F.coalesce(F.sum(F.coalesce(F.octet_length("_k_desc"), F.lit(0)) + 40), F.lit(0))
    n, n_bytes = again.agg(F.count(F.lit(1)), size).first()
    if n == 0:
        return incoming
    small = n <= broadcast_limit and n_bytes <= BROADCAST_BYTES
    ref = F.broadcast(again) if small else again
    # Beyond the limit the join is shuffled: equal rows are collapsed first (see ``_collapse``).
    inc = with_keys(incoming if small else _collapse(incoming))
    cond = _key_cond(inc, ref) & (ref["_k_first"] < inc[upload_col])
    kept = inc.join(ref, cond, "left_anti")
    return kept.drop(*KEY_COLUMNS) if small else _expand(kept, incoming.columns)


def dedup_report(incoming: DataFrame, history: DataFrame, by: list[str] | None = None,
                 broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Incoming, inserted and skipped counts per ``by`` group (J2): inserted + skipped = incoming.

    Counts are taken per (key, group) first - a partial aggregate, so even one transaction
    repeated in a third of the upload becomes one row per map task - and the key counts are
    then joined with the distinct stored keys: both sides are unique per key, so no join task
    can be held up by a hot key (AQE, which measures compressed bytes, would not see one made
    of identical rows).
    """
    by = ["user_id"] if by is None else by
    hk = _matched(incoming, history, broadcast_limit, unique=True).withColumn("_hit", F.lit(True))
    counts = with_keys(incoming).groupBy(*KEY_COLUMNS, *by).agg(F.count(F.lit(1)).alias("_c"))
    joined = counts.join(hk, _key_cond(counts, hk), "left")
    c, hit = F.col("_c"), F.col("_hit")
    return joined.groupBy(*[counts[b] for b in by]).agg(
        F.sum(c).alias("incoming"),
        F.coalesce(F.sum(F.when(hit.isNull(), c)), F.lit(0).cast("long")).alias("inserted"),
        F.coalesce(F.sum(F.when(hit, c)), F.lit(0).cast("long")).alias("skipped"),
    )


def rows_to_insert(incoming: DataFrame, history: DataFrame, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
                   base: int | None = None) -> DataFrame:
    """New rows in table order with fresh transaction ids above the stored ones (J1 + K1 + P1).
    ``base``: the highest stored id when known (``tables.stored_max``), else a scan finds it."""
    fresh = insert_projection(new_rows(incoming, history, broadcast_limit))
    return assign_ids(fresh, history, "transaction_id", base=base)
