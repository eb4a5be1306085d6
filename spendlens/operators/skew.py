"""Joining per-key results back to the rows when one key may hold a large share of them.

A per-key result (one row per key, e.g. a merchant's recurring flag) joined back to the rows
is a sort-merge join whose per-key side usually comes straight out of its aggregate, already
partitioned by the key; AQE's skew-join rule only splits joins of two plain shuffle stages, so
a key holding a third of the rows would be joined in one task.

``join_back`` splits hot keys itself. A key is hot when it holds more than
``limit = max(piece_rows, total / max_hot_keys)`` rows, so at most ``max_hot_keys`` keys are
hot: their list is a broadcast of proven size. A hot key's rows are spread over
``ceil(n / limit)`` pieces by a hash of a row id (deterministic, so a retried task salts the
same way) and its per-key row is repeated once per piece; every piece holds about ``limit``
rows or fewer. Rows that cannot match (not ``eligible``) get negative salts, which spread them
over the partitions instead of sending one key's worth to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import checkpoint_root

MAX_HOT_KEYS = 100_000
PIECE_ROWS = 1_000_000
_SPREAD = 4096  # partitions' worth of negative salts for rows that cannot match


def join_back(rows: DataFrame, per_key: DataFrame, keys: list[str], count_col: str, salt_col: str,
              eligible: Column | None = None, max_hot_keys: int = MAX_HOT_KEYS,
              piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``rows`` left-joined with ``per_key`` on ``keys``.

    ``per_key`` has one row per key and ``count_col`` = the number of ``eligible`` rows of
    that key in ``rows`` (the rows it was aggregated from). ``salt_col`` identifies a row
    (hashed to pick its piece). Rows outside ``eligible`` get no match.

    ``per_key`` is used three times (total, hot list, join side), so it is checkpointed once
    into the shared checkpoint folder: the rows it was aggregated from are read once for it,
    not three times, and its lineage is cut (an executor lost later does not re-aggregate).
    """
    checkpoint_root(per_key.sparkSession)
    per_key = per_key.checkpoint(eager=True)
    total = per_key.select(F.sum(count_col)).scalar()  # uncorrelated scalar subquery
    limit = F.greatest(F.lit(float(piece_rows)), total.cast("double") / F.lit(float(max_hot_keys)))
    pieces = F.greatest(F.ceil(F.col(count_col) / limit), F.lit(1)).cast("long")

    hot = per_key.select(*keys, pieces.alias("_pieces")).filter(F.col("_pieces") > 1)
    marked = rows.join(F.broadcast(hot), keys, "left")
    h = F.xxhash64(F.col(salt_col))
    salt = F.pmod(h, F.coalesce(F.col("_pieces"), F.lit(1)))
    if eligible is not None:
        salt = F.when(eligible, salt).otherwise(-1 - F.pmod(h, F.lit(_SPREAD)))
    left = marked.withColumn("_salt", salt).drop("_pieces")

    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
