"""Declared-constraint checks of the stored tables (K2, J3), and of rows before they are stored.

Each check yields one row ``(check_name, violations)``, zero included. Row-level checks of
the transactions table share one scan; the orphan check pre-aggregates transactions per
user before the anti-join, so a user with a third of all rows sends one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.schema import TEXT_LIMITS, USER_TEXT_LIMITS


def _unpivot(one_row: DataFrame) -> DataFrame:
    names = one_row.columns
    return one_row.unpivot([], names, "check_name", "violations").select(
        "check_name", F.col("violations").cast("long").alias("violations")
    )


def constraint_violations(tx: DataFrame, users: DataFrame) -> DataFrame:
    row_checks = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"tx_null_{c}") for c in ("user_id", "transaction_id")]
    row_checks += [
        F.count(F.when(F.length(c) > n, 1)).alias(f"tx_{c}_too_long") for c, n in TEXT_LIMITS.items() if c in tx.columns
    ]
    tx_rows = _unpivot(tx.agg(*row_checks))

    dup_ids = _unpivot(
        tx.filter(F.col("transaction_id").isNotNull()).groupBy("transaction_id").count().filter(F.col("count") > 1).agg(
            F.coalesce(F.sum("count"), F.lit(0)).alias("tx_duplicate_transaction_id")
        )
    )
    per_user = tx.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    orphans = _unpivot(
        per_user.join(users.select("user_id"), "user_id", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("tx_orphan_user_id")
        )
    )
    # One pass over the users for their row checks and both keys: ids and emails are counted as
    # (key kind, value) pairs, so that the table is read once and not once per check.
    user_checks = [F.count(F.when(F.col(c).isNull(), 1)).alias(f"users_null_{c}") for c in ("email", "user_id")]
    user_checks += [
        F.count(F.when(F.length(c) > n, 1)).alias(f"users_{c}_too_long") for c, n in USER_TEXT_LIMITS.items() if c in users.columns
    ]
    user_rows = _unpivot(users.agg(*user_checks))
    keys = users.select(F.explode(F.array(
        F.struct(F.lit("email").alias("kind"), F.col("email").alias("value")),
        F.struct(F.lit("user_id").alias("kind"), F.col("user_id").cast("string").alias("value")),
    )).alias("_k")).select("_k.kind", "_k.value")
    repeated = keys.filter(F.col("value").isNotNull()).groupBy("kind", "value").count().filter(F.col("count") > 1)
    dup_users = _unpivot(repeated.agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(f"users_duplicate_{k}")
          for k in ("email", "user_id")]
    ))
    return reduce(DataFrame.unionByName, [tx_rows, dup_ids, orphans, user_rows, dup_users])


def typing_failures(raw: DataFrame) -> DataFrame:
    """Per typed column of a raw (all-text) extraction: values that were present (non-blank)
    but did not parse (K2's try_cast check). One scan, one row per column."""
    from spendlens.functions.clean import DATE_COLUMNS, MONEY_COLUMNS, parse_date, parse_money
    from spendlens.functions.text import utrim

    checks = []
    for name in [*DATE_COLUMNS, *MONEY_COLUMNS]:
        if name in raw.columns:
            parsed = parse_date(F.col(name)) if name in DATE_COLUMNS else parse_money(F.col(name))
            present = F.length(utrim(F.col(name).cast("string"))) > 0
            checks.append(F.count(F.when(present & parsed.isNull(), 1)).alias(name))
    return _unpivot(raw.agg(*checks)).withColumnRenamed("check_name", "column_name").withColumnRenamed(
        "violations", "failures"
    )


# --------------------------------------------------------------------------- before the write

# Set by a parser where a number is there but too large for the column.
OUT_OF_RANGE = "_out_of_range"


def out_of_range(columns: list[str]) -> Column:
    """Whether a raw money text is a number that DECIMAL(18,2) cannot hold."""
    from spendlens.functions.text import utrim

    values = [F.abs(utrim(F.col(c).cast("string")).try_cast("double")) for c in columns]
    too_large = [(v >= 1e16) & (v < float("inf")) for v in values]
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in too_large], F.lit(False))


def violation_names(with_users: bool = True) -> list[str]:
    return ["null_user_id", "out_of_range", *[f"{c}_too_long" for c in TEXT_LIMITS], *(["unknown_user"] if with_users else [])]


def with_violation(rows: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``violation``: the first constraint of the table that a row breaks, null for a
    row that may be stored. ``users`` are those known; without them the reference is not checked.
    Their ids are unique, so the join adds no rows; AQE splits a user with very many rows."""
    broken = F.when(F.col("user_id").isNull(), F.lit("null_user_id"))
    if OUT_OF_RANGE in rows.columns:
        broken = broken.when(F.col(OUT_OF_RANGE), F.lit("out_of_range"))
    for c, n in TEXT_LIMITS.items():
        if c in rows.columns:
            broken = broken.when(F.length(c) > n, F.lit(f"{c}_too_long"))
    if users is None:
        return rows.withColumn("violation", broken.otherwise(F.lit(None).cast("string"))).drop(OUT_OF_RANGE)
    known = users.select(F.col("user_id").alias("_known")).filter(F.col("_known").isNotNull())
    joined = rows.join(known, rows["user_id"] == known["_known"], "left")
    return joined.withColumn("violation", broken.when(F.col("_known").isNull(), F.lit("unknown_user"))).drop("_known", OUT_OF_RANGE)
