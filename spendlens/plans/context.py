"""Inputs shared by the registered queries.

The transactions table is derived once per (application, scale directory) from the
driver's tables and written in the library's table layout under the shared checkpoint
folder; every query then reads that stored table, as a dashboard reads its store. The
written table also cuts the lineage of the four-way join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.session import apply_conf, scratch_path
from spendlens.sources.tables import read_transactions, write_transactions
from spendlens.sources.testdata import tx_from_tables

_TX_PATHS: dict[tuple[str, str], str] = {}


def prepare(spark: SparkSession) -> None:
    apply_conf(spark)


def tx_table(spark: SparkSession, sf_dir: str, with_bucket: bool = False) -> DataFrame:
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    path = _TX_PATHS.get(key)
    if path is None:
        path = scratch_path(spark, "tx")
        write_transactions(tx_from_tables(spark, sf_dir), path, mode="errorifexists")
        _TX_PATHS[key] = path
    return read_transactions(spark, path, with_bucket)
