"""One commit per ingest batch: all its folders become visible by one small file.

A batch writes rows, log, quarantine and recurring state into folders of its own attempt,
``ingest_batch=<batch>~<attempt>``, which no reader takes. Then one marker named after the batch
is put into ``<table>_commits``: written under a hidden name and renamed, which fails if the marker
exists. Readers list the markers and read the folders these name, so they see the whole batch or
nothing of it, whatever step a writer was stopped at; a batch with a marker is not written again.
Folders of attempts without a marker are left-overs, removed by ``sweep``.

A marker may replace others (compaction): those no longer count from the moment it is there.
Markers are as many as batches since the last compaction, each a few hundred bytes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH = "ingest_batch"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p, fs = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_small(spark: SparkSession, path: str) -> str:
    p, fs = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_small(spark: SparkSession, path: str, text: str) -> None:
    """Create a file with its whole content at once; raises if it exists."""
    jvm = spark.sparkContext._jvm
    folder, _, name = path.rpartition("/")
    hidden, fs = _hadoop(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hidden, jvm.org.apache.hadoop.fs.Path(path), options)
    finally:
        fs.delete(hidden, False)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def new_attempt(batch: str) -> str:
    return f"{batch}~{uuid.uuid4().hex[:8]}"


def folder(path: str, attempt: str) -> str:
    return f"{path}/{BATCH}={attempt}"


def has_commits(spark: SparkSession, table: str) -> bool:
    p, fs = _hadoop(spark, f"{table}_commits")
    return fs.exists(p)


def committed(spark: SparkSession, table: str) -> list[dict]:
    """The markers that count, in order of their batches: those not replaced by another one."""
    found = [n for n in names(spark, f"{table}_commits") if not n.startswith(".")]
    markers = [json.loads(read_small(spark, f"{table}_commits/{n}")) for n in found]
    gone = {b for m in markers for b in m["replaces"]}
    return [m for m in markers if m["batch"] not in gone]


def is_done(spark: SparkSession, table: str, batch: str, markers: list[dict]) -> bool:
    """Whether the batch is committed, by itself or within a compaction."""
    return batch in names(spark, f"{table}_commits") or any(batch in m["replaces"] for m in markers)


def commit(spark: SparkSession, table: str, batch: str, attempt: str, parts: list[str], max_id: int | None,
           replaces: list[str] | None = None, **more) -> None:
    """Make an attempt visible: ``parts`` names the tables it wrote a folder of; ``more`` is kept
    with it."""
    marker = {"batch": batch, "attempt": attempt, "parts": parts, "max_id": max_id, "replaces": replaces or [], **more}
    create_small(spark, f"{table}_commits/{batch}", json.dumps(marker))


def read_committed(spark: SparkSession, path: str, part: str, schema, markers: list[dict]) -> DataFrame:
    """The rows of the table ``part``, stored at ``path``, in committed batches."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    folders = [folder(path, m["attempt"]) for m in markers if part in m["parts"]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.fieldNames())


def sweep(spark: SparkSession, table: str, paths: list[str]) -> None:
    """Remove the folders of no committed attempt and the markers that are replaced. Only the
    single writer may call it, between batches, and no reader may still use replaced folders. The
    marker that replaces others stays, so a sweep that is stopped changes no rows."""
    markers = committed(spark, table)
    batches, attempts = {m["batch"] for m in markers}, {m["attempt"] for m in markers}
    for path in paths:
        for n in names(spark, path):
            if n.startswith(f"{BATCH}=") and n.split("=", 1)[1] not in attempts:
                remove(spark, f"{path}/{n}")
    for n in names(spark, f"{table}_commits"):
        if n not in batches and not n.startswith("."):
            remove(spark, f"{table}_commits/{n}")
