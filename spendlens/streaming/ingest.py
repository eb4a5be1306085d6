"""Incremental ingest of extraction documents and statement texts from a landing folder.

``run_ingest_stream`` (JSON answers) and ``run_statement_stream`` (statement texts) are file-source streams with ``trigger(availableNow=True)``: each run
picks up only files it has not seen (its checkpoint replaces the dashboard's session
state) and hands every micro-batch to ``ingest_batch``, the same batch functions a one-off
upload uses: parse -> clean -> skip stored rows (J1) -> append with fresh ids.

Uploads are the unit of deduplication. Files landed under ``upload_id=<n>`` folders carry
their upload number (uploads are numbered in arrival order); stored rows keep it. A row is
skipped when its key first appeared in an earlier upload - stored or in the same batch - so
equal rows of one upload are all kept even when the upload spans several micro-batches.
Files outside such folders are one upload per run, numbered by the run's start time whatever
the number of files a micro-batch takes; a run that failed is continued under its number. Use
one convention per landing folder.

Nothing is lost silently: documents without a usable answer and broken landing lines go to
``<log>_quarantine`` with a reason, and are not logged as done, so a corrected upload of the
same bytes is looked at again. Uploads are skipped per user: the same bytes from another user
are that user's rows.

A batch is visible whole or not at all (``commits``): rows, log, quarantine and recurring state are
written into folders of the attempt, and one marker file, created exclusively, makes them count. A
batch replayed after its marker was written does nothing; one replayed after an earlier failure
reads what was committed before it, recomputes the same result (the same ids included) and
commits that. The batch's name comes from the checkpoint path: a stream restarted with a fresh
checkpoint adds batches instead of repeating another run's. Single writer per table.

Rows that break a constraint of the table (text lengths, number range, missing or unknown user) are
not stored: they go to the quarantine, and the counts per constraint into the marker.

Nothing per batch reads the whole store: stored keys are looked up by digest in a narrow table of
their own, history is read only where a digest is found (by year, user bucket and user id), the log by the first digits of the batch's content digests, ids start above the mark
that each marker records, and the recurring charges are a small state that each batch adds to,
and so is the daily rollup that the dashboard reads.

No watermark or ``dropDuplicatesWithinWatermark``: equal rows inside one upload are
legitimate, and duplicates are defined against the stored history, not a time window.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.clean import MONEY_COLUMNS, clean_transactions
from spendlens.operators.dedup import (
    DEFAULT_BROADCAST_LIMIT,
    KEY_DIGESTS,
    candidate_history,
    key_digests,
    key_profile,
    new_rows_by_upload,
)
from spendlens.operators.quality import OUT_OF_RANGE, out_of_range, violation_names, with_violation
from spendlens.operators.recurring import STATE, batch_state, merged_state, with_recurring
from spendlens.operators.rollup import ROLLUP, daily_rollup, merged_rollup, rollup_rows
from spendlens.operators.statement_lines import UNPARSED, statement_reasons, statement_records
from spendlens.schema import INSERT_COLUMNS, TRANSACTIONS, TX_COLUMNS
from spendlens.sources import commits
from spendlens.sources.extraction import extraction_reasons, extraction_rows
from spendlens.sources.statements import statement_documents
from spendlens.sources.tables import assign_ids, stored_max, user_bucket, user_buckets

DOC_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("text", T.StringType()),
        # From landing folders named upload_id=<n> (partition discovery); optional.
        T.StructField("upload_id", T.LongType()),
    ]
)
# Landing lines that are no such record arrive whole in this column.
CORRUPT = "_corrupt_record"
LANDING_SCHEMA = T.StructType([*DOC_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
STORED = T.StructType(
    TRANSACTIONS.fields + [T.StructField("upload_id", T.LongType()), T.StructField("ingest_batch", T.StringType()),
                           T.StructField("user_bucket", T.IntegerType())]
)
# Folders below a batch's: of the rows, of the log (first digits of the digest), of the state.
ROW_FOLDERS, LOG_FOLDERS, STATE_FOLDERS = ("year", "user_bucket"), ("sha_prefix",), ("user_bucket",)
# max_id: the highest transaction id the batch wrote.
LOG_SCHEMA = ("doc_id string, user_id long, content_sha string, upload_id long, max_id long, ingest_batch string, "
              "sha_prefix string")
QUARANTINE_SCHEMA = "doc_id string, user_id long, text string, reason string, upload_id long, ingest_batch string"
# Hexadecimal digits of a digest that name its log folder: 16 folders a batch at most.
PREFIX_DIGITS = 1
# Reason of a statement's lines that look like transactions but do not parse.
UNPARSED_LINE = "unparsed_line"
# Bytes of landed files that a batch takes (one larger file is a batch by itself).
BATCH_BYTES = 256 << 20
# A batch of that size is cut into no smaller tasks than this.
TASK_BYTES = 4 << 20
# Known documents of a batch up to which their keys (user, digest, ids: about 150 bytes each) are
# broadcast.
LOG_BROADCAST_LIMIT = 100_000


def state_path(tx_path: str) -> str:
    return f"{tx_path}_recurring"


def rollup_path(tx_path: str) -> str:
    return f"{tx_path}_rollup"


def digest_path(tx_path: str) -> str:
    return f"{tx_path}_digests"


def quarantine_path(log_path: str) -> str:
    return f"{log_path}_quarantine"


def _log_path(spark: SparkSession, tx_path: str) -> str:
    return commits.read_small(spark, f"{tx_path}_commits/.log")


def _open_store(spark: SparkSession, tx_path: str, log_path: str) -> None:
    """The table's log, and the log's table, noted beside each other before the first batch."""
    for path, other in ((f"{tx_path}_commits/.log", log_path), (f"{log_path}_table", tx_path)):
        if path.rpartition("/")[2] not in commits.names(spark, path.rpartition("/")[0]):
            commits.create_small(spark, path, other)


def _unseen_documents(docs: DataFrame, log: DataFrame, held: list[DataFrame] | None = None,
                      broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """Documents still to ingest (I2). Skipped: the same bytes of the same user in an earlier
    upload (memoised extraction: its rows are stored, so every one would be skipped anyway) and
    the same document of the same upload (already ingested). Identical documents inside one
    upload both count, as two uploaded copies would.

    The log grows with every document ever ingested. Only the folders of the batch's digest
    prefixes are read (at most 16 ** PREFIX_DIGITS values), and it is reduced in the scan to the
    entries whose 64-bit digest of (user, content) the batch holds: up to ``broadcast_limit``
    documents these digests are broadcast, so that neither the log nor the batch's keys are
    shuffled. Only what is left on both sides is compared exactly: per (user, content) one row with
    the first upload, and the entries themselves, both aggregated map-side, so a digest with very
    many entries stays one row per task.

    The texts are joined with the documents found to be known only, and pass untouched where there
    are none. Few known documents are broadcast; of more, a 64-bit digest of the whole key is, once
    it is counted to hit no other document of the batch. ``held`` takes the frames cached for it,
    for the caller to release.
    """
    ident, key = ["user_id", "content_sha"], ["user_id", "content_sha", "upload_id", "doc_id"]
    keys = docs.select(*key)
    n, prefixes = keys.agg(F.count(F.lit(1)), F.collect_set(_prefix(F.col("content_sha")))).first()
    log = log.filter(F.col("sha_prefix").isin(prefixes) if prefixes else F.lit(False))

    def of_digests(df: DataFrame, of: DataFrame, rows: int) -> DataFrame:
        wanted = of.select(F.xxhash64(*ident).alias("_d"))
        df = df.select(*key, F.xxhash64(*ident).alias("_d"))
        return df.join(F.broadcast(wanted) if rows <= broadcast_limit else wanted, "_d", "left_semi").drop("_d")

    cached = [] if held is None else held
    near = of_digests(log, keys, n).persist()
    cached.append(near)
    n_near = near.count()
    if n_near == 0:
        return docs
    first = near.groupBy(*ident).agg(F.min("upload_id").alias("_first"))
    same = near.distinct().withColumn("_same", F.lit(True))
    # One row per document of the batch: first and same are unique on what they are joined by.
    known = of_digests(keys, near, n_near).join(first, ident, "left").join(same, key, "left")
    known = known.filter((F.col("_first") < F.col("upload_id")) | F.col("_same"))
    known = known.select(*[F.col(c).alias(f"_k_{c}") for c in key]).persist()
    cached.append(known)
    n_known = known.count()
    if n_known == 0:
        return docs
    if LOG_BROADCAST_LIMIT < n_known <= broadcast_limit:
        marks = F.broadcast(known.select(F.xxhash64(*known.columns).alias("_mark")))
        marked = docs.withColumn("_mark", F.xxhash64(*key))
        if marked.select("_mark").join(marks, "_mark", "left_semi").count() == n_known:
            return marked.join(marks, "_mark", "left_anti").drop("_mark")
    if n_known <= LOG_BROADCAST_LIMIT:
        known = F.broadcast(known)
    of_user = [docs[c] == known[f"_k_{c}"] for c in (*ident, "upload_id")]
    return docs.join(known, reduce(Column.__and__, of_user) & docs["doc_id"].eqNullSafe(known["_k_doc_id"]), "left_anti")


def _prefix(content_sha: Column) -> Column:
    return F.substring(content_sha, 1, PREFIX_DIGITS)


def _id_base(spark: SparkSession, tx_path: str, markers: list[dict]) -> int:
    """The highest stored transaction id, from the batches' markers. Only before any batch recorded
    one (a new stream over a table written otherwise) its file footers are read (``stored_max``)."""
    marks = [m["max_id"] for m in markers if m["max_id"] is not None]
    if marks or markers or not commits.names(spark, tx_path):
        return max(marks, default=0)
    return int(stored_max(spark, tx_path, "transaction_id") or 0)


def _answers(docs: DataFrame) -> DataFrame:
    return extraction_reasons(docs)


def _answer_rows(docs: DataFrame) -> DataFrame:
    return clean_transactions(extraction_rows(docs).withColumn(OUT_OF_RANGE, out_of_range(list(MONEY_COLUMNS))))


def _statement_rows(docs: DataFrame) -> DataFrame:
    """Rows of statements, and of their lines that do not parse (``UNPARSED``), in one pass."""
    return statement_records(docs, unparsed=True)


# What a kind of document means: (reason why it gives no rows, its rows, whether the reason is too
# dear to be found for documents that are skipped as known).
KINDS: dict[str, tuple[Callable, Callable, bool]] = {
    "answers": (_answers, _answer_rows, True),
    "statements": (statement_reasons, _statement_rows, False),
}


def ingest_batch(docs: DataFrame, tx_path: str, log_path: str, batch_id: int = 0, run_id: str = "run",
                 run_upload: int | None = None, kind: str = "answers", users: DataFrame | None = None) -> None:
    """Ingest one batch of documents ``(doc_id, user_id, text[, upload_id])`` into ``tx_path``;
    what holds no usable answer goes to ``<log_path>_quarantine``. ``run_upload`` numbers the
    documents without an upload id (default: the time now). ``kind`` is "answers" (JSON) or
    "statements" (statement texts, with ``statement_year`` and ``statement_month``). With ``users``,
    rows of other users are not stored.

    The batch becomes visible by its commit marker alone, written last; if the marker is already
    there, nothing is done.
    """
    spark = docs.sparkSession
    reasons, to_rows, dear = KINDS[kind]
    batch = f"{run_id}-{batch_id:012d}"
    _open_store(spark, tx_path, log_path)
    markers = commits.committed(spark, tx_path)
    if commits.is_done(spark, tx_path, batch, markers):
        return
    attempt = commits.new_attempt(batch)
    own_upload = F.lit(run_upload if run_upload is not None else int(time.time() * 1000)).cast("long")
    upload = F.coalesce(F.col("upload_id"), own_upload) if "upload_id" in docs.columns else own_upload
    hashed = docs.withColumn("upload_id", upload)
    if CORRUPT not in hashed.columns:
        hashed = hashed.withColumn(CORRUPT, F.lit(None).cast("string"))
    hashed = hashed.withColumn("content_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    # A cheap reason is cached beside the text, so that the log and the quarantine do not read texts.
    hashed = (hashed if dear else reasons(hashed)).persist()
    held = [hashed]
    log = commits.read_committed(spark, log_path, "log", LOG_SCHEMA, markers)
    broken = hashed.filter(F.col(CORRUPT).isNotNull())
    fresh = hashed.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if any("log" in m["parts"] for m in markers):
        fresh = _unseen_documents(fresh, log, held)
    checked = reasons(fresh) if dear else fresh
    if dear:
        held.append(checked.persist())
    done, failed = checked.filter(F.col("reason").isNull()), checked.filter(F.col("reason").isNotNull())
    # Parsed once, reused by the dedup sizing pass and the write (bounded by the batch size:
    # maxBytesPerTrigger). The counts of violations come with the pass that fills the cache.
    seen = Observation()
    of = F.col("violation")
    parsed = with_violation(to_rows(done.drop("content_sha", "reason")), users)
    text_aside = F.to_json(F.struct(*[c for c in INSERT_COLUMNS if c in parsed.columns]))
    if UNPARSED in parsed.columns:
        line = F.col(UNPARSED)
        parsed = parsed.withColumn("violation", F.when(line.isNull(), of).otherwise(UNPARSED_LINE))
        text_aside = F.coalesce(line, text_aside)
    parsed = parsed.observe(seen, *[F.count(F.when(of == v, 1)).alias(v) for v in (*violation_names(), UNPARSED_LINE)]).persist()
    parts, max_id, counts, writes = [], None, {}, []
    try:
        n_rows = parsed.count()
        if n_rows:
            counts = {k: v for k, v in seen.get.items() if v}
        n_rows -= counts.pop(UNPARSED_LINE, 0)
        rows = parsed.filter(of.isNull()).drop("violation", UNPARSED)
        if n_rows > sum(counts.values()):  # P13: nothing to dedup or write for an empty batch
            history = read_stored(spark, tx_path, markers)
            profile = key_profile(rows, "upload_id")
            if markers:
                digests = commits.read_committed(spark, digest_path(tx_path), "digests", KEY_DIGESTS, markers)
                history = candidate_history(rows, digests, history, profile=profile)
            new = new_rows_by_upload(rows, history, profile=profile)
            # Ids follow the statement order (K1, X8, L1): upload, document, position in it.
            out = assign_ids(new.select("user_id", *INSERT_COLUMNS, "upload_id", "doc_id", "position"), history,
                             "transaction_id", base=_id_base(spark, tx_path, markers),
                             order=["upload_id", "doc_id", "position"])
            out = out.select(*TX_COLUMNS, "upload_id").withColumn(
                "user_bucket", user_bucket(F.col("user_id"), user_buckets(spark)))
            # The rows are written by assign_ids: their highest id is a scan of two columns.
            max_id = out.agg(F.max("transaction_id")).first()[0]
            if max_id is not None:
                # The rows of a folder in one task, which groups them and writes them: a single shuffle.
                # They are a part of one batch, however many belong to one user.
                by_folder = out.repartition(*STATE_FOLDERS)
                writes += [
                    (_laid_out(out), tx_path, attempt, ROW_FOLDERS),
                    (batch_state(by_folder), state_path(tx_path), attempt, STATE_FOLDERS),
                    (key_digests(by_folder), digest_path(tx_path), attempt, STATE_FOLDERS),
                    (daily_rollup(by_folder), rollup_path(tx_path), attempt, STATE_FOLDERS),
                ]
                parts += ["rows", "recurring", "digests", "rollup"]
        aside = [
            parsed.filter(of.isNotNull()).select("doc_id", "user_id", text_aside.alias("text"), of.alias("reason"), "upload_id"),
            failed.select("doc_id", "user_id", "text", "reason", "upload_id"),
            broken.select("doc_id", "user_id", F.col(CORRUPT).alias("text"), F.lit("broken_line").alias("reason"), "upload_id"),
        ]
        writes.append((reduce(DataFrame.unionByName, aside), quarantine_path(log_path), attempt))
        entries = done.select("doc_id", "user_id", "content_sha", "upload_id", F.lit(max_id).cast("long").alias("max_id"),
                              _prefix(F.col("content_sha")).alias("sha_prefix"))
        writes.append((_in_folders(entries, LOG_FOLDERS), log_path, attempt, LOG_FOLDERS))
        _write_all(spark, writes)
        commits.commit(spark, tx_path, batch, attempt, [*parts, "quarantine", "log"], max_id, counts=counts)
    finally:
        parsed.unpersist()
        for frame in reversed(held):
            frame.unpersist()


def _write(df: DataFrame, path: str, attempt: str, folders: tuple[str, ...] = ()) -> None:
    df.write.partitionBy(*folders).parquet(commits.folder(path, attempt))


def _write_all(spark: SparkSession, writes: list[tuple]) -> None:
    """The tables of a batch, written side by side: none waits for another one's last task. Their
    jobs belong to the caller's job group; the first failure is raised once all have ended."""
    with ThreadPoolExecutor(len(writes)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(_write), *w) for w in writes]
    for job in jobs:
        job.result()


def _in_folders(df: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    """A folder's rows in one task, or in a few where there are many of them: one file or so per
    folder and batch, not one per folder and task."""
    return df.hint("rebalance", *folders)


def _laid_out(df: DataFrame) -> DataFrame:
    """One file or more of advisory size per folder, sorted by user: later per-user scans skip
    other users' row groups."""
    df = df.hint("rebalance", *ROW_FOLDERS)
    return df.sortWithinPartitions(*ROW_FOLDERS, "user_id", "transaction_id")


def read_stored(spark: SparkSession, tx_path: str, markers: list[dict] | None = None) -> DataFrame:
    """The committed rows with all their columns, folder columns included. A table that was written
    before its first ingest batch is read whole until then."""
    if markers is None:
        markers = commits.committed(spark, tx_path)
    if not markers and commits.names(spark, tx_path):
        return spark.read.schema(STORED).parquet(tx_path)
    return commits.read_committed(spark, tx_path, "rows", STORED, markers)


def recurring_state(spark: SparkSession, tx_path: str) -> DataFrame:
    """Per (user, merchant) the state of its charges over all committed batches, with
    ``is_recurring`` (X9): merged from the batches' own rows of state, not from the transactions."""
    return merged_state(commits.read_committed(spark, state_path(tx_path), "recurring", STATE, commits.committed(spark, tx_path)))


def read_with_recurring(spark: SparkSession, tx_path: str) -> DataFrame:
    """The committed rows, ``is_subscription`` true where it was stored so or the charge is a
    recurring one by all rows stored up to now. Rows stored before the third month flip with it."""
    rows = read_stored(spark, tx_path).select(*TX_COLUMNS)
    flagged = with_recurring(rows, recurring_state(spark, tx_path))
    return flagged.withColumn("is_subscription", F.coalesce("is_subscription", F.lit(False)) | F.col("is_recurring")).select(*TX_COLUMNS)


def read_rollup(spark: SparkSession, tx_path: str) -> DataFrame:
    """The daily rollup of all committed batches, as the dashboard's functions take it: they give
    the same figures as from the rows, which are not read."""
    return rollup_rows(commits.read_committed(spark, rollup_path(tx_path), "rollup", ROLLUP, commits.committed(spark, tx_path)))


def compact(spark: SparkSession, tx_path: str, keep: int = 1) -> int:
    """Put all batches but the ``keep`` newest of each run into one, with files of advisory size;
    returns how many batches were put together. Rows, log and quarantine stay as they are, the
    recurring state is merged. A batch that may still be replayed must not be among them, so at
    least the newest one of each run is kept. Run by the store's single writer between two streams.

    The new folders are written first and take the place of the old ones by one commit marker;
    whatever step this is stopped at, readers see the same rows. Left-overs of this or of a failed
    batch are removed by the next call, which begins with that, and at the end.
    """
    if not commits.has_commits(spark, tx_path):
        return 0
    log_path = _log_path(spark, tx_path)
    tables = {"rows": (tx_path, STORED, ROW_FOLDERS), "recurring": (state_path(tx_path), STATE, STATE_FOLDERS),
              "digests": (digest_path(tx_path), KEY_DIGESTS, STATE_FOLDERS),
              "rollup": (rollup_path(tx_path), ROLLUP, STATE_FOLDERS),
              "log": (log_path, LOG_SCHEMA, LOG_FOLDERS), "quarantine": (quarantine_path(log_path), QUARANTINE_SCHEMA, ())}
    paths = [path for path, _, _ in tables.values()]
    commits.sweep(spark, tx_path, paths)
    markers = commits.committed(spark, tx_path)
    runs: dict[str, list[dict]] = {}
    for m in markers:
        runs.setdefault(m["batch"].rpartition("-")[0], []).append(m)
    old = [m for run, found in runs.items() for m in (found if run == "compact" else found[: -max(1, keep)])]
    if len(old) < 2:
        return 0
    batch = f"compact-{int(time.time() * 1000):015d}"
    attempt = commits.new_attempt(batch)
    parts = []
    for part, (path, schema, folders) in tables.items():
        if not any(part in m["parts"] for m in old):
            continue
        found = commits.read_committed(spark, path, part, schema, old).drop(commits.BATCH)  # its folder names it
        if part == "rows":
            found = _laid_out(found)
        elif part == "digests":
            found = _in_folders(found.distinct(), folders)
        elif part == "rollup":
            found = _in_folders(merged_rollup(found), folders)
        elif part == "recurring":
            found = _in_folders(merged_state(found, verdict=False), folders)
        elif folders:
            found = _in_folders(found, folders)
        _write(found, path, attempt, folders)
        parts.append(part)
    marks = [m["max_id"] for m in old if m["max_id"] is not None]
    commits.commit(spark, tx_path, batch, attempt, parts, max(marks, default=None), [m["batch"] for m in old])
    commits.sweep(spark, tx_path, paths)
    return len(old)


def read_quarantine(spark: SparkSession, log_path: str) -> DataFrame:
    """What the ingest could not use: doc_id, user_id, text, reason, upload_id, ingest_batch."""
    if f"{log_path}_table".rpartition("/")[2] not in commits.names(spark, log_path.rpartition("/")[0]):
        return spark.createDataFrame([], QUARANTINE_SCHEMA)
    tx_path = commits.read_small(spark, f"{log_path}_table")
    return commits.read_committed(spark, quarantine_path(log_path), "quarantine", QUARANTINE_SCHEMA, commits.committed(spark, tx_path))


def _open_upload(spark: SparkSession, mark: str) -> int:
    """The upload number of this run: that of an earlier run that did not end, else the time now,
    kept as the name of an empty file until ``_close_upload``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(mark)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        if names:
            return min(int(n) for n in names)
    number = int(time.time() * 1000)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{mark}/{number}")).close()
    return number


def _close_upload(spark: SparkSession, mark: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(mark)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _run(spark: SparkSession, stream: DataFrame, to_docs: Callable[[DataFrame], DataFrame], tx_path: str, log_path: str,
         checkpoint: str, kind: str, users: DataFrame | None) -> None:
    """One availableNow run of a stream of files. The run id names this checkpoint's batches in the
    table, so a stream restarted with a fresh checkpoint never repeats another run's."""
    run_id = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    mark = f"{checkpoint.rstrip('/')}-open-upload"
    number = _open_upload(spark, mark)
    query = (
        stream.writeStream.foreachBatch(
            lambda df, bid: ingest_batch(to_docs(df), tx_path, log_path, bid, run_id, number, kind, users))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    _close_upload(spark, mark)


def _trigger(max_files: int | None) -> dict[str, str]:
    """What bounds a batch: the bytes of its files, so that many small files are no more batches
    than a few large ones; or the number of its files where that is given."""
    return {"maxBytesPerTrigger": str(BATCH_BYTES)} if max_files is None else {"maxFilesPerTrigger": str(max_files)}


def run_ingest_stream(spark: SparkSession, landing: str, tx_path: str, log_path: str, checkpoint: str,
                      max_files_per_trigger: int | None = None, users: DataFrame | None = None) -> None:
    """Process every landed file of JSON answers not yet processed, then stop."""
    stream = (
        spark.readStream.schema(LANDING_SCHEMA)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .options(**_trigger(max_files_per_trigger))
        .json(landing)
    )
    _run(spark, stream, lambda df: df, tx_path, log_path, checkpoint, "answers", users)


def run_statement_stream(spark: SparkSession, landing: str, tx_path: str, log_path: str, checkpoint: str,
                         max_files_per_trigger: int | None = None, users: DataFrame | None = None) -> None:
    """Process every landed statement file not yet processed, then stop. A file is read whole and
    holds one statement or several, with form feeds between them (``statement_documents``);
    statements without account number or period, lines that do not parse and empty statements go
    to the quarantine."""
    schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("upload_id", T.LongType())])
    stream = (
        spark.readStream.format("text").schema(schema).option("wholetext", True)
        .options(**_trigger(max_files_per_trigger))
        .load(landing)
        .select("value", "upload_id", F.col("_metadata.file_path").alias("file"))
    )
    # A file is one task, however many statements it holds: these are dealt out, so that they are cut
    # into lines evenly, and a statement's running credit needs no shuffle of its lines. A cached frame
    # keeps its number of tasks, so it is that of a batch of bounded bytes where the batch is one.
    n = [min(2 * spark.sparkContext.defaultParallelism, BATCH_BYTES // TASK_BYTES)] if max_files_per_trigger is None else []
    _run(spark, stream, lambda files: statement_documents(files).repartition(*n, "doc_id"), tx_path, log_path, checkpoint,
         "statements", users)
