"""Host-level quality rules.

Each document is judged by row-local rules; failures are counted per host; each host's failure
rate per rule is shrunk towards the corpus rate with a beta prior whose strength comes from the
spread between hosts (empirical Bayes, moments); the hosts' verdicts are joined back.

A host is judged against the corpus: it is rejected when, for some rule, its failure rate is with
near certainty (``HOST_SIGMAS`` posterior deviations) over ``HOST_FACTOR`` times the corpus rate.
The prior makes that test fair to small hosts: a few failures of a few documents move their
shrunk rate little.

Verdict: a document that fails a base rule goes. Beyond that a document may fail at most one
further rule, and none if its host is rejected. A document that fails no rule stays on any host.

Defined results: a null or empty text has no words and so fails the base rules; a null host is
no host (its documents are judged by their own rules alone and are left out of the prior); empty
tables give empty results; repeated rows are counted and judged each; only the id, host and text
columns are read, so further columns with clashing names do not matter.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import extended, map_slices, small, space_words, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT_WORDS = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

MIN_WORDS = 10
HOST_FACTOR = 2.0
HOST_SIGMAS = 3.0
# Bounds of the prior's strength in documents: the spread between hosts may be too small to see.
PRIOR_MIN, PRIOR_MAX = 1.0, 1e6


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text. Windows of five words are compared as words, not as digests."""
    text = text or ""
    words = space_words(text.encode("utf-8", "replace"))
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(REPEAT_WORDS)), strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + REPEAT_WORDS - max(i, reach)
                reach = i + REPEAT_WORDS
    seen: set[str] = set()
    lines = duplicates = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                duplicates += 1
            else:
                seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated,
        lines,
    )


def base_rules() -> dict[str, Column]:
    return {
        "few_words": F.col("n_words") < MIN_WORDS,
        "repetition": F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
    }


def further_rules() -> dict[str, Column]:
    """Symbols for more than one word in ten, odd mean word length, many duplicate lines."""
    return {
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "word_length": (F.col("word_chars") < F.col("n_words") * 2) | (F.col("word_chars") > F.col("n_words") * 12),
        "dup_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
    }


def quality_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and COUNTS, one row per input row."""
    schema = StructType([docs.schema[c] for c in keep] + [StructField(c, LongType()) for c in COUNTS])

    def make():
        def rows(*columns):
            for *kept, text in zip(*columns, strict=True):
                yield (*kept, *text_counts(text))

        return rows

    return map_slices(docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text")), schema, make)


def host_rates(counts: DataFrame, host_col: str) -> DataFrame:
    """Per host: documents, each rule's shrunk failure rate (``rate_<rule>``) and whether it is
    over the corpus rate by the bounds above (``over_<rule>``).

    The failures are summed map-side first, so a host with a third of all rows is one small row
    per task. The prior's moments are one row over the host table.
    """
    rules = {**base_rules(), **further_rules()}
    hosts = (
        counts.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col))
        .agg(F.count("*").alias("n"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules.items()])
    )
    hosts = written(hosts, "host-failures")
    moments = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
        *[F.sum(f"f_{r}").alias(f"f_{r}") for r in rules],
        *[F.sum(F.col(f"f_{r}").cast("double") * F.col(f"f_{r}") / F.col("n")).alias(f"ff_{r}") for r in rules],
    ).first()
    columns = []
    for r in rules:
        mean, strength = prior(
            moments["hosts"], moments["n"], moments["nn"], moments[f"f_{r}"], moments[f"ff_{r}"]
        )
        rate = (F.col(f"f_{r}") + mean * strength) / (F.col("n") + strength)
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        columns += [rate.alias(f"rate_{r}"), (rate - HOST_SIGMAS * deviation > HOST_FACTOR * mean).alias(f"over_{r}")]
    return hosts.select(F.col(host_col), "n", *columns)


def prior(hosts: int, n: int | None, nn: float | None, f: int | None, ff: float | None) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior from sums over hosts: documents n, squared n,
    failures f and squared failures over n. The spread is the one-way variance component."""
    if not n:
        return 0.0, PRIOR_MAX
    mean = f / n
    inner = mean * (1 - mean)
    spread = n - nn / n
    between = (ff - f * mean - (hosts - 1) * inner) / spread if spread > 0 else 0.0
    if between <= 0 or inner <= 0:
        return mean, PRIOR_MAX
    return mean, min(PRIOR_MAX, max(PRIOR_MIN, inner / between - 1))


def host_verdicts(rates: DataFrame, host_col: str) -> DataFrame:
    """Per host: host_n (documents), host_rate (its greatest shrunk rate), host_rejected."""
    worst = F.greatest(*[F.col(c) for c in rates.columns if c.startswith("rate_")])
    over = F.greatest(*[F.col(c) for c in rates.columns if c.startswith("over_")])
    return rates.select(F.col(host_col), F.col("n").alias("host_n"), worst.alias("host_rate"), over.alias("host_rejected"))


def _judged(counts: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    """Adds base_failed, the host's verdict and kept to rows with COUNTS. ``verdicts`` may hold the
    rejected hosts alone."""
    failures = sum((c.cast("int") for c in further_rules().values()), F.lit(0))
    base = F.lit(False)
    for c in base_rules().values():
        base = base | c
    return (
        counts.join(small(verdicts, host_col), host_col, "left")
        .withColumn("base_failed", base)
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & (failures <= F.when(F.col("host_rejected"), 0).otherwise(1)))
    )


def judge_documents(
    docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, host, COUNTS, base_failed, host_n, host_rate, host_rejected, kept
    (host_n and host_rate are null without a host)."""
    counts = written(quality_counts(docs, [id_col, host_col], text_col), "quality-counts")
    return _judged(counts, host_verdicts(host_rates(counts, host_col), host_col), host_col)


def filter_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns unchanged. The counts are taken a
    second time beside the rows, which move only if very many hosts are rejected; their columns
    pass through Python as Arrow data."""
    verdicts = host_verdicts(host_rates(quality_counts(docs, [host_col], text_col), host_col), host_col)
    bad = verdicts.where("host_rejected").select(F.col(host_col).alias("__host"), "host_rejected")
    schema = StructType([StructField(f"__{c}", LongType()) for c in COUNTS])

    def make():
        return lambda texts: [text_counts(t) for t in texts]

    # Own columns are named by position, so that none clashes with one of the documents.
    both = extended(docs.toDF(*[f"__{i}" for i in range(len(docs.columns))]), schema, make, f"__{docs.columns.index(text_col)}")
    counted = both.withColumnsRenamed({f"__{c}": c for c in COUNTS})
    counted = counted.withColumn("__host", F.col(f"__{docs.columns.index(host_col)}"))
    judged = _judged(counted, bad, "__host").where("kept")
    return judged.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])
