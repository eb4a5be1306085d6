"""Statement documents: pages -> one text per document.

PDF decoding is outside Spark's scope; the input is the page text a decoder produces,
``(doc_id, page_no, text)``, or a folder of text files read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.text import has_text


def assemble_documents(pages: DataFrame, extra: list[str] | None = None, page_end: str = "") -> DataFrame:
    """Concatenate each document's pages in page order, with no separator unless ``page_end`` is
    given. For line extraction pass ``"\\n"``: a page border then ends a line, so that the last
    line of a page does not run into the first of the next.

    One group per document (a statement is a bounded unit); ``extra`` document-level
    columns ride along. Documents whose text is empty or missing are left out here and
    reported by ``empty_documents``.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce(F.col("text"), F.lit("")).alias("text"))))
    docs = pages.groupBy("doc_id", *(extra or [])).agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), page_end).alias("text")
    )
    return docs.filter(F.length(F.replace("text", F.lit(page_end))) > 0 if page_end else F.length("text") > 0)


def empty_documents(pages: DataFrame) -> DataFrame:
    """Quarantine: documents without any text."""
    return (
        pages.groupBy("doc_id")
        .agg(F.max(F.length(F.coalesce(F.col("text"), F.lit("")))).alias("_len"))
        .filter(F.col("_len") == 0)
        .select("doc_id", F.lit("empty").alias("reason"))
    )


# Header lines of a statement text that say whose it is and of which month.
ACCOUNT_RE = r"(?im)^account(?: number)?:?[ \t]*(\d{1,18})[ \t]*$"
PERIOD_RE = r"(?im)^statement period:?[ \t]*(\d{4})-(\d{2})[ \t]*$"


def statement_documents(files: DataFrame) -> DataFrame:
    """Statement texts of files read whole (``value``, ``file``, ``upload_id``): one document per
    statement, numbered where form feeds separate several in a file, with the account number and
    the period of its header as columns (null where missing)."""
    pieces = files.select("file", "upload_id", F.posexplode(F.split("value", "\f")).alias("_n", "text"))
    found = pieces.filter((F.col("_n") == 0) | (has_text(F.col("text"))))
    return found.select(
        F.concat_ws("#", "file", F.col("_n").cast("string")).alias("doc_id"),
        F.regexp_extract("text", ACCOUNT_RE, 1).try_cast("long").alias("user_id"),
        "text", "upload_id",
        F.regexp_extract("text", PERIOD_RE, 1).try_cast("int").alias("statement_year"),
        F.regexp_extract("text", PERIOD_RE, 2).try_cast("int").alias("statement_month"),
    )


def read_text_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """A folder (or glob) of uploaded text files, one document per file.

    Read with the ``binaryFile`` source (path + bytes, optional glob filter) and decoded as
    UTF-8. Zero-length files are skipped by Spark's file splitting: an empty upload yields no
    document, as it would yield no transactions.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))
