"""Model responses (JSON text) -> transaction rows, and rows -> JSON text.

A response document is accepted only when, after fence stripping, the whole of it is a JSON
array of objects. Bare objects, malformed text, text behind the array and arrays with a null or
non-object element yield no rows;
they go to the quarantine output with a reason instead of vanishing. ``[]`` yields no rows
and is not an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.text import is_json_array, strip_fences
from spendlens.operators.running import numbered_parts
from spendlens.schema import RAW_ARRAY, RAW_FIELDS, TX_COLUMNS

JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "dateFormat": "yyyy-MM-dd",
}


def _parsed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_records``: the document's records, null unless the whole text is one JSON array of
    objects. The text is parsed as the only element of an outer array: anything behind the array
    breaks the outer one or gives it a second element. Strict JSON: double quotes only."""
    body = strip_fences(F.col(text_col))
    outer = F.from_json(F.concat(F.lit("["), F.col("_body"), F.lit("]")), T.ArrayType(RAW_ARRAY),
                        {"allowSingleQuotes": "false"})
    return (
        docs.withColumn("_body", body)
        .withColumn("_outer", F.when(is_json_array(F.col("_body")), outer))
        .withColumn("_all", F.when(F.size("_outer") == 1, F.col("_outer")[0]))
        .withColumn("_records", F.when(~F.exists("_all", lambda r: r.isNull()), F.col("_all")))
    )


def extraction_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per extracted record: the document's other columns, ``position`` within the
    document (the statement order) and the 13 raw text fields."""
    keep = [c for c in docs.columns if c != text_col]
    p = _parsed(docs, text_col)
    # posexplode_outer + null filter: a plain posexplode makes Catalyst add an inferred
    # ``size(records) > 0`` filter below it, which would parse every document twice.
    return (
        p.select(*keep, F.posexplode_outer("_records").alias("position", "_r"))
        .filter(F.col("position").isNotNull())
        .select(*keep, "position", *[F.col(f"_r.{f}").alias(f) for f in RAW_FIELDS])
    )


def extraction_reasons(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``reason``: why a document gives no rows, null for a usable answer."""
    p = _parsed(docs, text_col)
    reason = (
        F.when(F.col(text_col).isNull() | (F.length(F.trim(F.col(text_col))) == 0), F.lit("empty"))
        .when(~is_json_array(F.col("_body")), F.lit("not_an_array"))
        .when(F.col("_all").isNull(), F.lit("malformed"))
        .when(F.col("_records").isNull(), F.lit("null_record"))
    )
    return p.select(*docs.columns, reason.alias("reason"))


def extraction_quarantine(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that produced no rows for a reason other than being an empty array."""
    return extraction_reasons(docs, text_col).filter(F.col("reason").isNotNull())


# --------------------------------------------------------------------------- rows -> JSON

def raw_record(df: DataFrame) -> Column:
    """A typed row as the 13-field text record of an extraction (dates ``MM-dd-yyyy``)."""
    def txt(c: str) -> Column:
        if c in ("transaction_date", "posting_date"):
            return F.date_format(F.col(c), "MM-dd-yyyy")
        return F.col(c).cast("string")

    return F.struct(*[txt(c).alias(c) for c in RAW_FIELDS])


# Records of one document up to which a group is gathered whole; a larger group becomes
# consecutive numbered parts of this size.
DOCUMENT_ROWS = 10_000


def json_documents(tx: DataFrame, max_rows: int = DOCUMENT_ROWS, fenced: bool = True) -> DataFrame:
    """Statement-like response documents per (user, year), records in (date, id) order, wrapped
    in a ```json fence as a model would answer: (doc_id, user_id, text)."""
    docs = numbered_parts(tx, ["user_id", "year"], max_rows)
    grouped = docs.groupBy("user_id", "year", "part").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", raw_record(tx).alias("_r")))).alias("_items")
    )
    body = F.to_json(F.transform("_items", lambda x: x["_r"]))
    text = F.concat(F.lit("```json\n"), body, F.lit("\n```")) if fenced else body
    doc_id = F.concat_ws("-", *[F.col(k).cast("string") for k in ("user_id", "year", "part")])
    return grouped.select(doc_id.alias("doc_id"), "user_id", text.alias("text"))


def json_records(df: DataFrame, keep: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """One JSON object per row with nulls kept and ISO timestamps (S11); ``keep`` columns
    stay beside the ``record`` text. For files: ``df.write.json(path)`` with JSON_OPTIONS."""
    cols = columns or [c for c in TX_COLUMNS if c in df.columns]
    return df.select(*(keep or []), F.to_json(F.struct(*cols), JSON_OPTIONS).alias("record"))


def json_payloads(df: DataFrame, by: list[str], max_rows: int = DOCUMENT_ROWS) -> DataFrame:
    """One JSON array of records per ``by`` group, in (date, id) order, for an external adviser
    (X14). A group of more than ``max_rows`` rows is given as consecutive arrays of that many,
    numbered by ``part``, so that none is gathered whole in one task."""
    docs = numbered_parts(df, by, max_rows)
    rec = F.to_json(F.struct(*[c for c in TX_COLUMNS if c in df.columns]), JSON_OPTIONS)
    return docs.groupBy(*by, "part").agg(
        F.concat(F.lit("["), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", rec.alias("_j")))),
            lambda x: x["_j"]), ","), F.lit("]")).alias("payload"),
        F.count(F.lit(1)).alias("n_records"),
    )
