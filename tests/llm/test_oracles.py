"""Every corpus query runs over the smallest tables; those with an oracle give its rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from spendlens.llm.oracle import ORACLE
from spendlens.llm.queries import QUERIES


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_small, key):
    df = QUERIES[key](spark, sf_small)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    table = "pages" if key.startswith("op9_") else "documents"
    assert len(rows) >= spark.read.parquet(f"{sf_small}/{table}.parquet").count()
    if key in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
        cur = con.execute(ORACLE[key])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
        assert sorted(want, key=str) == rows


def test_registered():
    names = list(E.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_runs(spark, sf_small):
    df = E.queries()["pipeline"](spark, sf_small)
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert whole and all(r["sum(length)"] == r["max(doc_tokens)"] for r in whole)
