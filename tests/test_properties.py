"""Property tests: Spark column functions against the plain-Python rules they reproduce."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spendlens.functions import parse_bool, utrim
from spendlens.schema import TRUTHY

WS = st.sampled_from(list("\t\n\x0b\x0c\r\x1c\x1f \x85\xa0       　​"))
TEXT = st.lists(st.one_of(WS, st.characters(blacklist_categories=("Cs",))), max_size=12).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=60))
def test_utrim_equals_python_strip(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(utrim(F.col("s"))).collect()]
    assert got == [v.strip() for v in values]


FLAGS = st.one_of(st.sampled_from(["true", "True", "TRUE", "1", "t", "T", "y", "Y", "yes", "YES", " true", "1.0",
                                   "false", "0", "no", "on", ""]), TEXT)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), FLAGS), min_size=1, max_size=60))
def test_parse_bool_equals_truthy_rule(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(parse_bool(F.col("s"))).collect()]
    assert got == [v is not None and str(v).lower() in TRUTHY for v in values]
