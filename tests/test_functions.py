import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as X


def count(text):
    return max(len(re.findall(r"\w+|[^\w\s]", text)), (len(text.encode()) + 2) // 3)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.!?\n 超1_,", max_size=300), st.integers(1, 40))
def test_split_is_lossless_and_bounded(text, budget):
    parts = X.split_text(text, budget)
    assert "".join(parts) == text
    assert all(count(p) <= budget or len(p) == 1 for p in parts)


def test_split_prefers_sentences_then_spaces():
    assert X.split_text("One two three. Four five six seven", 7)[0] == "One two three. "
    assert X.split_text("alpha beta gamma delta", 5)[0].endswith(" ")
    assert X.split_text("x" * 10, 2) == ["xxxxxx", "xxxx"]


def test_columns(spark):
    df = spark.createDataFrame([("12.50% security",), ("超超",), ("",)], "t string")
    assert [r[0] for r in df.select(X.token_count(F.col("t"))).collect()] == [5, 2, 0]
    row = spark.range(1).select(
        X.query_tokens(F.lit("What warranty is mandatory for the GPU server?")).alias("a"), X.query_tokens(F.lit("what is the")).alias("b"),
        X.query_variants(F.lit("Identify the EMD for the compliance matrix")).alias("c"), X.query_variants(F.lit("warranty")).alias("d"),
        X.margin_key(F.lit("  Page\t12 of 30 Straße ")).alias("e"), X.answer_text(F.lit("Three, (3) Months!")).alias("f"),
        X.clean(F.lit("ﬁne  text \n  next ")).alias("g"), X.normalized(F.lit("A-b_C ß")).alias("h"),
    ).first()
    assert row.a == ["warranty", "mandatory", "GPU", "server"]
    assert row.b == ["what", "is", "the"]
    assert row.c == ["the EMD", "Identify the earnest money deposit for the compliance matrix"]
    assert row.d == []
    assert row.e == "page # of # strasse"
    assert row.f == "three 3 months"
    assert row.g == "fine text\nnext"
    assert row.h == "ab_css"


def test_stable_id(spark):
    import hashlib

    got = spark.range(1).select(X.stable_id(F.lit("a"), F.lit(3), F.lit(None).cast("string"))).first()[0]
    assert got == hashlib.sha256(b"a\x003\x00").hexdigest()[:24]


@pytest.mark.parametrize("text", ["short", "word " * 400, "超" * 1200])
def test_split_column(spark, text):
    parts = spark.createDataFrame([(text,)], "t string").select(X.split_parts(F.col("t"), 100)).first()[0]
    assert "".join(parts) == text and all(count(p) <= 100 for p in parts)
