"""Findings about size: what a step shuffles, holds or repeats."""

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import dense, evaluate, layout
from quillon.sources import tables as S


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_structure_deals_documents_out_once(spark):
    lines = spark.createDataFrame([(d, "s", i, f"Line {i} of some words " * (i % 5)) for d in range(5) for i in range(90)], "doc_id long, category string, ordinal int, text string")
    found = layout.headings(layout.boilerplate(S.synthetic_layout(lines)))
    # two exchanges are those of the layout's own count of pages, for headers and footers
    assert _plan(found).count("Exchange hashpartitioning") <= 3
    assert found.count() == 5 * (90 + 2 * 3)


def test_centers_take_more_tasks_for_more_rows(spark):
    rows = spark.createDataFrame([(i % 50, float(i)) for i in range(2000)], "k long, v double")
    out = layout.centers(rows, "k", "v", 50.0, rows_a_task=100)
    assert out.rdd.getNumPartitions() >= 20
    assert {(r.k, r.n) for r in out.collect()} == {(k, 40) for k in range(50)}


def test_holders_of_passages_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, 400)) + "\n\tß end" for _ in range(40)] + [None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = [(q, texts[q][30 + q : 90 + q]) for q in range(20)] + [(20, "too few words"), (21, None), (22, "w1 w2 w3 w4 w5 w6 never there")]
    found = evaluate.holders(spark.createDataFrame(asked, "query_id long, passage string"), docs, block=5)
    assert "Exchange" not in _plan(found)
    want = {(q, d) for q, p in asked if p and len(p.split()) >= 6 for d, t in enumerate(texts) if t and p in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_holders_of_short_and_cut_passages_equal_brute_force(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon zetaX", "Ünder\tß end\n\n--", "b c", "a", "", None, "a" * 50, "z" * ((1 << 18) - 3) + "over the edge of it, and then more than thirty-two bytes"]
    texts += ["one head of more than thirty-two bytes, then this", "one head of more than thirty-two bytes, then that", "en", "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    passages = ["alpha beta gamma delta epsilon zet", "beta gamma", "amma del", "a", "ß", "ß e", "\n\n", " ", "", None, "ab", "end", "nd", "never there", "a" * 31, "a" * 32, "a" * 33, "a" * 51]
    passages += ["zover the edge", "over the edge of it, and then more than thirty-two bytes", "zz", "one head of more than thirty-two bytes, then", "one head of more than thirty-two bytes, then that", "one head of more than thirty-two bytes, then none", "a"]
    asked = list(enumerate(passages))
    want = sorted((q, d) for q, p in asked if p is not None for d, t in enumerate(texts) if t is not None and p in t)
    for block in (7, 4096):
        found = evaluate.holders(spark.createDataFrame(asked, "query_id long, passage string"), docs, block)
        assert sorted(map(tuple, found.collect())) == want


def test_long_texts_are_encoded_without_a_shuffle(spark):
    class Spy(dense.Letters):
        def encode_documents(self, texts):
            assert len(texts) <= 7
            return super().encode_documents(texts)

    texts = [("ab " * (1 + i) + "c" * (i % 4)) * (1 + i % 3) for i in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = dense.encode_long(df, Spy(), 7)
    assert "Exchange" not in _plan(found)
    got = {r.id: np.array(r.vector) for r in found.collect()}
    for i, t in enumerate(texts):
        v, (n, limit) = np.zeros(26), (len((t or "").split()), 112)
        words = (t or "").split()
        for lo in range(0, max(n, 1), limit):
            own = words[lo : lo + limit]
            v += (len(own) if n > limit else 1) * dense.Letters().encode_query(" ".join(own)).astype(float)
        assert np.allclose(got[i], v / max(np.linalg.norm(v), 1e-12))


def test_split_parts_takes_a_few_texts_at_once(spark):
    texts = ["Some words. More of them here, " * (i % 40) for i in range(3 * X.AT_ONCE + 5)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    got = {r.id: r.parts for r in df.select("id", X.split_parts(F.col("text"), 20).alias("parts")).collect()}
    assert all(got[i] == X.split_text(t, 20) for i, t in enumerate(texts) if t is not None)
