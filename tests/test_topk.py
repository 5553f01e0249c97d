import random

import numpy as np
import pytest

from quillon.operators import dense, lexical, search


@pytest.fixture
def corpus(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)] + ["the"] * 60 + ["Café", "naïve"]
    rows = [(f"c{i:03}", random.choice(words), " ".join(random.choices(words, k=random.randint(0, 40)))) for i in range(300)]
    rows += [(f"d{i:03}", "the", "the w1 w2 w1 w2") for i in range(30)] + [("e", None, None), ("f", "w1", "w2 w3")]
    asked = [(i, m, " ".join(random.choices(words, k=random.randint(1, 8)))) for i in range(40) for m in ("lexical", "lexical_variant_1")]
    asked += [(90, "lexical", "w1_w2 w1 W1"), (91, "lexical", "w1_w2_w1 cafe"), (92, "lexical", "nowhere"), (93, "lexical", "w1_w1"), (94, "lexical", "the w1")]
    return spark.createDataFrame(rows, "id string, context string, text string").repartition(5), spark.createDataFrame(asked, "query_id int, method string, text string")


@pytest.mark.parametrize("limits", [{}, {"held": 50}, {"block": 7, "held": 400}])
def test_bm25_top_equals_all_scores(spark, corpus, limits):
    chunks, asked = corpus
    posts, lengths = lexical.postings(chunks), lexical.chunk_lengths(chunks)
    want = {tuple(r) for r in lexical.top(lexical.bm25(asked, posts, lengths), 5, "id").collect()}
    assert {tuple(r) for r in lexical.top(lexical.bm25_top(asked, 5, chunks, **limits), 5, "id").collect()} == want
    if not limits:
        assert {tuple(r) for r in lexical.top(lexical.bm25_top(asked, 5, posts=posts, lengths=lengths), 5, "id").collect()} == want


def test_a_search_makes_no_row_for_each_meeting(spark, corpus):
    """Of 332 chunks, most of which hold a word of each query, only the best are rows between scoring and ranking."""
    chunks, asked = corpus
    asked = asked.where("method = 'lexical'").select("query_id", "text")
    made = lexical.bm25_top(asked.selectExpr("query_id", "'lexical' method", "text"), 5, chunks.coalesce(1))
    assert made.count() <= 5 * asked.count() * made.rdd.getNumPartitions()
    plan = search.ranked_lists(asked, chunks, "lexical", 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_dense_ties_and_blocks(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(200, 9)).astype(np.float32)
    v[50:150] = v[3]  # copies: equal scores, by ingest_seq
    rows = spark.createDataFrame([(i, 1000 - i, x.tolist()) for i, x in enumerate(v)], "id int, ingest_seq int, vector array<float>")
    asked = rows.where("id % 20 = 3").selectExpr("id AS query_id", "vector")
    for limits in ({}, {"rows_at_once": 16}, {"block": 3, "rows_at_once": 70}):
        got = {(r.query_id, r["rank"]): r.id for r in dense.search(rows, asked, 7, **limits).collect()}
        for q in range(3, 200, 20):
            scores = [sum(float(a) * float(b) for a, b in zip(v[q], x)) for x in v]
            want = sorted(range(200), key=lambda i: (-scores[i], 1000 - i))[:7]
            assert [got[q, n] for n in range(1, 8)] == want
