import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import chunking, dense, evaluate, fusion, layout, lexical, search, sections


def test_pack_equals_a_loop(spark):
    random.seed(1)
    rows = [(d, i, " ".join(["word"] * random.randint(1, 60)), random.choice("ab")) for d in range(5) for i in range(30)]
    got = chunking.pack(spark.createDataFrame(rows, "doc_id int, ordinal int, text string, section_id string"), 64, 10).orderBy("doc_id", "chunk").collect()
    want = []
    for d in range(5):
        pending, section = [], None

        def size(parts):
            t = "\n\n".join(parts)
            return max(len(t.split()), (len(t) + 2) // 3)

        for _, _, t, s in [r for r in rows if r[0] == d]:
            for part in __import__("quillon.functions.text", fromlist=["x"]).split_text(t, 64):
                if pending and (s != section or size([*pending, part]) > 64):
                    want.append((d, "\n\n".join(pending)))
                    pending = []
                pending.append(part)
                section = s
        want.append((d, "\n\n".join(pending)))
    assert [(r.doc_id, r.text) for r in got] == want
    assert all(r.token_count <= 64 for r in got)


def test_topic_break_needs_a_minimum(spark):
    rows = [(1, i, "alpha beta gamma " * 5, i == 1) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, text string, topic boolean")
    assert chunking.pack(df, 384, 10).count() == 2
    assert chunking.pack(df, 384, 80).count() == 1
    with pytest.raises(ValueError):
        chunking.pack(df, 16, 0)


def test_tables(spark):
    head = ["Item", "Requirement"]
    rows = [
        (1, head, [head, ["GPU", "80GB memory"], ["Warranty", "years " * 80]]),
        (2, head, [head]),
        (3, None, [["a", None], ["b", "c"]]),
        (4, ["Requirement " * 60, "Compliance"], [["Requirement " * 60, "Compliance"], ["x", "y"]]),
    ]
    df = spark.createDataFrame(rows, "doc_id int, header array<string>, rows array<array<string>>")
    got = chunking.table_chunks(df, 64).orderBy("doc_id", "first_row", "chunk").collect()
    first = [r for r in got if r.doc_id == 1]
    assert all(r.text.startswith("Item | Requirement\n") and r.token_count <= 64 for r in first)
    assert (first[0].first_row, first[0].last_row, first[0].row_fragment) == (2, 2, False)
    assert first[1].row_fragment and sum(r.text.count("years") for r in first) == 80
    assert [(r.text, r.first_row) for r in got if r.doc_id == 2] == [("Item | Requirement", 1)]
    assert [r.text for r in got if r.doc_id == 3] == ["a | \nb | c"]
    assert sum(r.text.count("Requirement") for r in got if r.doc_id == 4) == 60
    assert all(r.text.startswith("Col 1 | Col 2\n") for r in got if r.doc_id == 4)


def test_section_tree_equals_a_stack(spark):
    random.seed(2)
    rows = [(d, i, f"e{d}-{i}", random.choice(["heading", "paragraph"]), random.randint(1, 6), f"t{i}", 1, random.random() < 0.1) for d in range(4) for i in range(60)]
    placed, tree = sections.section_tree(spark.createDataFrame(rows, "doc_id int, ordinal int, id string, kind string, level int, text string, page int, excluded boolean"))
    got = {(r.doc_id, r.ordinal): r.section_path for r in placed.collect()}
    for d in range(4):
        stack = []
        for _, i, _, kind, level, text, _, out in [r for r in rows if r[0] == d]:
            if out:
                assert (d, i) not in got
                continue
            if kind == "heading":
                while stack and stack[-1][0] >= level:
                    stack.pop()
                stack.append((level, text))
            assert got[d, i] == [t for _, t in stack]
    known = {r.id for r in tree.collect()}
    assert all(r.parent_id is None or r.parent_id in known for r in tree.collect())


def test_reading_order():
    page = [(50, 10, 550, 30), (50, 50, 280, 70), (320, 50, 550, 70), (50, 90, 280, 110), (320, 90, 550, 110)]
    assert layout.order_boxes(page, 600) == [0, 1, 3, 2, 4]
    assert layout.order_boxes([], 600) == []
    # boxes with one top are read from the left
    assert layout.order_boxes([(300, 10, 310, 20), (290, 10, 299, 20)], 600) == [1, 0]


def test_bm25_equals_sqlite(spark):
    random.seed(3)
    words = "warranty server gpu memory delivery penalty months the Café naïve".split()
    rows = [(i, random.choice(words), " ".join(random.choices(words, k=random.randint(1, 30)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(id unindexed, context, text, tokenize='unicode61 remove_diacritics 2')")
    db.executemany("insert into t values (?, ?, ?)", rows)
    chunks = spark.createDataFrame(rows, "id int, context string, text string")
    asked = spark.createDataFrame([(1, "lexical", "gpu warranty cafe"), (2, "lexical", "Server server memory")], "query_id int, method string, text string")
    got = lexical.bm25(asked, lexical.postings(chunks), lexical.chunk_lengths(chunks)).collect()
    for q, match in ((1, '"gpu" OR "warranty" OR "cafe"'), (2, '"Server" OR "server" OR "memory"')):
        want = dict(db.execute("select id, bm25(t, 0, 0.7, 1) from t where t match ?", [match]))
        have = {r.id: r.score for r in got if r.query_id == q}
        assert have.keys() == want.keys() and all(math.isclose(have[i], -want[i], rel_tol=1e-9) for i in want)


def test_fusion_and_rerank(spark):
    lists = spark.createDataFrame([(1, "lexical", "a", 1), (1, "dense", "a", 2), (1, "dense", "b", 1), (1, "lexical_variant_1", "b", 1)], "query_id int, method string, id string, rank int")
    got = fusion.fuse(lists, 5).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "b"] and math.isclose(got[0].fused, 1.5 / 61 + 1 / 62)
    assert got[0].ranks == {"lexical": 1, "dense": 2}
    long = "filler " * 200 + "warranty answer"
    assert fusion.windowed(lambda q, ps: [10.0 if "answer" in p else -1.0 for p in ps], 64)("find it", [long, "none"]) == [10.0, -1.0]


def test_search_modes(spark):
    chunks = spark.createDataFrame([("a", "d1", "x", "t", "gpu warranty"), ("b", "d2", "y", "t", "server memory"), ("c", "d2", "y", "t", "gpu server")], "id string, doc_id string, category string, context string, text string")
    model = dense.HashedWords(32)
    vectors = dense.encode(chunks, "text", model).select("id", F.monotonically_increasing_id().alias("ingest_seq"), "vector")
    asked = dense.encode(spark.createDataFrame([(1, "gpu warranty"), (2, " ")], "query_id int, text string"), "text", model)
    hybrid = search.search(asked, chunks, 2, "hybrid", vectors=vectors).orderBy("place").collect()
    assert [r.query_id for r in hybrid] == [1, 1] and hybrid[0].id == "a" and math.isclose(hybrid[0].score, 2.5 / 61)
    only = search.search(asked, chunks, 5, "lexical", document_id="d2").collect()
    assert {r.doc_id for r in only} == {"d2"}
    assert search.search(asked, chunks, 1, "lexical", reranker=fusion.overlap_scorer).first().score_type == "rerank"
    with pytest.raises(ValueError):
        search.search(asked, chunks, 0)
    with pytest.raises(ValueError):
        dense.check_vectors(spark.createDataFrame([([float("nan")],)], "vector array<double>"), 1)


def test_expand(spark):
    rows = [(str(i), 1, i, "s", n) for i, n in enumerate([100, 200, 300, 50, 400])]
    chunks = spark.createDataFrame(rows, "id string, doc_id int, chunk int, section_id string, token_count int")
    got = chunking.expand(chunks, spark.createDataFrame([("2",)], "id string"), 700).collect()
    assert sorted(r.id for r in got) == ["0", "1", "2", "3"] and got[0].total == 650


def test_evaluation(spark):
    got = evaluate.latency(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double"), "v").first()
    assert (got.p50, got.p95, got["mean"]) == (2, 10, 4)
    terms = F.array(F.array(F.lit("3 months"), F.lit("three months")), F.array(F.lit("refund")))
    assert spark.range(1).select(evaluate.evidence(terms, F.lit("Three, Months!"))).first()[0] == 0.5
    assert evaluate.chunk_metrics(spark.createDataFrame([], "token_count int, context string")).first().tokens == 0


def test_table_grids(spark):
    rows = [(1, [["a", "b"], ["c", None]]), (2, [["a"]]), (3, [["Item", "Price"], ["x", "1"], ["y", "2"]])]
    df = spark.createDataFrame(rows, "id int, rows array<array<string>>")
    assert [r.id for r in layout.sound_tables(df).collect()] == [3]
    heads = {r.id: r.header for r in layout.header_row(df).collect()}
    assert heads[3] == ["Item", "Price"] and heads[1] == ["Column 1", "Column 2"]


def test_line_starts_of_fragments(spark):
    """(a) begins an item, (1) doesn't; a block ends a fragment."""
    rows = [(1, i, 1, 0.0, 0.0, 9.0, 9.0, 11.0, False, t, b) for i, (t, b) in enumerate([("intro", 1), ("(1) x", 1), ("(a) y", 1), ("2.1 z", 1), ("tail", 2)])]
    lines = spark.createDataFrame(rows, "doc_id int, ordinal int, page int, x0 double, y0 double, x1 double, y1 double, font_size double, bold boolean, text string, block int")
    got = [r.text for r in layout.fragments(lines).orderBy("fragment").collect()]
    assert got == ["intro\n(1) x", "(a) y", "2.1 z", "tail"]


def test_page_warnings_and_heights(spark):
    text = [(1, 1, "\ufffd" * 10 + "x" * 100), (1, 2, "short"), (1, 3, "w" * 200)]
    elements = spark.createDataFrame([(*r, "paragraph") for r in text], "doc_id int, page int, text string, kind string")
    images = spark.createDataFrame([(1, 2, 0.1), (1, 3, 0.7)], "doc_id int, page int, region_ratio double")
    got = {r.page: (r.needs_ocr, r.warnings) for r in layout.page_quality(elements, images).collect()}
    assert got == {1: (False, ["replacement_characters_in_native_text"]), 2: (True, ["needs_ocr", "sparse_page"]), 3: (True, ["needs_ocr"])}
    rows = [(1, p, p, 50.0, 20.0, 300.0, 32.0, "Head", "paragraph") for p in (1, 2, 3)]
    heads = spark.createDataFrame(rows, "doc_id int, page int, ordinal int, x0 double, y0 double, x1 double, y1 double, text string, kind string")
    sized = lambda n, height: spark.createDataFrame([(1, p, height) for p in range(1, n + 1)], "doc_id int, page int, height double")
    excluded = lambda pages: layout.boilerplate(heads, pages).where("excluded").count()
    assert (excluded(None), excluded(sized(3, 792.0)), excluded(sized(20, 792.0)), excluded(sized(3, 300.0))) == (3, 3, 0, 0)


def test_header_words_and_marks(spark):
    tables = spark.createDataFrame([([["Particulars", "Qty"], ["a", "b"]],), ([["Compliance", "Price"], ["a", "b"]],)], "rows array<array<string>>")
    assert [r.header for r in layout.header_row(tables).collect()] == [["Particulars", "Qty"], ["Column 1", "Column 2"]]
    words = spark.createDataFrame([("Ąčő İstanbul",), ("Crème brûlée",)], "t string")
    assert [r[0] for r in words.select(X.index_terms(words.t)).collect()] == [["aco", "istanbul"], ["creme", "brulee"]]
