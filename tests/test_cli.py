import json

from quillon import cli
from quillon.operators import chunking, evaluate, maintain
from quillon.operators.store import Store


def test_round_trip(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("The warranty is three years.\nDelivery in two weeks.")
    (tmp_path / "docs" / "b.txt").write_text("Payment by bank transfer.")
    (tmp_path / "cases.jsonl").write_text('{"query": "warranty years", "answer_evidence": ["three years"], "relevant": [{"source": "a.txt", "pages": [1]}]}\n')
    index = str(tmp_path / "index")
    assert cli.main(["ingest", str(tmp_path / "docs"), "--index", index]) == 0
    assert json.loads(capsys.readouterr().out)["index"]["documents"] == 2
    assert cli.main(["search", "warranty", "--index", index, "--expand", "500"]) == 0
    hits = json.loads(capsys.readouterr().out)["hits"]
    assert len(hits) == 1 and "three years" in hits[0]["text"] and hits[0]["parent_context"]
    assert cli.main(["reindex", str(tmp_path / "two"), "--index", index, "--max-tokens", "64"]) == 0
    capsys.readouterr()
    assert cli.main(["search", "x", "--index", str(tmp_path / "none")]) == 2


def test_pages_sections_and_evaluation(spark, tmp_path, capsys):
    """Form feeds part pages; running headers go; chunks carry their section path and the pages they cite; pages decide what counts as found."""
    page = lambda n, body: f"ACME Tender 2020\n{body}\nPage {n} of 3"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "tender.txt").write_text("\f".join([page(1, "Section 1: Scope of supply\nServers and storage are supplied by the vendor."), page(2, "Section 2: Warranty terms\nThe warranty of every server is five years."), page(3, "Delivery happens within two weeks.")]))
    (tmp_path / "cases.jsonl").write_text('{"query": "warranty of the server", "relevant": [{"source": "tender.txt", "pages": [2]}]}\n{"query": "storage supplied", "relevant": [{"source": "tender.txt", "pages": [3]}]}\n')
    index = str(tmp_path / "index")
    assert cli.main(["ingest", str(tmp_path / "docs"), "--index", index]) == 0
    chunks = Store(spark, index).read("chunks").orderBy("chunk").collect()
    assert [c.context for c in chunks] == ["tender.txt > Section 1: Scope of supply", "tender.txt > Section 2: Warranty terms"]
    assert not any("ACME" in c.text or " of 3" in c.text for c in chunks) and [sorted({x.page for x in c.citations}) for c in chunks] == [[1], [2, 3]]
    assert spark.read.parquet(f"{index}/report").first().chunks == 2
    capsys.readouterr()
    assert cli.main(["evaluate", str(tmp_path / "cases.jsonl"), "--index", index, "-k", "1"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["cases"], out["hit_rate"], out["mrr"]) == (2, 0.5, 0.5)


def test_citations(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 2)], "doc_id int, chunk int, first int, last int")
    rows = [(1, 0, "a", "f", 1, [0.0, 1.0], "native", 1.0), (1, 1, "b", "f", 1, [0.0, 1.0], "native", 1.0), (1, 2, "c", "f", 2, [0.0, 1.0], "ocr", 0.5)]
    elements = spark.createDataFrame(rows, "doc_id int, ordinal int, id string, source string, page int, bbox array<double>, extraction string, confidence double")
    pages = spark.createDataFrame([(1, 2, ["low_ocr_confidence"]), (1, 1, ["sparse_page"])], "doc_id int, page int, warnings array<string>")
    got = {r.chunk: r for r in chunking.with_citations(chunks, elements, pages).collect()}
    assert got[0].element_ids == ["a", "b"] and [c.element_id for c in got[0].citations] == ["a"] and not got[0].needs_review
    assert got[1].needs_review
    hits = spark.createDataFrame([(1, 1, [("x/f", 3)]), (1, 2, [("f", 2)])], "query_id int, rank int, citations array<struct<source string, page int>>")
    cases = spark.createDataFrame([(1, [("f", [2, 5])])], "query_id int, relevant array<struct<source string, pages array<int>>>")
    m = evaluate.page_matches(hits, cases).first()
    assert (m.first, m.found, m.wanted) == (2, 1, 2)


def test_refresh_metadata(spark):
    docs = spark.createDataFrame([("1", "d/a.pdf", {"category": "old", "own": "x"}), ("2", "d/b.pdf", {"k": "v"})], "id string, source string, metadata map<string,string>")
    manifest = spark.createDataFrame([("a.pdf", "new", None)], "filename string, category string, notes string")
    got = {r.id: r.metadata for r in maintain.refresh_metadata(docs, manifest).collect()}
    assert got == {"1": {"category": "new", "own": "x"}, "2": {"k": "v"}}
