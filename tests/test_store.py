import pytest
from pyspark.sql import functions as F

from quillon.operators.store import Store
from quillon.sources import files
from quillon.streaming.ingest import chunked, ingest


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, text string, source string")


def test_upsert_replaces_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.upsert(*chunked(docs(spark, [("1", "alpha beta", "s"), ("2", "gamma", "s")])))
    store.upsert(*chunked(docs(spark, [("1", "alpha beta", "s"), ("2", "gamma", "s")])))
    assert store.stats() == {"documents": 2, "sections": 2, "chunks": 2, "embedding_model": None}
    store.upsert(*chunked(docs(spark, [("2", "delta", "s"), ("3", "eps", "s")])))
    assert sorted(r.text for r in store.read("chunks").collect()) == ["alpha beta", "delta", "eps"]
    assert store.read("postings").where("term = 'gamma'").count() == 0
    store.delete(spark.createDataFrame([("1",)], "id string"))
    assert store.stats()["documents"] == 2 and store.read("lengths").count() == 2


def test_failed_writes_leave_the_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    ids, sections, chunks = chunked(docs(spark, [("1", "alpha", "s")]))
    store.upsert(ids, sections, chunks)
    with pytest.raises(ValueError):
        store.upsert(ids, sections, chunks.unionByName(chunks))
    with pytest.raises(ValueError):
        store.upsert(ids.where("false"), sections, chunks)
    with pytest.raises(ValueError):
        store.upsert(ids, sections, chunks, chunks.select("id", "doc_id", F.array(F.lit(1.0)).alias("vector")), "m")
    assert store.stats()["chunks"] == 1


def test_stream(spark, tmp_path):
    docs(spark, [("1", "alpha", "s"), ("2", "beta", "s")]).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("doc_id string, text string, source string").parquet(str(tmp_path / "in"))
    ingest(stream, store, str(tmp_path / "check")).awaitTermination(120)
    assert store.stats()["documents"] == 2


def test_files(spark, tmp_path):
    (tmp_path / "hw").mkdir()
    for n in ("a", "b"):
        (tmp_path / "hw" / f"{n}.pdf").write_bytes(n.encode())
    (tmp_path / "manifest.json").write_text('[{"filename": "a.pdf", "title": "A title", "category": "server"}]')
    found = files.with_manifest(files.binary_documents(spark, str(tmp_path)), files.read_manifest(spark, str(tmp_path / "manifest.json")))
    assert {(r.category, r.title) for r in found.collect()} == {("server", "A title"), ("hw", "b")}
    with pytest.raises(ValueError):
        files.binary_documents(spark, str(tmp_path / "hw"), "*.doc")

    def parser(content):
        if content == b"b":
            raise OSError("unreadable")
        yield {"text": content.decode(), "kind": "paragraph", "page": 1}

    kinds = {r.kind: r.text for r in files.parsed(files.binary_documents(spark, str(tmp_path)), parser).collect()}
    assert kinds == {"paragraph": "a", "failure": "OSError: unreadable"}
    (tmp_path / "cases.jsonl").write_text('{"query": "q", "answer_evidence": ["x", ["y", "z"]], "relevant": [{"source": "a.pdf", "pages": [1, 2]}]}\n\n')
    case = files.read_cases(spark, str(tmp_path / "cases.jsonl")).first()
    assert case.answer_evidence == [["x"], ["y", "z"]] and case.relevant[0].pages == [1, 2]
