"""Command line: ingest, reindex, search, evaluate, export, compact."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import basename
from .operators import chunking, dense, evaluate, fusion, maintain, search, structure
from .operators.store import Store
from .sources import files
from .sources.scratch import kept


def _session() -> SparkSession:
    return SparkSession.builder.appName("quillon").getOrCreate()


def _table_corpus(spark: SparkSession, args, embedder) -> tuple[structure.Corpus, DataFrame]:
    """A Parquet table with doc_id, text, source."""
    rows = spark.read.parquet(args.path).select(F.col("doc_id").cast("string"), "text", "source").dropDuplicates(["doc_id"])
    documents = rows.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), basename(F.col("source")).alias("title"), F.col("source").alias("category"))
    made = structure.corpus(structure.text_elements(rows), documents, args.max_tokens, embedder=_boundaries(args, embedder), threshold=args.semantic_threshold)
    return made, spark.createDataFrame([], "doc_id string, error string")


def _file_corpus(spark: SparkSession, args, embedder) -> tuple[structure.Corpus, DataFrame]:
    """Files below a path with the nearest manifests, as plain text or through a parser; and the files that the parser failed on."""
    found = files.binary_documents(spark, args.path, args.pattern or ("*.pdf" if args.parser else "*.txt"))
    named = files.with_nearest_manifest(found, files.read_manifests(spark, args.path)).dropDuplicates(["doc_id"])
    title = F.col("title") if args.parser else F.coalesce(F.nullif(F.col("manifest.title"), F.lit("")), basename(F.col("path")))
    documents = kept(named.select(F.col("doc_id").alias("id"), F.col("path").alias("source"), "sha256", title.alias("title"), "category", F.to_json("manifest").alias("metadata")))
    if not args.parser:
        texts = named.select("doc_id", F.decode("content", "UTF-8").alias("text"), F.col("path").alias("source"))
        raw, bookmarks, failed = structure.text_elements(texts), None, spark.createDataFrame([], "doc_id string, error string")
    else:
        parsed = kept(files.parsed(named, dense.load(args.parser)))
        raw, bookmarks, failed = structure.parsed_elements(parsed.where("kind <> 'bookmark'"), documents), files.outlines(parsed), files.failures(parsed)
        documents = documents.join(failed.select(F.col("doc_id").alias("id")), "id", "left_anti")
    made = structure.corpus(raw, documents, args.max_tokens, bookmarks, embedder=_boundaries(args, embedder), threshold=args.semantic_threshold)
    return made, failed


def _boundaries(args, embedder):
    if args.semantic_boundaries and embedder is None:
        raise ValueError("--semantic-boundaries needs --embedding-model")
    return embedder if args.semantic_boundaries else None


def _embedder(args):
    return dense.load_embedder(args.embedding_model) if args.embedding_model else None


def put(store: Store, made: structure.Corpus, embedder=None) -> int:
    """Write a corpus to the store, with vectors of contexts and texts where there is an embedder."""
    vectors = None
    if embedder is not None:
        texts = made.chunks.select("id", F.concat_ws("\n", "context", "text").alias("text"))
        vectors = kept(dense.encode_long(texts, embedder).join(made.chunks.select("id", "doc_id"), "id").withColumn("vector", F.col("vector").cast("array<float>")))
    return store.upsert(made.documents, made.sections, made.chunks, vectors, embedder.name if embedder else None, made.elements, made.pages)


def _report(store: Store, made: structure.Corpus, failed: DataFrame, version: int) -> dict:
    """Rows for each document, flagged page and failure beside the deltas, by version; they grow with the corpus, so only their sums are printed."""
    totals = kept(evaluate.ingest_totals(made.documents, made.elements, made.sections, made.chunks, made.pages, failed))
    totals.where("doc_id IS NOT NULL").write.parquet(f"{store.root}/report/version={version}")
    evaluate.flagged_pages(made.pages).write.parquet(f"{store.root}/flagged/version={version}")
    failed.write.parquet(f"{store.root}/failures/version={version}")
    total = totals.where("doc_id IS NULL").drop("doc_id").first()
    return total.asDict() if total else {}


def ingest(args) -> tuple[dict, int]:
    spark, began = _session(), time.time()
    store, embedder = Store(spark, args.index), _embedder(args)
    made, failed = (_table_corpus if args.path.rstrip("/").endswith(".parquet") else _file_corpus)(spark, args, embedder)
    failed = kept(failed)
    version = put(store, made, embedder)
    totals = _report(store, made, failed, version)
    metrics = evaluate.chunk_metrics(made.chunks).first().asDict()
    config = {k: getattr(args, k) for k in ("path", "max_tokens", "embedding_model", "semantic_boundaries", "semantic_threshold", "parser")}
    out = {"config": config, "version": version, "index": store.stats(), "metrics": metrics, "totals": totals, "report": f"{store.root}/report", "elapsed_seconds": round(time.time() - began, 2)}
    bad = totals.get("failures", 0) > 0 or args.strict and totals.get("unread_pages", 0) > 0
    return out, 2 if bad else 0


def reindex(args) -> tuple[dict, int]:
    """Chunk the stored elements of the documents as they are now anew into another index; nothing is parsed again."""
    spark = _session()
    old, new, embedder = Store(spark, args.index), Store(spark, args.output), _embedder(args)
    held = old.settings()
    documents, elements, sections, pages = (old.read(d, held or None) for d in ("documents", "elements", "sections", "pages"))
    if args.refresh_structure:
        now = files.binary_documents(spark, args.refresh_structure, args.pattern or "*")
        hashes = documents.select("id", "source").join(now.select(F.col("path").alias("source"), "sha256"), "source").select("id", "sha256")
        raw = maintain.raw_elements(elements, documents, hashes)
        named = files.with_nearest_manifest(documents.withColumnRenamed("source", "path").withColumn("_title", F.col("title")), files.read_manifests(spark, args.refresh_structure))
        fresh = F.coalesce(F.nullif(F.col("manifest.title"), F.lit("")), F.col("_title"))
        documents = named.select("id", F.col("path").alias("source"), "sha256", fresh.alias("title"), "category", F.coalesce(F.to_json("manifest"), "metadata").alias("metadata"))
        made = structure.corpus(raw, documents, args.max_tokens, embedder=_boundaries(args, embedder), threshold=args.semantic_threshold)
    else:
        made = structure.rechunked(elements, documents, sections, pages, args.max_tokens, _boundaries(args, embedder), args.semantic_threshold)
    version = put(new, made, embedder)
    totals = _report(new, made, spark.createDataFrame([], "doc_id string, error string"), version)
    return {"version": version, "index": new.stats(), "totals": totals}, 0


def hits(store: Store, queries: DataFrame, args, timings: dict | None = None, **filters) -> DataFrame:
    """Search the store for queries (query_id, text; only_document, only_category); dense modes take the model that the store names."""
    held = store.settings()
    lists = {"posts": store.read("postings", held), "lengths": store.read("lengths", held), **filters}
    if args.mode != "lexical":
        if not held.get("embedding_model"):
            raise ValueError("the store has no vectors: use --mode lexical, or ingest with --embedding-model")
        if args.embedding_model and args.embedding_model != held["embedding_model"]:
            raise ValueError(f"the store holds vectors of {held['embedding_model']}, not of {args.embedding_model}")
        queries = kept(dense.encode_queries(queries, dense.load_embedder(held["embedding_model"])))
        lists["vectors"] = store.read("vectors", held).select("id", F.xxhash64("id").alias("ingest_seq"), "vector")
    reranker = fusion.load_reranker(args.reranker) if args.reranker else None
    return search.search(queries, store.read("chunks", held), args.k, args.mode, args.candidates, args.variants, reranker, timings, **lists)


def find(args) -> tuple[dict, int]:
    spark, timings = _session(), {}
    store = Store(spark, args.index)
    asked = spark.createDataFrame([(1, args.query)], "query_id int, text string")
    found = hits(store, asked, args, timings, document_id=args.document, category=args.category).orderBy("place")
    rows = [r.asDict(recursive=True) for r in found.collect()]
    if args.expand and rows:
        near = chunking.expand(store.read("chunks"), found.select("id"), args.expand).join(store.read("chunks").select("id", "text"), "id").orderBy("target", "chunk").collect()
        for r in rows:
            r["parent_context"] = [x.text for x in near if x.target == r["id"]]
    return {"query": args.query, "hits": rows, "timings": timings}, 0


def judge(args) -> tuple[dict, int]:
    """Evaluate labelled cases, each on its own even if two ask the same: a page counts as found if a hit cites it, sources go by name,
    evidence by context and text of all hits. A row for each case goes to --output."""
    spark, timings = _session(), {}
    store = Store(spark, args.index)
    cases = kept(files.read_cases(spark, args.cases).withColumn("query_id", F.monotonically_increasing_id()))
    evaluate.check_cases(cases)
    if args.scope_to_relevant_document:
        cases = kept(evaluate.scopes(cases, store.read("documents")))
    scope = F.col("document_id") if args.scope_to_relevant_document else F.lit(None).cast("string")
    asked = cases.select("query_id", F.col("query").alias("text"), scope.alias("only_document"), F.col("category").alias("only_category"))
    began = time.perf_counter()
    details = kept(evaluate.case_details(cases, hits(store, asked, args, timings)))
    took = (time.perf_counter() - began) * 1000
    if args.output:
        details.write.json(args.output)
    out = evaluate.evaluation_summary(details).first().asDict()
    config = {k: getattr(args, k) for k in ("k", "mode", "reranker", "candidates", "variants", "scope_to_relevant_document")}
    return out | config | {"mean_query_latency_ms": round(took / max(1, out["cases"]), 3), "search_stages_ms": timings, "details": args.output}, 0


def export(args) -> tuple[dict, int]:
    """Documents with their elements, and chunks, as JSON lines: a folder each, parted by a hash of the document as the store is."""
    store = Store(_session(), args.index)
    held = store.settings()
    for dataset in ("documents", "elements", "sections", "chunks"):
        rows = store.read(dataset, held or None)
        key = "id" if dataset == "documents" else "doc_id"
        parted = rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(store.buckets)).cast("int"))
        parted.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").json(f"{args.output}/{dataset}")
    return {"version": held["version"], "output": args.output}, 0


def compact(args) -> tuple[dict, int]:
    store = Store(_session(), args.index)
    version = store.compact()
    return {"version": version, "removed_deltas": store.vacuum() if args.vacuum else 0}, 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, run in (("ingest", ingest), ("reindex", reindex), ("search", find), ("evaluate", judge), ("export", export), ("compact", compact)):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        if name != "compact":
            p.add_argument({"ingest": "path", "reindex": "output", "search": "query", "evaluate": "cases", "export": "output"}[name])
        if name not in ("export", "compact"):
            p.add_argument("--embedding-model")
        p.add_argument("--index", required=True)
        if name in ("ingest", "reindex"):
            p.add_argument("--max-tokens", type=int, default=384)
            p.add_argument("--semantic-boundaries", action="store_true")
            p.add_argument("--semantic-threshold", type=float, default=0.35)
            p.add_argument("--pattern")
        if name == "ingest":
            p.add_argument("--parser", help="module:function from bytes to elements")
            p.add_argument("--strict", action="store_true", help="unread pages end with exit code 2")
        if name == "reindex":
            p.add_argument("--refresh-structure", metavar="FOLDER", help="headings and metadata anew; the files in it must be unchanged")
        if name in ("search", "evaluate"):
            p.add_argument("-k", type=int, default=5)
            p.add_argument("--mode", choices=search.MODES, default="lexical")
            p.add_argument("--variants", action="store_true")
            p.add_argument("--reranker", help="word-overlap or module:factory")
            p.add_argument("--candidates", type=int, default=50)
        if name == "search":
            p.add_argument("--document")
            p.add_argument("--category")
            p.add_argument("--expand", type=int, default=0)
        if name == "evaluate":
            p.add_argument("--scope-to-relevant-document", action="store_true")
            p.add_argument("--output")
        if name == "compact":
            p.add_argument("--vacuum", action="store_true")
    args = parser.parse_args(argv)
    try:
        out, code = args.run(args)
        print(json.dumps(out, ensure_ascii=False, default=str))
    except (ValueError, ImportError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
