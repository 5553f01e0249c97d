"""Search over a store's datasets: a batch of queries at a time."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, query_variants
from ..sources.scratch import kept
from . import dense as dense_
from . import fusion, lexical

MODES = ("lexical", "dense", "hybrid")


#: Columns by which a query limits its own search.
SCOPES = ("only_document", "only_category")


def _scoped(queries: DataFrame) -> bool:
    return all(c in queries.columns for c in SCOPES)


def _inside() -> Column:
    return F.coalesce(F.col("only_document") == F.col("_doc"), F.lit(True)) & F.coalesce(F.col("only_category") == F.col("_category"), F.lit(True))


def _dense_within(vectors: DataFrame, queries: DataFrame, chunks: DataFrame, pool: int) -> DataFrame:
    """Dense lists of queries that limit themselves to a document or a category: each meets the vectors there only, by an equi-join."""
    of = vectors.join(chunks.select("id", F.col("doc_id").alias("_doc"), F.col("category").alias("_category")), "id")
    asked = queries.select("query_id", *SCOPES, F.col("vector").alias("_q"))
    one = of.join(asked.where("only_document IS NOT NULL"), F.col("_doc") == F.col("only_document"))
    many = of.join(asked.where("only_document IS NULL AND only_category IS NOT NULL"), F.col("_category") == F.col("only_category"))
    scored = one.unionByName(many).where(_inside()).select("query_id", "id", "ingest_seq", dot(F.col("vector"), F.col("_q")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ingest_seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= pool).select("query_id", "id", "score", "rank")


def ranked_lists(queries: DataFrame, chunks: DataFrame, mode: str, pool: int, variants: bool = False, vectors: DataFrame | None = None, posts: DataFrame | None = None, lengths: DataFrame | None = None, document_id: str | None = None, category: str | None = None) -> DataFrame:
    """(query_id, method, id, rank, score) of each list of a search. Filters on document and category act on what is ranked, never on the
    corpus statistics; queries may bring their own (only_document, only_category, null: none)."""
    allowed = chunks
    if document_id is not None:
        allowed = allowed.where(F.col("doc_id") == document_id)
    if category is not None:
        allowed = allowed.where(F.col("category") == category)
    filtered = document_id is not None or category is not None
    lists = []
    if mode in ("lexical", "hybrid"):
        texts = queries.select("query_id", F.lit("lexical").alias("method"), "text")
        if variants:
            more = queries.select("query_id", F.posexplode(query_variants(F.col("text"))).alias("n", "text"))
            texts = texts.unionByName(more.select("query_id", F.concat(F.lit("lexical_variant_"), (F.col("n") + 1).cast("string")).alias("method"), "text"))
        if _scoped(queries):
            scores = lexical.bm25(texts, lexical.postings(chunks) if posts is None else posts, lexical.chunk_lengths(chunks) if lengths is None else lengths)
            if filtered:
                scores = scores.join(allowed.select("id"), "id", "left_semi")
            of = chunks.select("id", F.col("doc_id").alias("_doc"), F.col("category").alias("_category"))
            scores = scores.join(queries.select("query_id", *SCOPES), "query_id").join(of, "id").where(_inside()).select("query_id", "method", "id", "score")
        else:
            if posts is not None and lengths is None:
                lengths = lexical.chunk_lengths(chunks)
            scores = lexical.bm25_top(texts, pool, chunks, posts, lengths, allowed.select("id") if filtered else None)
        lists.append(lexical.top(scores, pool, "id").select("query_id", "method", "id", "rank", "score"))
    if mode in ("dense", "hybrid"):
        if vectors is None or "vector" not in queries.columns:
            raise ValueError(f"mode {mode} needs vectors of chunks and queries")
        some = vectors.join(allowed.select("id"), "id", "left_semi") if filtered else vectors
        found = dense_.search(some, queries.where("only_document IS NULL AND only_category IS NULL") if _scoped(queries) else queries, pool)
        if _scoped(queries):
            found = found.unionByName(_dense_within(some, queries, chunks, pool))
        lists.append(found.select("query_id", F.lit("dense").alias("method"), "id", "rank", "score"))
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, mode: str = "hybrid", candidates: int = 50, variants: bool = False, reranker=None, timings: dict | None = None, **lists) -> DataFrame:
    """The k best chunks of each query (query_id, text[, vector]): (query_id, place, id, score, score_type, mode, ranks, and the chunk's columns).

    The score is the reciprocal-rank sum, or the reranker's; scores of the lists themselves only rank. Blank queries have no hits. What a hit shows is joined
    to the k best alone. timings: a dictionary that gets what each stage of the batch took, in milliseconds. Then each stage's few rows are written to
    the shared folder when it ends and the next stage reads them, so no stage runs twice."""
    if k < 1 or candidates < 1 or mode not in MODES:
        raise ValueError("k and candidates must be 1 at least, mode one of lexical, dense, hybrid")
    asked = queries.where(F.trim("text") != "")
    plain = mode == "lexical" and reranker is None and not variants
    pool = k if plain else max(k, candidates)

    def stage(name: str, make) -> DataFrame:
        began = time.perf_counter()
        # what is reranked is read several times
        out = make() if timings is None and (reranker is None or name == "format") else kept(make())
        if timings is not None:
            timings[f"{name}_ms"] = round((time.perf_counter() - began) * 1000, 3)
        return out

    ranked = stage("retrieval", lambda: ranked_lists(asked, chunks, mode, pool, variants, **lists))
    fused = stage("merge", lambda: fusion.fuse(ranked, pool))
    score, kind = F.col("fused"), "rrf"

    def reranked() -> DataFrame:
        texts = chunks.select("id", F.concat_ws("\n", "context", "text").alias("passage"))
        return fusion.rerank(fused.join(texts, "id").join(asked.select("query_id", F.col("text").alias("query")), "query_id"), reranker).drop("passage")

    if reranker is not None:
        fused = stage("rerank", reranked)
        score, kind = F.col("rerank"), "rerank"
    elif timings is not None:
        timings["rerank_ms"] = 0.0
    best = fused.where(F.col("place") <= k).select("query_id", "place", "id", score.alias("score"), F.lit(kind).alias("score_type"), F.lit(mode).alias("retrieval_mode"), "ranks")
    return stage("format", lambda: best.join(chunks, "id"))
