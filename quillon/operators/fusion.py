"""Fusion of ranked lists and reranking."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import kept
from .dense import load

#: Weights of the lists, and what is added to a rank.
WEIGHTS = {"lexical": 1.5, "lexical_variant_1": 0.7, "lexical_variant_2": 0.7, "dense": 1.0}
OFFSET = 60


def fuse(ranked: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, fused, ranks, place): reciprocal ranks of lists (query_id, method, id, rank) added up in the order of the methods; the pool's best
    by sum, then id. ranks maps method to rank."""
    of = {m: F.max(F.when(F.col("method") == m, F.col("rank"))) for m in WEIGHTS}
    wide = ranked.groupBy("query_id", "id").agg(*[c.alias(m) for m, c in of.items()])
    score = sum((F.coalesce(w / (OFFSET + F.col(m)), F.lit(0.0)) for m, w in WEIGHTS.items()), F.lit(0.0))
    ranks = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, WEIGHTS)), F.array(*WEIGHTS)), lambda _, r: r.isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
    return wide.select("query_id", "id", score.alias("fused"), ranks.alias("ranks")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= pool)


#: Tokens between and around query and passage, the least room for a passage, and how much windows share.
FRAME, ROOM, SHARED = 8, 32, 32


class Reranker(Protocol):
    """What a cross encoder has to offer to be plugged in; max_tokens holds query and passage together."""

    name: str
    max_tokens: int

    def tokenize(self, text: str) -> list: ...
    def detokenize(self, tokens: list) -> str: ...
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class WordOverlap:
    """A deterministic reranker without a model: the share of the query's words that a window has. Tokens are words."""

    name, max_tokens = "word-overlap", 256

    def tokenize(self, text: str) -> list[str]:
        return text.split()

    def detokenize(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, passage in pairs:
            words = set(query.lower().split())
            out.append(len(words & set(passage.lower().split())) / max(1, len(words)))
        return out


def load_reranker(name: str) -> Reranker:
    """A reranker by name: word-overlap, or module:factory of a model of one's own."""
    return WordOverlap() if name == "word-overlap" else load(name)()


def token_windows(tokens: list, budget: int) -> list[list]:
    """Windows of `budget` tokens, each sharing SHARED with the one before; all tokens are in one."""
    out = []
    for start in range(0, max(1, len(tokens)), max(1, budget - SHARED)):
        out.append(tokens[start : start + budget])
        if start + budget >= len(tokens):
            break
    return out


def passage_windows(pairs: DataFrame, reranker: Reranker) -> DataFrame:
    """(query_id, id, query, window): passages of pairs (query_id, id, query, passage) by windows that fit the model beside the query; a passage
    that fits is one window as it stands. An error if a query leaves no room."""

    @F.pandas_udf(T.IntegerType())
    def room(query: pd.Series) -> pd.Series:
        return query.map(lambda q: reranker.max_tokens - len(reranker.tokenize(q)) - FRAME)

    if not pairs.select("query_id", "query").distinct().where(room("query") < ROOM).isEmpty():
        raise ValueError("a query leaves no room for a passage; shorten it")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(query: pd.Series, passage: pd.Series) -> pd.Series:
        out, known = [], {}
        for q, p in zip(query, passage):
            if q not in known:
                known[q] = reranker.max_tokens - len(reranker.tokenize(q)) - FRAME
            tokens = reranker.tokenize(p)
            out.append([p] if len(tokens) <= known[q] else [reranker.detokenize(w) for w in token_windows(tokens, known[q])])
        return pd.Series(out)

    return pairs.select("query_id", "id", "query", F.explode(cut("query", "passage")).alias("window"))


def rerank(fused: DataFrame, reranker: Reranker | Callable[[str, list[str]], list[float]], batch: int = 64) -> DataFrame:
    """fused (query_id, id, fused, query, passage) with rerank, and place by it, then by fused, then id. A reranker scores a passage by the best of
    its windows; a plain scoring function scores passages as they stand."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("fused"), "id")
    if not hasattr(reranker, "predict"):

        @F.pandas_udf(T.DoubleType())
        def whole(query: pd.Series, passage: pd.Series) -> pd.Series:
            out = pd.Series(0.0, index=query.index)
            for q, at in query.groupby(query).groups.items():
                out[at] = reranker(q, passage[at].tolist())
            return out

        return fused.withColumn("rerank", whole("query", "passage")).withColumn("place", F.row_number().over(w))

    @F.pandas_udf(T.DoubleType())
    def score(query: pd.Series, window: pd.Series) -> pd.Series:
        pairs = list(zip(query, window))
        return pd.Series([float(x) for i in range(0, len(pairs), batch) for x in reranker.predict(pairs[i : i + batch])])

    fused = kept(fused)
    best = passage_windows(fused, reranker).withColumn("_score", score("query", "window")).groupBy("query_id", "id").agg(F.max("_score").alias("rerank"))
    return fused.join(best, ["query_id", "id"]).withColumn("place", F.row_number().over(w))


def windowed(score: Callable[[str, list[str]], list[float]], limit: int, overlap: int = 32) -> Callable[[str, list[str]], list[float]]:
    """A scorer for texts of any length: the best score of overlapping windows of words that fit the limit with the query."""

    def run(query: str, passages: list[str]) -> list[float]:
        room = limit - len(query.split()) - 8
        if room < 32:
            raise ValueError("the query leaves no room for a passage")
        out = []
        for p in passages:
            words = p.split() or [""]
            stride = max(1, room - overlap)
            parts = [" ".join(words[i : i + room]) for i in range(0, max(1, len(words) - overlap if len(words) > room else 1), stride)]
            out.append(max(score(query, parts)))
        return out

    return run


def overlap_scorer(query: str, passages: list[str]) -> list[float]:
    """A deterministic scorer: the share of the query's words that a passage has."""
    words = set(query.lower().split())
    return [len(words & set(p.lower().split())) / max(1, len(words)) for p in passages]
