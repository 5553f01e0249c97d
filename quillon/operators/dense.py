"""Exact dense search and embedding of chunks."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import AT_ONCE


#: Tokens of a window that a model keeps for itself, and the least size of a window.
SPARE, LEAST = 16, 16


class Embedder(Protocol):
    """What a model has to offer to be plugged in. Its tokens decide how long a text may be."""

    name: str
    dimension: int
    max_tokens: int

    def tokenize(self, text: str) -> list: ...
    def detokenize(self, tokens: list) -> str: ...
    def encode_documents(self, texts: list[str]) -> np.ndarray: ...
    def encode_query(self, text: str) -> np.ndarray: ...


class _Words:
    """Tokens that are words."""

    max_tokens = 128

    def tokenize(self, text: str) -> list[str]:
        return text.split()

    def detokenize(self, tokens: list[str]) -> str:
        return " ".join(tokens)

    def encode_documents(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.encode_query(t) for t in texts]) if texts else np.zeros((0, self.dimension), np.float32)


class HashedWords(_Words):
    """A deterministic embedder without a model: words hashed to signed places, vectors of length 1."""

    def __init__(self, dimension: int = 64):
        self.name, self.dimension = f"hashed-words-{dimension}", dimension

    def encode_query(self, text: str) -> np.ndarray:
        import xxhash

        v = np.zeros(self.dimension, np.float32)
        for w in text.lower().split():
            h = xxhash.xxh64_intdigest(w.encode(), 7)
            v[h % self.dimension] += 1 if h >> 63 else -1
        return v / max(float(np.linalg.norm(v)), 1e-12)


class Letters(_Words):
    """A deterministic embedder that SQL can follow: how often each letter a-z occurs."""

    name, dimension = "letters", 26

    def encode_query(self, text: str) -> np.ndarray:
        at = np.frombuffer(text.lower().encode(), np.uint8)
        return np.bincount(at[(at >= 97) & (at <= 122)] - 97, minlength=26).astype(np.float32)


def load_embedder(name: str) -> Embedder:
    """An embedder by name: letters, hashed-words-N, or module:factory of a model of one's own."""
    if name == "letters":
        return Letters()
    if name.startswith("hashed-words-"):
        return HashedWords(int(name.removeprefix("hashed-words-")))
    return load(name)()


def load(name: str):
    """What module:attribute names."""
    import importlib

    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"{name} is no module:attribute")
    return getattr(importlib.import_module(module), attribute)


def encode(df: DataFrame, column: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """df with vector: the embedding of a text column."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        texts = x.fillna("").tolist()
        out = [v for i in range(0, len(texts), batch) for v in embedder.encode_documents(texts[i : i + batch])]
        return pd.Series([np.asarray(v, np.float32).tolist() for v in out])

    return df.withColumn("vector", run(F.col(column)))


def check_vectors(vectors: DataFrame, dimension: int) -> None:
    """An error if a vector has another dimension or a value that isn't finite."""
    bad = vectors.where((F.size("vector") != dimension) | F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    if not bad.isEmpty():
        raise ValueError(f"vectors must have {dimension} finite values")


def best_of_block(v: np.ndarray, seq: np.ndarray, q: np.ndarray, k: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k rows of v with the greatest inner product with each query; equal ones by seq.

    A matrix product finds those that can be among the k; their scores are added up place by place, so that equal vectors have equal scores."""
    out, norms = [], np.sqrt((v * v).sum(axis=1))
    slack = 1e-12 * v.shape[1] * (norms.max() if len(norms) else 0.0)
    for lo in range(0, len(q), at_once):
        part = q[lo : lo + at_once]
        scores = v @ part.T
        kth = np.partition(scores, len(v) - k, axis=0)[len(v) - k] if len(v) > k else np.full(len(part), -np.inf)
        row, query = np.nonzero(scores >= kth - slack * np.sqrt((part * part).sum(axis=1)))
        score = np.zeros(len(row))
        for x in range(v.shape[1]):
            score += v[row, x] * part[query, x]
        order = np.lexsort((seq[row], -score, query))
        row, query, score = row[order], query[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        out.append((query[place < k] + lo, row[place < k], score[place < k]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, rows_at_once: int = 16384) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of greatest inner product with each query; equal ones by ingest_seq.

    vectors: id, ingest_seq, vector; queries: query_id, vector; filters go before. Queries are taken in blocks of at most `block` vectors, which is what is
    broadcast; each task keeps the k best of every query of each `rows_at_once` rows, so that little is shuffled."""
    spark = vectors.sparkSession
    rows = queries.select("query_id", "vector")
    blocks = max(1, -(-rows.count() // block))
    id_type, q_type = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        own = part.collect()
        if not own:
            continue
        held = spark.sparkContext.broadcast((np.array([r[0] for r in own], object), np.array([r[1] for r in own], np.float64)))

        def run(it, held=held):
            names, q = held.value

            def best(parts):
                ids, seq, v = (np.concatenate(x) for x in zip(*parts))
                query, row, score = best_of_block(v, seq, q, k)
                return pd.DataFrame({"query_id": names[query], "id": ids[row], "ingest_seq": seq[row], "score": score})

            parts, n = [], 0
            for pdf in it:
                for lo in range(0, len(pdf), rows_at_once):
                    some = pdf.iloc[lo : lo + rows_at_once]
                    if n and n + len(some) > rows_at_once:
                        yield best(parts)
                        parts, n = [], 0
                    parts.append((some["id"].to_numpy(), some["ingest_seq"].to_numpy(), np.stack(some["vector"].to_numpy()).astype(np.float64)))
                    n += len(some)
            if n:
                yield best(parts)

        some = vectors.select("id", F.col("ingest_seq").cast("long").alias("ingest_seq"), "vector").mapInPandas(run, f"query_id {q_type}, id {id_type}, ingest_seq long, score double")
        found = some if found is None else found.unionByName(some)
    if found is None:
        return spark.createDataFrame([], f"query_id {q_type}, id {id_type}, score double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ingest_seq")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def pooled(windows: DataFrame) -> DataFrame:
    """(owner, vector): windows (owner, weight, vector) summed by weight and brought to length 1."""
    places = windows.select("owner", "weight", F.posexplode("vector").alias("at", "x"))
    sums = places.groupBy("owner", "at").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    joined = sums.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return joined.select("owner", F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12))).alias("vector"))


def _windows(text: str, embedder: Embedder, limit: int) -> list[tuple[int, str]]:
    tokens = embedder.tokenize(text)
    if len(tokens) <= limit:
        return [(max(1, len(tokens)), text)]
    return [(len(tokens[i : i + limit]), embedder.detokenize(tokens[i : i + limit])) for i in range(0, len(tokens), limit)]


def text_windows(df: DataFrame, embedder: Embedder) -> DataFrame:
    """(owner, at, n, weight, window): texts (id, text) cut to windows of as many tokens as the model takes, one after another; n windows each.
    A text of one window is it as it stands; a window weighs its tokens, 1 at least."""

    limit = max(LEAST, embedder.max_tokens - SPARE)

    @F.arrow_udf("array<struct<weight:int,window:string>>")
    def cut(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("weight", pa.int32()), ("window", pa.string())]))
        dicts = lambda t: [{"weight": n, "window": w} for n, w in _windows(t or "", embedder, limit)]
        some = [pa.array([dicts(t) for t in x.slice(lo, AT_ONCE).to_pylist()], kind) for lo in range(0, len(x), AT_ONCE)]
        return pa.concat_arrays(some) if some else pa.array([], kind)

    rows = df.select(F.col("id").alias("owner"), cut(F.col("text")).alias("_w"))
    return rows.select("owner", F.size("_w").alias("n"), F.posexplode("_w").alias("at", "_p")).select("owner", "at", "n", "_p.weight", "_p.window")


def encode_long(df: DataFrame, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(id, vector) of texts (id, text) of any length: windows are embedded in batches, summed by weight for each owner, and brought to length 1.

    A text's windows are cut, embedded and summed in one task, a few texts at a time: nothing is shuffled, and memory holds those texts' windows only."""
    kind = df.schema["id"].dataType
    limit = max(LEAST, embedder.max_tokens - SPARE)

    def run(it):
        for part in it:
            for lo in range(0, part.num_rows, AT_ONCE):
                some, windows, weights, first = part.slice(lo, AT_ONCE), [], [], [0]
                for text in some.column(1).to_pylist():
                    for weight, window in _windows(text or "", embedder, limit):
                        weights.append(weight)
                        windows.append(window)
                    first.append(len(windows))
                v = np.concatenate([np.asarray(embedder.encode_documents(windows[i : i + batch]), np.float32) for i in range(0, len(windows), batch)]).astype(np.float64)
                lone = np.diff(first) == 1
                scale = np.where(np.repeat(lone, np.diff(first)), 1.0, np.array(weights, np.float64))
                total = np.add.reduceat(v * scale[:, None], first[:-1], axis=0)
                total /= np.maximum(np.sqrt((total * total).sum(axis=1)), 1e-12)[:, None]
                ends = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))], names=["id", "vector"])

    rows = df.select("id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def encode_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """queries (query_id, text) with vector; an error if one is longer than the model takes."""

    @F.pandas_udf(T.IntegerType())
    def tokens(x: pd.Series) -> pd.Series:
        return x.fillna("").map(lambda t: len(embedder.tokenize(t)))

    if not queries.where(tokens("text") > embedder.max_tokens - SPARE).isEmpty():
        raise ValueError("a query is longer than the embedding model takes; shorten it")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(x: pd.Series) -> pd.Series:
        return x.fillna("").map(lambda t: np.asarray(embedder.encode_query(t), np.float32).tolist())

    return queries.withColumn("vector", run("text"))
