"""Vector bin packing of examples under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import encoder

_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold at most: tokens, pieces (segments) and tokens that bear loss."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class _Pool:
    """Unplaced items by type: a type is a number of tokens and of leading tokens without loss."""

    def __init__(self, length: np.ndarray, prompt: np.ndarray):
        order = np.lexsort((np.arange(len(length)), prompt, -length))
        self.of: dict[tuple[int, int], int] = {}
        self.tokens, self.free, self.count = np.zeros((3, 64), np.int64)
        self.items: list[list[tuple[int, int]]] = []
        for i in order[::-1].tolist():  # so that an item of less number is taken first
            self.put(int(length[i]), int(prompt[i]), i, 0)

    def put(self, tokens: int, free: int, item: int, first: int) -> None:
        free = min(free, tokens)
        k = self.of.get((tokens, free))
        if k is None:
            k = self.of[tokens, free] = len(self.items)
            if k == len(self.tokens):
                self.tokens, self.free, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.free, self.count))
            self.tokens[k], self.free[k] = tokens, free
            self.items.append([])
        self.items[k].append((item, first))
        self.count[k] += 1

    def take(self, k: int) -> tuple[int, int]:
        self.count[k] -= 1
        return self.items[k].pop()


def fill(length: np.ndarray, prompt: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, first, size): the tokens from `first` of each item; prompt: an item's leading tokens without loss.

    A sequence takes, as long as one fits, the item whose demand has the largest dot product with what the sequence has
    left, each dimension in shares of its limit and weighted by the mean demand. A gap that no item fits is filled by the
    front of one, cut where a limit asks. What then isn't full is cut back to a power of two, which needs no padding."""
    if (length > limits.tokens).any() or (length - prompt > limits.loss).any() or (length < 1).any():
        raise ValueError("an item doesn't fit an empty sequence")
    pool, out = _Pool(length, prompt), []
    most = np.array([limits.tokens, limits.segments, limits.loss], float)
    n = max(len(length), 1)
    weight = np.array([length.sum() / n, 1.0, (length - prompt).sum() / n]) / most
    while pool.count.any():
        own: list[tuple[int, int, int, int]] = []  # item, first, size, its leading tokens without loss
        left = most.astype(np.int64)
        while left[0] and left[1]:
            loss = pool.tokens - pool.free
            there = pool.count > 0
            fits = there & (pool.tokens <= left[0]) & (loss <= left[2])
            if fits.any():
                share = weight * left / (most * most)
                k = int(np.argmax(np.where(fits, pool.tokens * share[0] + share[1] + loss * share[2], -1.0)))
                size = int(pool.tokens[k])
            else:
                part = np.where(there, np.minimum(left[0], pool.free + left[2]), 0)
                if not part.any():
                    break
                # the longest part; of the longest items, which stay long
                k = int(np.argmax(part * (limits.tokens + 1) + np.where(there, pool.tokens, 0)))
                size = int(part[k])
            item, first = pool.take(k)
            tokens, free = int(pool.tokens[k]), int(pool.free[k])
            if size < tokens:
                pool.put(tokens - size, max(free - size, 0), item, first + size)
            own.append((item, first, size, min(free, size)))
            left -= (size, 1, size - min(free, size))
        used = limits.tokens - int(left[0])
        if used < limits.tokens:
            over = used - (1 << (used.bit_length() - 1))
            while over:
                item, first, size, free = own.pop()
                back = min(size, over)
                pool.put(back, max(free - (size - back), 0), item, first + size - back)
                if back < size:
                    own.append((item, first, size - back, min(free, size - back)))
                over -= back
        out.append([x[:3] for x in own])
    return out


def _cuts(n: int, prompt: int, limits: Limits) -> list[int]:
    """Ends of the pieces of n tokens, each as long as the limits let it be."""
    out, at = [], 0
    while at < n:
        at = min(n, at + min(limits.tokens, max(prompt - at, 0) + limits.loss))
        out.append(at)
    return out


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, limits: Limits, batch_bytes: int, kept_units: int) -> DataFrame:
    """A row for each piece that the limits leave as long as can be; only pieces below `limits.tokens` carry their ids.

    item: the row's own number, fixed once the table is written."""
    import pyarrow as pa

    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("prompt", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    asked = "prompt" in docs.columns

    def run(it):
        number, enc = TaskContext.get().partitionId() << 40, encoder(tokenizer, kept_units)
        for batch in slices(it, batch_bytes):
            before = enc.encode(batch.column(1)) if asked else None
            before = (before[0].copy(), before[1]) if asked else None
            ids, ends = enc.encode(batch.column(batch.num_columns - 1))
            out = []
            for d, (doc, a, b) in enumerate(zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist())):
                head = before[0][before[1][d] : before[1][d + 1]] if asked else ids[:0]
                own = np.concatenate([head, ids[a:b], np.array([end_id], ids.dtype)])
                lo = 0
                for hi in _cuts(len(own), len(head), limits):
                    part = own[lo:hi]
                    out.append((number, doc, lo, hi - lo, min(max(len(head) - lo, 0), hi - lo), len(own), zlib.crc32(part.astype("<u4").tobytes()), part.tobytes() if hi - lo < limits.tokens else None))
                    number, lo = number + 1, hi
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    cols = [F.col("doc_id").cast("long"), *([F.col("prompt").cast("string")] if asked else []), F.col("text").cast("string")]
    return docs.select(*cols).mapInArrow(run, "item long, doc_id long, start long, length long, prompt long, doc_tokens long, ids_crc32 long, ids binary")


def vector_pack(docs: DataFrame, tokenizer: str, end_id: int = 0, limits: Limits = Limits(), shard_tokens: int = 1 << 20, batch_bytes: int = 12 << 20, kept_units: int = 1_200_000) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where every piece of every document lies.

    docs: doc_id, text, and prompt if wanted: a text whose ids come first and bear no loss; all later ids, end_id too, do.
    Other columns are not read. Pieces of limits.tokens ids are sequences of their own. All others are dealt by hash to
    shards of about `shard_tokens`, and each shard is packed for itself: no piece depends on another shard, and no shard
    is larger for a common document. Every sequence is full or a power of two long.

    Null and empty texts are the end id alone. Repeated rows and rows with a null doc_id are packed each for itself. An
    empty table gives an empty table."""
    import pyarrow as pa

    pieces = written(_encoded(docs, tokenizer, end_id, limits, batch_bytes, kept_units), "examples")
    short = F.col("ids").isNotNull()
    total = pieces.filter(short).agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    schema = pa.schema([(x.split()[0], pa.int64()) for x in _OUT.split(", ")])

    def run(key, rows):
        rows = rows.sort_by("item")
        length, prompt, doc, start, whole, crc = (rows.column(c).to_numpy() for c in ("length", "prompt", "doc_id", "start", "doc_tokens", "ids_crc32"))
        docs, ids = rows.column("doc_id").to_pylist(), rows.column("ids")
        out = []
        for k, own in enumerate(fill(length.astype(np.int64), prompt.astype(np.int64), limits)):
            offset = 0
            for item, first, size in own:
                sum32 = int(crc[item])
                if size < length[item]:
                    raw = ids[item].as_py()
                    held = np.frombuffer(raw, "<u2" if len(raw) == 2 * length[item] else "<u4")
                    sum32 = zlib.crc32(held[first : first + size].astype("<u4").tobytes())
                out.append((docs[item], int(start[item]) + first, size, sum32, int(whole[item]), -1 - ((key[0].as_py() << 24) | k), offset))
                offset += size
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    shard = F.pmod(F.xxhash64("item"), F.lit(shards)).alias("shard")
    dealt = pieces.filter(short).select(shard, "item", "doc_id", "start", "length", "prompt", "doc_tokens", "ids_crc32", "ids").repartition(-(-shards // 4), "shard")  # tasks grow with the input
    packed = dealt.groupBy("shard").applyInArrow(run, _OUT)
    full = pieces.filter(~short).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return vector_pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
