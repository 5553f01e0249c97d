"""Best-two-fit packing of token sequences."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import encoder


@dataclass
class Bin:
    """A way to fill a sequence: lengths (descending) with their numbers, and how many sequences are filled so."""

    lengths: list[tuple[int, int]]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Bin]:
    """Bins for so many pieces of each length, at most `capacity`, found on the histogram of lengths.

    A bin is filled greedily with the longest pieces that fit. Then its smallest piece is replaced by the two unpacked
    pieces that fill the gap left without it most tightly, if they fill more than it did; this goes on while it gains.
    A bin's pattern is repeated as long as the histogram has its pieces, so the work depends on the number of
    lengths, not of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of {n} tokens doesn't fit {capacity}")
        left[n] = c
    axis = np.arange(capacity + 1)
    bins: list[Bin] = []
    while left.any():
        pool, used, gap = left.copy(), {}, capacity
        while gap:
            below = np.flatnonzero(pool[: gap + 1])
            if not len(below):
                break
            n = int(below[-1])
            take = int(min(pool[n], gap // n))
            pool[n] -= take
            used[n] = used.get(n, 0) + take
            gap -= take * n
        while gap:
            low = min(used)
            room = gap + low
            # largest unpacked length up to x, and up to x - 1 where a length has one piece only
            upto = np.maximum.accumulate(np.where(pool > 0, axis, 0))
            a = np.flatnonzero(pool[:room])
            if not len(a):
                break
            b = upto[np.minimum(room - a, a)]
            lone = (b == a) & (pool[a] < 2)
            b = np.where(lone, upto[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            best = int(np.argmax(both))
            if both[best] <= low:
                break
            for n in (int(a[best]), int(b[best])):
                pool[n] -= 1
                used[n] = used.get(n, 0) + 1
            pool[low] += 1
            used[low] -= 1
            if not used[low]:
                del used[low]
            gap = room - int(both[best])
        times = int(min(left[n] // c for n, c in used.items()))
        for n, c in used.items():
            left[n] -= c * times
        bins.append(Bin(sorted(used.items(), reverse=True), times))
    return bins


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, batch_bytes: int = 4 << 20, kept_units: int = 1_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with end_id after them, cut at `capacity`."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it):
        for batch in slices(it, batch_bytes):  # the larger, the fewer words are looked up twice
            ids, ends = encoder(tokenizer, kept_units).encode(batch.column(1))
            out = []
            for d, (doc, a, b) in enumerate(zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist())):
                own = np.append(ids[a:b].astype("<u4"), np.uint32(end_id)).astype("<u4")
                for p, lo in enumerate(range(0, len(own), capacity)):
                    part = own[lo : lo + capacity]
                    out.append((doc, p, lo, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, capacity: int, per_group: int = 20_000) -> DataFrame:
    """pieces (a written table with doc_id, piece, length) with sequence_id and offset added.

    The histogram of lengths, at most `capacity` rows, is packed on the driver; a piece finds its place by its rank among
    the pieces of its length. Ranks are counted in groups of about per_group rows by a salt, so that a common length is
    no task of its own."""
    import pyarrow as pa

    spark = pieces.sparkSession
    salts = max(16, -(-pieces.count() // per_group))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    slots, base = [], 0
    taken: dict[int, int] = {}
    for b in best_two_fit(counts, capacity):
        offset = 0
        for n, c in b.lengths:
            lo = taken.get(n, 0)
            taken[n] = lo + c * b.times
            slots.append((n, lo, base, offset, c))
            offset += n * c
        base += b.times
    slots.sort()
    held = spark.sparkContext.broadcast(np.array(slots, np.int64).reshape(-1, 5))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_rank", rank).join(before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before")), ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_before")).cast("long").alias("_rank"))
    at = pieces.columns.index("length")
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(it):
        n, lo, base, offset, c = held.value.T
        key = (n << np.int64(44)) | lo
        for batch in it:
            if batch.num_rows:
                length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                r = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                s = np.searchsorted(key, (length << np.int64(44)) | r, "right") - 1
                j = r - lo[s]
                cols = [*batch.columns[:-1], pa.array(base[s] + j // c[s]), pa.array(offset[s] + (j % c[s]) * length)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, batch_bytes: int = 4 << 20, kept_units: int = 1_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where every piece of every document lies.

    docs: doc_id, text; other columns are not read. Null and empty texts are a piece of the end id alone; documents longer
    than `capacity` are cut into full pieces and a last one. Repeated rows are packed each for itself, rows with a null
    doc_id too. An empty table gives an empty table."""
    return place(written(token_pieces(docs, tokenizer, end_id, capacity, batch_bytes, kept_units), "pieces"), capacity)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), batch_bytes=12 << 20, kept_units=1_200_000)
