"""Token-id files: frequency-ranked ids, Stream-VByte coded, with control bytes apart from data bytes."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_path, partitions, scratch, slices, table
from .tokens import encoder

#: Bytes of the four values of a control byte.
LENGTHS = np.stack([((np.arange(256) >> (2 * i)) & 3) + 1 for i in range(4)], axis=1)

_BLOCK = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, {}"


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values: 1 to 4 little-endian bytes each, two control bits each."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for b in range(4):
        has = size > b
        if not has.any():
            break
        data[at[has] + b] = (v[has] >> np.uint32(8 * b)).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup of whole control bytes."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    out = raw[at].astype(np.uint32)
    for b in range(1, 4):
        has = size > b
        if has.any():
            out[has] |= raw[at[has] + b].astype(np.uint32) << np.uint32(8 * b)
    return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text and write `path`: blocks/part=N/ in ascending doc_id order (nulls first; equal ids by text), and ranks/.

    A block holds about 4 MB of text: doc_ids, lengths in ids (the end id counts), n, control, data. Spark's writers commit the files, so a
    lost executor's blocks are written again, and any store that Spark writes will do. Ids are kept once in the shared
    folder between the count of frequencies and the coding. Null and empty texts are the end id alone; repeated rows stay."""
    import pyarrow as pa

    spark = docs.sparkSession
    ids_path = scratch(spark, "ids")
    one = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def tokenised(it):
        part, block = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        for batch in slices(it, 4 << 20):
            ids, ends = enc.encode(batch.column(1))
            n = len(ends) - 1
            ids = np.insert(ids, ends[1:], end_id).astype("<u4" if ids.itemsize == 4 else "<u2")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([batch.column(0).to_pylist()], one.field(2).type), pa.array([(np.diff(ends) + 1).tolist()] if n else [[]], one.field(3).type), pa.array([ids.tobytes()], pa.binary())], schema=one)
            block += 1

    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(tokenised, _BLOCK.format("ids binary")).write.option("compression", "zstd").parquet(ids_path)
    blocks = spark.read.schema(_BLOCK.format("ids binary")).parquet(ids_path)

    def width(batch, k) -> str:
        return "<u2" if len(batch.column("ids")[k].as_py()) == 2 * sum(batch.column("lengths")[k].as_py()) else "<u4"

    def counted(it):
        total = np.zeros(0, np.int64)
        for batch in it:
            for k in range(batch.num_rows):
                more = np.bincount(np.frombuffer(batch.column("ids")[k].as_py(), width(batch, k)))
                if len(more) > len(total):
                    total, more = more, total
                total[: len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # one row for each id of the vocabulary
    ranks = blocks.mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranks.sort(key=lambda r: (-r.n, r.id))
    of = np.zeros(max([r.id for r in ranks], default=0) + 1, np.uint32)
    of[[r.id for r in ranks]] = np.arange(len(ranks))
    spark.createDataFrame([(i, r.id, r.n) for i, r in enumerate(ranks)], "rank long, id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    held = spark.sparkContext.broadcast(of)

    def coded(it):
        for batch in it:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[k].as_py(), width(batch, k))
                control, data = encode(held.value[ids])
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:4]), pa.array([len(ids)]), pa.array([control]), pa.array([data])], names=[*batch.schema.names[:4], "n", "control", "data"])

    blocks.mapInArrow(coded, _BLOCK.format("n long, control binary, data binary")).sortWithinPartitions("part", "block").write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    drop_path(spark, ids_path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, from the files: start counts all ids before it."""
    import pyarrow as pa

    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()
    of = np.zeros(len(ranks), np.uint32)
    of[[r[0] for r in ranks]] = [r[1] for r in ranks]
    held = spark.sparkContext.broadcast(of)

    def decoded(it):
        for batch in it:
            for k in range(batch.num_rows):
                part, block, docs, lengths, n, control, data = (c[k].as_py() for c in batch.columns)
                ids = held.value[decode(control, data, n)].astype("<u4")
                upto = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
                cols = [pa.array([part] * len(docs), pa.int32()), pa.array([block] * len(docs), pa.int32()), pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(upto, upto[1:])], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "place", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    blocks = spark.read.schema(_BLOCK.format("n long, control binary, data binary")).parquet(f"{path}/blocks").select("part", "block", "doc_ids", "lengths", "n", "control", "data")
    docs = blocks.mapInArrow(decoded, "part int, block int, place int, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * with_ids)
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each part
    sizes = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    base = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = docs.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(base), "part")
    return out.select("doc_id", (F.col("within") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)
