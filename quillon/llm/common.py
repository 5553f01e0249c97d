"""Helpers of the training-data operators: tables, shared scratch folders, word arrays."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; other columns, also those with odd names, are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in cols]) if cols else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of this machine stands in only where both are one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
            held = spark.sparkContext.getCheckpointDir()
        root = held
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before
        pass


def written(df: DataFrame, name: str, *parts: str, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    # small row groups: a writer holds one in memory
    df.write.option("compression", codec).option("parquet.block.size", 16 << 20).partitionBy(*parts).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df.scratch_path)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def unsigned_hex(col: Column) -> Column:
    """16 lower-case hex digits of a long's 64 bits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64's constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(n, _BASE), powers(n, _INV)


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls count as empty."""
    import pyarrow as pa

    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = col.fill_null("").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    ends = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


class Words:
    """Words of a batch of texts as arrays. table: 256 bytes, what each byte becomes, 0 where it parts words.

    start, end: byte places of every word; doc: first word of each text, and the end; data: the mapped bytes."""

    def __init__(self, col, table: np.ndarray):
        raw, ends = text_buffers(col)
        self.data = table[raw] if len(raw) else raw
        inside = np.zeros(len(raw) + 2, np.bool_)
        inside[1:-1] = self.data != 0
        begins = inside[1:] & ~inside[:-1]
        over = ~inside[1:] & inside[:-1]
        # a text's end parts words also
        cut = ends[1:-1]
        cut = cut[(cut > 0) & (cut < len(raw))]
        both = inside[cut] & inside[cut + 1]
        begins[cut[both]] = True
        over[cut[both]] = True
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(over)
        self.doc = np.searchsorted(self.start, ends)

    def hashes(self, first: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first so many bytes."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(self.start), np.uint64)
        step = 1 << 18  # in blocks, so that the 8-byte sums of long batches stay small
        lo = 0
        up, down = _tables(2 * step + 1)
        while lo < len(self.start):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + step, "right")))
            stop = self.end[hi - 1]
            if stop - base >= len(up):
                up, down = powers(stop - base + 1, _BASE), powers(stop - base + 1, _INV)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum((self.data[base:stop].astype(np.uint64) + np.uint64(1)) * up[: stop - base], out=sums[1:])
            s, e = self.start[lo:hi] - base, self.end[lo:hi] - base
            e = e if first is None else np.minimum(e, s + first)
            out[lo:hi] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
            lo = hi
        return out

    def bytes(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def rows(batch_or_lists, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v, f.type) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for v, f in zip(batch_or_lists, schema)], schema=schema)


def slices(it, chars: int = 2 << 20):
    """Cut Arrow batches so that each holds about so many bytes of text (its last column) or one row."""
    for batch in it:
        if not batch.num_rows:
            continue
        _, ends = text_buffers(batch.column(batch.num_columns - 1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + chars, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
