"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import passages
from .common import slices, table, unsigned_hex, written
from .components import components

_LOW = np.uint64(0x0101010101010101)


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text: words part at ASCII white space, A-Z are lower-cased, shingles count as often as they occur.

    Fewer words than a shingle: the whole sequence. No words, or null: 0."""
    import xxhash

    raw = (text or "").encode() if isinstance(text, (str, type(None))) else text
    words = raw.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(shingle, len(words))
    starts = [0, *ends[: len(words) - k]]
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.zeros(-(-n // 255) * 255, np.uint64)
    h[:n] = [digest(flat[a : b - 1], 42) for a, b in zip(starts, ends[k - 1 :])]
    out = 0
    h = h.reshape(-1, 255)
    for b in range(8):  # eight lanes of bytes are added at once; 255 ones fit a lane
        lanes = ((h >> np.uint64(b)) & _LOW).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * lanes > n).tolist():
            out |= 1 << (8 * lane + b)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): each document's SimHash as a signed long."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it):
        for batch in slices(it):
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def near_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (src, dst) of nodes whose fingerprints differ in at most `distance` bits. fps: distinct fp, node.

    Multi-index hashing over two 32-bit segments: by the pigeonhole rule, one segment of a linked pair differs in at most
    distance // 2 bits. So each fingerprint is filed under both segments, and looks up every value in the Hamming ball
    around its own; the join's condition verifies the whole distance. Only verified pairs leave the join.
    Fingerprints one bit apart are found before, by exact look-ups of 64 flips, and joined to groups; the second search
    leaves out pairs within a group, so that a dense cloud of fingerprints doesn't give all its pairs."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must be in 0..3")
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
    ones = fps.select(F.col("node").alias("src"), F.explode(flips).alias("fp")).join(fps.select("fp", F.col("node").alias("dst")), "fp").where("src > dst").select("src", "dst")
    if distance == 0:
        return fps.limit(0).select(F.col("node").alias("src"), F.col("node").alias("dst"))
    if distance == 1:
        return ones
    ones = written(ones, "ones")
    groups = components(ones)
    filed = fps.join(groups, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("grp"))
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))
    filed = written(filed.select("fp", "node", "grp", F.inline(halves)), "segments")
    ball = F.array("key", *[F.col("key").bitwiseXOR(F.lit(1 << b).cast("long")) for b in range(32)])
    probes = filed.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), F.col("grp").alias("grp2"), "seg", F.explode(ball).alias("key"))
    near = filed.join(probes, ["seg", "key"]).where((F.col("node") > F.col("node2")) & (F.col("grp") != F.col("grp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance))
    return near.select(F.col("node").alias("src"), F.col("node2").alias("dst")).unionByName(ones)


def simhash_groups(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the least doc_id reachable over links.

    docs: doc_id, text; other columns are not read. Null and empty texts have fingerprint 0 and link like any other.
    Repeated rows stay; rows with a null doc_id keep a row, link through their fingerprint only, and never name a
    component unless all its doc_ids are null. An empty table gives an empty table.
    Equal fingerprints are one node from the start, so copies never become pairs."""
    fps = written(fingerprints(docs, shingle), "simhash")
    one = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # nodes are fingerprints themselves, so that null ids can't clash
    nodes = one.select("fp", F.col("fp").alias("node"))
    joined = components(near_links(nodes, distance))
    known = one.join(joined, one.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    least = known.groupBy("group").agg(F.min("least").alias("component_id"))
    by_fp = known.join(least, "group").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """The documents that stay: of each group of near-duplicates the one with the least doc_id (of repeated rows of it, one).

    All columns stay as they are, also such as share a name with this operator's own. Rows with a null doc_id stay:
    they can't be told apart, and take no document's place. An empty table gives an empty table."""
    known = docs.where("doc_id is not null")
    kept = simhash_groups(known, distance, shingle).select(F.col("component_id").alias("doc_id")).distinct()
    return known.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def similar_dedup(docs: DataFrame, similarity: float = 0.8, n_bands: int = 16, n_rows: int = 5) -> DataFrame:
    """The documents that stay: of each group linked by a Jaccard likeness of `similarity` of five-word shingles, the one with
    the least doc_id (of repeated rows of it, one). Columns, null doc_ids and empty tables are treated as by near_dedup.

    Likeness of 0.8 may differ in a dozen bits of a fingerprint, more than segments can look up. So documents meet by MinHash
    bands too (of two of likeness 0.8, 99.8 % share one of 16 of 5 rows; of 0.9, all but one in a million, by computation), and as five-word fingerprints
    within 3 bits; exact likeness decides on either. Texts of equal words are one node from the start; texts of fewer
    words than a shingle are alike if they are equal, so those without words are."""
    shingle, what = passages.SHINGLE, ("documents",)
    known = docs.where("doc_id is not null")
    texts = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = written(passages.units(texts, what, shingle).select("doc_id", "key").distinct(), "whole")
    fps = written(fingerprints(texts, shingle).distinct().join(found, "doc_id", "left"), "simhash")
    first = written(fps.where("key is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "key")).getField("key").alias("head")), "heads")
    close = near_links(first.select("fp", F.col("fp").alias("node")))
    ends = lambda name, end: first.select(F.col("fp").alias(name), F.col("head").alias(end))
    pairs = close.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").select("a", "b")
    pairs = pairs.union(fps.where("key is not null").join(first, "fp").select("key", "head")).where("a <> b").distinct()
    pairs = written(pairs, "close")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    also = found.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    near, grams = passages.near_and_shingles(texts, what, shingle, similarity, n_bands, n_rows, also)
    pairs = pairs.join(near.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    both = pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("one")), "a").join(grams.select(F.col("key").alias("b"), F.col("grams").alias("other")), "b")
    links = near.unionByName(both.where(passages.alike(F.col("one"), F.col("other"), similarity)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    node = F.coalesce("key", F.xxhash64("fp", F.lit("short")))
    least = fps.select("doc_id", node.alias("node")).groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    joined = least.join(components(links), "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("doc_id").alias("doc_id"))
    return known.join(joined, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return groups.select("doc_id", unsigned_hex(F.col("fp")).alias("fingerprint"), "component_id")
