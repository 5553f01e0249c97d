"""Removal of boilerplate lines by the number of sites that carry them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, written

_EDGE = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """(key, site): the hash of each line that isn't blank, without white space at its ends, and its document's source."""
    line = F.explode(F.split(F.col("text").cast("string"), "\n", -1))
    found = docs.select(docs["source"].cast("string").alias("site"), line.alias("line")).select("site", F.trim("line", F.lit(_EDGE)).alias("line"))
    return found.where("line <> ''").select(F.xxhash64("line").alias("key"), "site")


def _one_site(docs: DataFrame) -> DataFrame:
    """(text, source) of each distinct text once, with the least of its sources."""
    text = docs["text"].cast("string")
    found = docs.select(F.md5(text).alias("digest"), text.alias("text"), docs["source"].cast("string").alias("source")).where("text is not null")
    sites = found.groupBy("digest").agg(F.min("source").alias("source"), F.count("*").alias("n"))
    copied = written(sites.where("n > 1").select("digest", "source"), "copied")
    once = found.join(copied, "digest", "left_anti").select("text", "source")
    several = found.join(copied.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]).select("digest", "text").join(copied, "digest")
    return once.unionByName(several.select("text", "source"))


def boilerplate_keys(docs: DataFrame, min_sites: int = 10, lg_k: int = 12) -> DataFrame:
    """Keys (XXH64, seed 42) of lines on at least min_sites distinct sources.

    A HyperLogLog sketch for each line hash counts its sites; sketches merge in the aggregation, before the shuffle too, so a
    line that is everywhere is one sketch from each task. Lines estimated clearly above the threshold are taken, lines
    within three standard errors (at least 1) of it get an exact distinct count. Null sources count as no site."""
    lines = _lines(docs)
    error = max(1.0, 3 * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    spread = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")).where(F.col("sites") >= min_sites - error)
    spread = written(spread, "spread")
    near = spread.where(F.col("sites") < min_sites + error).select("key")
    exact = lines.where("site is not null").join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("key")
    return spread.where(F.col("sites") >= min_sites + error).select("key").unionByName(exact)


#: What stands for the key of a blank line, and of one to remove.
_BLANK, _BAD = 0, 1


def mark_lines(docs: DataFrame, min_sites: int = 10, block_keys: int = 1_000_000, distinct_texts: bool = False) -> DataFrame:
    """(row, text, n_lines, n_removed): every row of docs as a struct, and its text without boilerplate lines.

    With distinct_texts, copies of a text count as one site, its least, so that copies alone make no line boilerplate.
    docs: doc_id, text, source and any others. Null texts stay null with 0 lines, empty ones empty, texts of boilerplate alone become empty;
    repeated rows are each judged alike. An empty table stays empty. Lines are cut and hashed, and texts put together, by Spark's
    expressions; the hashes are looked up by array. The keys are broadcast in blocks of block_keys (8 MB a million); more keys mean more
    passes over the documents."""
    import pyarrow as pa

    spark = docs.sparkSession
    sites = written(_one_site(docs), "texts") if distinct_texts else docs
    keys = written(boilerplate_keys(sites, min_sites), "boilerplate")
    if distinct_texts:
        release(sites)
    blocks = max(1, -(-keys.count() // block_keys))
    lines = lambda text: F.split(text, "\n", -1)
    bare = F.transform(lines(docs["text"].cast("string")), lambda x: F.trim(x, F.lit(_EDGE)))
    key = F.transform(bare, lambda x: F.when(x == "", F.lit(_BLANK)).otherwise(F.xxhash64(x)))
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), key.alias("keys"))
    for b in range(blocks):
        own = keys.where(F.pmod(F.col("key"), F.lit(blocks)) == b).toArrow().column(0).to_numpy()
        held = spark.sparkContext.broadcast(np.setdiff1d(own, [_BLANK, _BAD]))

        def run(it, held=held):
            for batch in it:
                lists = batch.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).copy()
                if len(held.value) and len(flat):
                    at = np.minimum(np.searchsorted(held.value, flat), len(held.value) - 1)
                    flat[held.value[at] == flat] = _BAD
                sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))
                ends = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["row", "keys"])

        out = out.mapInArrow(run, out.schema)
        out = out if b + 1 == blocks else written(out, "marks")
    text = F.col("row.text").cast("string")
    n = lambda which: F.size(F.filter("keys", which)).cast("long")
    removed = n(lambda k: k == _BAD)
    rest = F.array_join(F.filter(lines(text), lambda x, i: F.get("keys", i) != _BAD), "\n")
    return out.select("row", F.when(removed > 0, rest).otherwise(text).alias("text"), n(lambda k: k != _BLANK).alias("n_lines"), removed.alias("n_removed"))


def line_dedup(docs: DataFrame, min_sites: int = 10, distinct_texts: bool = False) -> DataFrame:
    """The documents, all their columns, with boilerplate lines cut from text. No document goes."""
    out = mark_lines(docs, min_sites, distinct_texts=distinct_texts)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mark_lines(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
bare AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) AS key FROM lines),
wide AS (SELECT key FROM bare WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 10),
marked AS (SELECT bare.*, wide.key IS NOT NULL AS bad FROM bare LEFT JOIN wide ON bare.key = wide.key),
kept AS (
  SELECT doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (bad) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT bad), '') AS text
  FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM kept
"""
