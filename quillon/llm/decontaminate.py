"""Benchmark decontamination by winnowed word fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mixed, slices, table, written

#: Words are runs of digits, letters and bytes of non-ASCII characters; A-Z are lower-cased.
_BYTES = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _BYTES[_b] = _b
for _b in range(0x41, 0x5B):
    _BYTES[_b] = _b + 32


def _grams(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    acc = np.zeros(len(at), np.uint64)
    for t in range(n):
        acc = acc * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + t]
    return mixed(acc)


def winnowed(words: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints of concatenated texts.

    In each run of window - k + 1 k-grams (one run for each window of words) the least hash is kept, the last of equal
    ones. Equal windows keep the same gram, so each shared span of `window` words shares a fingerprint."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _grams(words, np.arange(len(words) - k + 1), k)
    n = len(words) - window + 1
    best, place = grams[:n].copy(), np.zeros(n, np.int64)
    for t in range(1, window - k + 1):
        less = grams[t : t + n] <= best
        best[less] = grams[t : t + n][less]
        place[less] = t
    owner = np.repeat(np.arange(len(doc) - 1), np.diff(doc))
    whole = owner[:n] == owner[window - 1 :]
    at = np.unique((np.arange(n) + place)[whole])
    return at, grams[at]


@dataclass
class Index:
    """Windows of benchmark items: sorted hashes by length in words, where their words are, and which items hold them."""

    fingerprints: np.ndarray  # of windows of full length
    short: list[int]  # lengths of items below a window
    hashes: dict[int, np.ndarray]  # length -> sorted window hashes
    first: dict[int, list[bytes]]  # length -> the words of each
    owners: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> offsets, item numbers
    items: np.ndarray


def build_index(ids: list[int], texts: list[str], window: int, k: int) -> Index:
    import pyarrow as pa

    w = Words(pa.array(texts, pa.string()), _BYTES)
    words = w.hashes()
    sizes = np.diff(w.doc)
    _, fps = winnowed(words, w.doc, window, k)
    by: dict[int, tuple[list, list]] = {}
    for i, n in enumerate(sizes.tolist()):
        if n:
            length = min(n, window)
            starts, owner = by.setdefault(length, ([], []))
            starts.append(np.arange(w.doc[i], w.doc[i + 1] - length + 1))
            owner.append(np.full(n - length + 1, i))
    hashes, first, owners = {}, {}, {}
    for length, (starts, owner) in by.items():
        at, own = np.concatenate(starts), np.concatenate(owner)
        u, one, back = np.unique(_grams(words, at, length), return_index=True, return_inverse=True)
        hashes[length] = u
        first[length] = [b" ".join(w.bytes(j) for j in range(at[x], at[x] + length)) for x in one]
        pairs = np.unique(np.stack([back, own], axis=1), axis=0)
        owners[length] = (np.searchsorted(pairs[:, 0], np.arange(len(u) + 1)), pairs[:, 1])
    return Index(np.unique(fps), sorted(n for n in by if n < window), hashes, first, owners, np.array(ids, np.int64))


def search(col, index: Index, window: int, k: int) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """Of each text of an Arrow column: words, hit spans (first, end, first, end, ...), numbers of items found."""
    w = Words(col, _BYTES)
    words = w.hashes()
    owner = np.repeat(np.arange(len(col)), np.diff(w.doc))
    spans: list[list[int]] = [[] for _ in range(len(col))]
    items: list[set[int]] = [set() for _ in range(len(col))]

    def extend(at: np.ndarray, length: int) -> None:
        at = at[(at >= 0) & (at + length <= len(words))]
        at = at[owner[at] == owner[at + length - 1]] if len(at) else at
        if not len(at):
            return
        h = _grams(words, at, length)
        found = np.searchsorted(index.hashes[length], h)
        found[found == len(index.hashes[length])] = 0
        same = index.hashes[length][found] == h
        offsets, own = index.owners[length]
        for a, f in zip(at[same].tolist(), found[same].tolist()):
            if index.first[length][f] == b" ".join(w.bytes(j) for j in range(a, a + length)):
                d = int(owner[a])
                base = int(w.doc[d])
                if spans[d] and spans[d][-2] <= a - base <= spans[d][-1]:
                    spans[d][-1] = max(spans[d][-1], a - base + length)
                else:
                    spans[d] += [a - base, a - base + length]
                items[d].update(own[offsets[f] : offsets[f + 1]].tolist())

    if window in index.hashes:
        at, fps = winnowed(words, w.doc, window, k)
        seeds = at[np.isin(fps, index.fingerprints, kind="sort")]
        extend(np.unique((seeds[:, None] - np.arange(window - k + 1)).ravel()), window)
    for length in index.short:  # an item below a window is one fingerprint of its own length
        every = np.arange(max(0, len(words) - length + 1))
        lone = every[owner[every] == owner[every + length - 1]] if len(every) else every
        h = _grams(words, lone, length)
        extend(lone[np.isin(h, index.hashes[length], kind="sort")], length)
    return np.diff(w.doc), spans, [index.items[sorted(s)].tolist() for s in items]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 6, block_words: int = 1_000_000) -> DataFrame:
    """(row, hit) of every row of docs: row is a struct of all its columns, hit has n_words, n_hit (words inside a benchmark
    window), item_ids (of the items found) and spans (first and end word of each hit span).

    docs: doc_id, text and any others; benchmark: item_id, text. Null texts have no words; items without words or with a
    null item_id are left out; repeated items count once, repeated documents each for itself; rows with a null doc_id are
    judged like any other. Empty tables on either side give no hits.
    The benchmark's fingerprints are joined as a broadcast index of about block_words words of items at most (a longer
    single item counts alone); a larger benchmark goes over the documents in blocks of that size, each a pass of its own,
    so what is broadcast is bounded and nothing is cut."""
    import pyarrow as pa

    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    total = items.agg(F.sum(n_words.cast("long"))).first()[0] or 0
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    ints = pa.list_(pa.int64())
    out = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<bigint>").alias("found"), docs["text"].cast("string").alias("text"))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()
        index = spark.sparkContext.broadcast(build_index([r[0] for r in own], [r[1] for r in own], window, k))
        last = b + 1 == blocks

        def run(it, index=index, last=last):
            for batch in slices(it):
                n, spans, found = search(batch.column(3), index.value, window, k)
                if blocks > 1:
                    spans = [x + y for x, y in zip(batch.column(1).to_pylist(), spans)]
                    found = [x + y for x, y in zip(batch.column(2).to_pylist(), found)]
                tail = [("n_words", pa.array(n))] if last else [("text", batch.column(3))]
                cols = [("row", batch.column(0)), ("spans", pa.array(spans, ints)), ("found", pa.array(found, ints)), *tail]
                yield pa.RecordBatch.from_arrays([c for _, c in cols], names=[x for x, _ in cols])

        schema = T.StructType([*out.schema.fields[:3], T.StructField("n_words", T.LongType()) if last else out.schema.fields[3]])
        out = out.mapInArrow(run, schema)
        out = out if last else written(out, "contamination")
    # spans of one pass are in order and apart; those of several passes are merged here
    pairs = F.array_sort(F.transform(F.sequence(F.lit(1), F.floor(F.size("spans") / 2).cast("int")), lambda i: F.struct(F.element_at("spans", 2 * i - 1).alias("a"), F.element_at("spans", 2 * i).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto"))
    hit = F.aggregate(pairs, start, lambda s, p: F.struct((s.n + F.greatest(F.lit(0).cast("long"), p.b - F.greatest(p.a, s.upto))).alias("n"), F.greatest(s.upto, p.b).alias("upto")), lambda s: s.n)
    return out.select("row", F.struct("n_words", F.when(F.size("spans") > 0, hit).otherwise(F.lit(0)).cast("long").alias("n_hit"), F.array_distinct("found").alias("item_ids"), "spans").alias("hit"))


def contaminated(n_hit, n_words):
    """The rule of contamination: at least a twentieth of the words lie in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, k: int = 6) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; null and empty texts stay, repeated rows too."""
    clean = contamination(docs, benchmark, window, k).where(~contaminated(F.col("hit.n_hit"), F.col("hit.n_words")))
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    ids = F.array_sort(F.transform("hit.item_ids", lambda x: x.cast("string")))
    return found.select(
        "row.doc_id", "hit.n_words", "hit.n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated(F.col("hit.n_hit"), F.col("hit.n_words")).alias("contaminated"),
    )
