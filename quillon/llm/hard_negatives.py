"""Hard negatives by an exact distributed nearest-neighbour join over Voronoi cells of norm-augmented vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

_BLOCK = "cell int, ring int, block long, n long, ids binary, labels binary, vectors binary"
_GROUP = "grp long, ids binary, labels binary, vectors binary, lo binary, hi binary, served array<int>"
_FOUND = "anchor_id long, slot int, other_id long, score long"
#: Scores up to here are whole numbers in a double.
_EXACT = 2.0**53


@dataclass
class Space:
    """What the table fixes for all tasks. A vector x becomes (x, sqrt(top - |x|^2)), an anchor a becomes (a, 0): then
    |a' - x'|^2 = |a|^2 + top - 2 a.x, so the largest products are the least distances, and triangle inequalities hold."""

    dims: int
    top: float  # no squared norm is larger
    pivots: np.ndarray  # augmented, a row each
    ids: np.ndarray  # of the sample
    labels: np.ndarray
    sample: np.ndarray
    edges: np.ndarray  # distances to the pivot that part a cell into rings

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))[:, None]])

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of augmented vectors, a row each, to every pivot."""
        square = (x * x).sum(1)[:, None] + (self.pivots * self.pivots).sum(1) - 2.0 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0.0))

    @property
    def slack(self) -> float:
        """More than rounding can move a distance."""
        return 1e-5 * float(np.sqrt(self.top)) + 1e-9


def _matrix(col, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as whole numbers; missing components at the end are zero."""
    ends = np.asarray(col.offsets)
    values, size = np.asarray(col.values)[ends[0] : ends[-1]], np.diff(ends)
    if (size == dims).all():
        return values.reshape(len(size), dims).astype(np.int64)
    out = np.zeros((len(size), dims), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], size)] = values
    return out


def _narrow(v: np.ndarray, top: float) -> np.ndarray:
    return v.astype("<i2" if top < 2.0**30 else "<i8")


def _wide(raw: bytes, n: int, dims: int, top: float) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if top < 2.0**30 else "<i8").reshape(n, dims).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray, top: float) -> np.ndarray:
    """Inner products of whole-number rows, exact: by doubles where they hold every partial sum, else by longs."""
    if top < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(score: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores among `ok`; of equal scores the first columns."""
    if score.shape[1] > k:
        v = np.where(ok, score, np.iinfo(np.int64).min)
        least = np.partition(v, score.shape[1] - k, axis=1)[:, -k][:, None]
        more = ok & (v > least)
        same = ok & (v == least)
        ok = more | (same & (np.cumsum(same, axis=1) <= k - more.sum(1, keepdims=True)))
    return np.nonzero(ok)


def _wanted(score, labels, ids, a_labels, a_ids, lo, hi, same: bool) -> np.ndarray:
    alike = a_labels[:, None] == labels[None, :]
    return (alike if same else ~alike) & (a_ids[:, None] != ids[None, :]) & (score >= lo[:, None]) & (score <= hi[:, None])


def _space(rows: DataFrame, pivots: int, rings: int, sample: int) -> Space | None:
    """Norms of all rows; pivots and seeds from a bounded sample by a hash of vec_id. None without rows."""
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top, dims = rows.agg(F.count("*"), F.max(norm), F.max(F.size("vector"))).first()
    if not n:
        return None
    top = top * (1 + 1e-9)
    if top >= 2.0**62:
        raise ValueError("scores of these vectors don't fit a long")
    hashed = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 40))
    some = rows.filter(hashed < int(min(1.0, 1.5 * sample / n) * (1 << 40))).dropDuplicates(["vec_id"]).limit(2 * sample).collect()
    some = some or rows.limit(1).collect()
    some.sort(key=lambda r: r.vec_id)
    x = np.zeros((len(some), dims), np.int64)
    for i, r in enumerate(some):
        x[i, : len(r.vector)] = r.vector
    space = Space(dims, top, np.zeros((0, dims + 1)), np.array([r.vec_id for r in some]), np.array([r.label for r in some]), x, np.zeros(0))
    whole = space.augmented(x.astype(np.float64))
    space.pivots = np.unique(whole, axis=0)
    space.pivots = space.pivots[np.random.default_rng(11).permutation(len(space.pivots))[:pivots]]
    near = space.to_pivots(whole).min(1)
    space.edges = np.quantile(near, np.arange(1, rings) / rings)
    return space


def _assigned(rows: DataFrame, held) -> DataFrame:
    """Every row with its cell (the nearest pivot), ring and distance; rows that repeat within a batch go."""
    import pyarrow as pa

    def run(it):
        s: Space = held.value
        for batch in it:
            if not batch.num_rows:
                continue
            ids, labels, anchor = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            x = _matrix(batch.column(3), s.dims)
            _, first = np.unique(np.column_stack([ids, labels, x]), axis=0, return_index=True)
            ids, labels, anchor, x = ids[first], labels[first], anchor[first], x[first]
            far = s.to_pivots(s.augmented(x.astype(np.float64)))
            cell = far.argmin(1)
            dist = far[np.arange(len(x)), cell]
            flat = _narrow(x, s.top)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(anchor), pa.array(cell.astype(np.int32)), pa.array(np.searchsorted(s.edges, dist).astype(np.int32)), pa.array(dist), pa.array([v.tobytes() for v in flat], pa.binary())], names=["vec_id", "label", "anchor", "cell", "ring", "dist", "vec"])

    return rows.select("vec_id", "label", "anchor", "vector").mapInArrow(run, "vec_id long, label long, anchor boolean, cell int, ring int, dist double, vec binary")


def _blocks(assigned: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidates by cell and ring in blocks of a bounded size, packed; exact repeats of a row count once."""
    import pyarrow as pa

    def run(key, rows):
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        vec = rows.column("vec").to_pylist()
        keep = sorted({(i, y, v): k for k, (i, y, v) in enumerate(zip(ids.tolist(), labels.tolist(), vec))}.values())
        out = [[key[0]], [key[1]], [key[2]], [len(keep)], [ids[keep].astype("<i8").tobytes()], [labels[keep].astype("<i8").tobytes()], [b"".join(vec[k] for k in keep)]]
        return pa.table(out, schema=pa.schema([("cell", pa.int32()), ("ring", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]))

    # a row for each ring of each cell, so the broadcast side is bounded by the two parameters
    numbered = assigned.join(F.broadcast(cells.select("cell", "ring", "blocks")), ["cell", "ring"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    return numbered.select("cell", "ring", "block", "vec_id", "label", "vec").groupBy("cell", "ring", "block").applyInArrow(run, _BLOCK)


def _served(s: Space, cells: np.ndarray, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of the rings (cell, ring, least and largest distance to the pivot), those that may hold what an anchor asks for."""
    a = np.hstack([x, np.zeros((len(x), 1))])
    far = s.to_pivots(a)
    own = far.argmin(1)
    cell, least, most = cells[:, 0].astype(np.int64), cells[:, 2], cells[:, 3]
    to_own = s.to_pivots(s.pivots)[own]  # between each anchor's pivot and all
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(to_own > 0, (far * far - (far.min(1) ** 2)[:, None]) / (2 * to_own), 0.0)
    d = far[:, cell]
    near = np.maximum.reduce([d - most, least - d, plane[:, cell], np.zeros_like(d)])
    near = np.maximum(near - s.slack, 0.0)
    last = d + most + s.slack
    both = ((x * x).sum(1) + s.top)[:, None]
    asks = lo <= hi
    need = np.where(asks, lo, np.iinfo(np.int64).max).min(1)[:, None]
    upto = np.where(asks, hi, np.iinfo(np.int64).min).max(1)[:, None]
    ok = asks.any(1)[:, None] & ((both - near * near) / 2 + 1 >= need) & ((both - last * last) / 2 - 1 <= upto)
    return np.flatnonzero(ok.any(0))


def _groups(anchors: DataFrame, cells: np.ndarray, held, same: bool, k: int, per_group: int) -> DataFrame:
    """Anchors (vec_id, label, cell, vec, lo, hi) packed by neighbouring cells, with the rings that may serve each group.

    lo and hi: scores wanted, one slot each. The k-th best of the sample in a slot raises its lo: what is less can't be
    among the first k."""
    import pyarrow as pa

    s: Space = held.value
    count = dict(anchors.groupBy("cell").count().collect())  # a row for each pivot
    chain, rest = [], set(range(len(s.pivots)))
    between = s.to_pivots(s.pivots)
    while rest:
        chain.append(min(rest, key=lambda j: between[chain[-1], j]) if chain else 0)
        rest.remove(chain[-1])
    plan, group, inside = [], 0, 0
    for j in chain:
        n = count.get(j, 0)
        if n > per_group:  # a hot cell is several groups
            group, inside = group + (1 if inside else 0), 0
            parts = -(-n // per_group)
            plan.append((j, group, parts))
            group += parts
        else:
            if inside + n > per_group:
                group, inside = group + 1, 0
            plan.append((j, group, 1))
            inside += n
    spark = anchors.sparkSession
    numbers = spark.createDataFrame(plan, "cell int, base long, parts long")  # a row for each pivot
    dealt = anchors.join(F.broadcast(numbers), "cell").withColumn("grp", F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def run(key, rows):
        s: Space = held.value
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        x = _wide(b"".join(rows.column("vec").to_pylist()), len(ids), s.dims, s.top)
        lo, hi = (np.array(rows.column(c).to_pylist(), np.int64).reshape(len(ids), -1) for c in ("lo", "hi"))
        score = products(x, s.sample, s.top)
        for slot in range(lo.shape[1]):
            ok = _wanted(score, s.labels, s.ids, labels, ids, lo[:, slot], hi[:, slot], same)
            r, c = best(score, ok, k)
            full = np.bincount(r, minlength=len(ids)) == k
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, r, score[r, c])
            lo[full, slot] = low[full]
        at = _served(s, cells, x.astype(np.float64), lo, hi)
        out = [[key[0].as_py()], *([v.astype("<i8").tobytes()] for v in (ids, labels, x, lo, hi)), [at.tolist()]]
        return pa.table(out, schema=pa.schema([("grp", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "lo", "hi")), ("served", pa.list_(pa.int32()))]))

    return dealt.select("grp", "vec_id", "label", "vec", "lo", "hi").groupBy("grp").applyInArrow(run, _GROUP)


def _joined(groups: DataFrame, blocks: DataFrame, cells: DataFrame, held, same: bool, k: int, shards: int) -> DataFrame:
    """(anchor_id, slot, other_id, score): the first k of every slot. Candidate blocks are replicated to the groups that
    they may serve, dealt to `shards` tasks a group, joined there exactly, and the tasks' firsts are ranked."""
    import pyarrow as pa

    pairs = groups.select("grp", F.explode("served").alias("place")).join(F.broadcast(cells.select("place", "cell", "ring", "blocks")), "place")
    pairs = pairs.select("grp", "cell", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    shard = F.pmod(F.xxhash64("cell", "ring", "block"), F.lit(shards))
    sent = pairs.join(blocks, ["cell", "ring", "block"]).select(F.col("grp").alias("c_grp"), shard.alias("c_shard"), "n", F.col("ids").alias("c_ids"), F.col("labels").alias("c_labels"), F.col("vectors").alias("c_vectors"))
    anchors = groups.select(F.col("grp").alias("a_grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), "ids", "labels", "vectors", "lo", "hi")
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])

    def run(left, right):
        s: Space = held.value
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        raw = {c: left.column(c)[0].as_py() for c in ("ids", "labels", "vectors", "lo", "hi")}
        a_ids, a_labels = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["labels"], "<i8")
        a = np.frombuffer(raw["vectors"], "<i8").reshape(len(a_ids), s.dims)
        lo, hi = (np.frombuffer(raw[c], "<i8").reshape(len(a_ids), -1) for c in ("lo", "hi"))
        ids, labels = (np.frombuffer(b"".join(right.column(c).to_pylist()), "<i8") for c in ("c_ids", "c_labels"))
        x = _wide(b"".join(right.column("c_vectors").to_pylist()), len(ids), s.dims, s.top)
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        step = max(256, (1 << 20) // len(a_ids))  # so that a block of scores stays small
        out = []
        for at in range(0, len(ids), step):
            score = products(a, x[at : at + step], s.top)
            for slot in range(lo.shape[1]):
                ok = _wanted(score, labels[at : at + step], ids[at : at + step], a_labels, a_ids, lo[:, slot], hi[:, slot], same)
                if ok.any():
                    r, c = best(score, ok, k)
                    out.append((a_ids[r], np.full(len(r), slot, np.int32), ids[at + c], score[r, c]))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    found = anchors.groupBy("a_grp", "shard").cogroup(sent.groupBy("c_grp", "c_shard")).applyInArrow(run, _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    pivots: int = 64, rings: int = 4, sample: int = 4096, block_rows: int = 2048, task_rows: int = 1 << 15,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors: vec_id, label (whole numbers) and vector (array of whole numbers); anchor: a condition on them. An anchor's
    positives are the `positives` other rows of its label with the largest inner products, ties by smaller vec_id; for
    each, its negatives are the first `negatives` rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score.

    Both searches are exact: every row is in the cell of its nearest pivot, cells are parted into rings by the distance
    to it, and a ring goes to those groups of anchors only for which triangle inequality and cell border leave it possible
    that it holds a row asked for. Pivots and first bounds come from a bounded sample; the sample decides no result.
    Groups of anchors and blocks of candidates are bounded, so that neither a hot cell nor copies of one vector make a
    task larger; what is broadcast is bounded by the parameters. In many dimensions the bounds leave most rings possible:
    then the join compares every anchor with every row, in blocks.

    Rows with a null vec_id, label, vector or component take no part. Vectors of unequal length are filled up with zeros.
    Rows that repeat exactly count once; of several rows of an anchor's vec_id the one with the least label and vector is
    the anchor, none is its own positive. Other columns are not read. An empty table gives an empty table."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("vector").cast("array<long>"))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL)")
    space = _space(rows, pivots, rings, sample)
    if space is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = spark.sparkContext.broadcast(space)
    assigned = written(_assigned(rows, held), "assigned")
    # pivots * rings rows at most
    found = assigned.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    bounds = np.array([(r.cell, r.ring, r.lo, r.hi) for r in found], float).reshape(-1, 4)
    total, size = sum(r.n for r in found), max(64, min(block_rows, -(-sum(r.n for r in found) // (4 * partitions(spark)))))
    cells = spark.createDataFrame([(i, r.cell, r.ring, max(1, -(-r.n // size))) for i, r in enumerate(found)], "place int, cell int, ring int, blocks long")
    blocks = written(_blocks(assigned, cells), "blocks")
    one = assigned.filter("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vec", "cell")).alias("row")).select("vec_id", "row.label", "row.vec", "row.cell")
    anchors = written(one, "anchors")
    per_group = max(64, min(4096, anchors.count() // (2 * partitions(spark))))
    shards = max(1, -(-total // max(4096, min(task_rows, total // 4))))

    long = np.iinfo(np.int64)
    first = anchors.withColumn("lo", F.array(F.lit(int(long.min) + 1))).withColumn("hi", F.array(F.lit(int(long.max))))
    groups = written(_groups(first, bounds, held, True, positives, per_group), "groups")
    near = written(_joined(groups, blocks, cells, held, True, positives, shards).select("anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    at = F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.element_at("scores", i))
    wide = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "positive_score"))).alias("scores"))  # `positives` entries at most
    # whole-number division that rounds up and down; a slot without a positive asks for nothing
    lo = F.transform(at, lambda p: F.coalesce(-F.floor(-p * low / F.lit(100).cast("decimal(3,0)")), F.lit(1)).cast("long"))
    hi = F.transform(at, lambda p: F.coalesce(F.floor(p * high / F.lit(100).cast("decimal(3,0)")), F.lit(0)).cast("long"))
    second = anchors.join(wide.withColumnRenamed("anchor_id", "vec_id"), "vec_id").withColumn("lo", lo).withColumn("hi", hi)
    groups = written(_groups(second, bounds, held, False, negatives, per_group), "groups")
    far = _joined(groups, blocks, cells, held, False, negatives, shards).select("anchor_id", (F.col("slot") + 1).alias("slot"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").filter("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return hard_negatives(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
           FROM x AS a JOIN x AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
