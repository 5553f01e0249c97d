"""Hard negatives, vector packing and the divergence audit against brute force, on small tables with odd rows."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import divergence, hard_negatives, registry, vector_packing
from quillon.llm.vector_packing import Limits, fill

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def run(spark, sf, n):
    name = next(x for x in registry.queries() if x.startswith(f"op{n}_"))
    return registry.queries()[name](spark, sf)


# hard negatives


@pytest.fixture(scope="module")
def embeddings(spark, tmp_path_factory):
    """Clusters, a third of all rows with one vector, ties, zero vectors, and every kind of row that takes no part."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 6))
    rows = []
    for i in range(420):
        v = centres[i % 6] + rng.normal(size=6) * 0.4 if i % 3 else centres[0]
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 4))))
    rows[50] = (50, [0.0] * 6, 1)
    rows[100] = (100, rows[99][1], rows[99][2])
    rows[150] = (150, None, 2)
    rows[200] = (200, rows[199][1], None)
    rows[201] = (201, [float("nan")] + [0.1] * 5, 1)
    rows[202] = (202, [float("inf")] + [0.1] * 5, 1)
    rows[203] = (203, [None] + [0.1] * 5, 1)
    rows += [rows[7], rows[7], rows[250], (None, rows[8][1], 1), (1000, [0.2] * 6, 9)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).repartition(5).write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def brute_negatives(rows):
    own = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own[i] = ([math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y)
    out = set()
    for a, (va, ya) in own.items():
        if a % 50:
            continue
        ranked = sorted((-sum(p * q for p, q in zip(va, v)), i, y) for i, (v, y) in own.items() if i != a)
        for ps, p, _ in [x for x in ranked if x[2] == ya][:5]:
            found = [(-s, i) for s, i, y in ranked if y != ya and 50 * -ps <= 100 * -s <= 95 * -ps][:3]
            out |= {(a, p, k, i, -ps, s) for k, (s, i) in enumerate(found, 1)}
    return out


def test_op11(spark, embeddings):
    got = run(spark, embeddings[0], 11).collect()
    assert {tuple(r) for r in got} == brute_negatives(embeddings[1]) and len(got) == len({tuple(r) for r in got})


@pytest.mark.parametrize("sizes", [{"pivots": 1, "rings": 1, "block_rows": 64}, {"pivots": 300, "rings": 9, "sample": 40, "task_rows": 64}])
def test_hard_negatives_at_other_sizes(spark, embeddings, sizes):
    """Pivots, rings, sample, blocks and tasks decide no result."""
    rows = [(i, v, y) for i, v, y in embeddings[1] if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    df = spark.createDataFrame([(i, [math.floor(256 * float(np.float32(x))) for x in v], (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows], "vec_id long, vector array<long>, label long")
    got = hard_negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **sizes).collect()
    assert {tuple(r) for r in got} == brute_negatives(embeddings[1])


def test_hard_negatives_odd(spark):
    cols = "vec_id long, vector array<long>, label long"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], cols), F.col("vec_id") % 50 == 0).collect() == []
    # no anchors; one row; vectors of unequal length and without components
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1], 1), (2, [3], 2)], cols), F.col("vec_id") % 50 == 0).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(50, [1], 1)], cols), F.col("vec_id") % 50 == 0).collect() == []
    uneven = spark.createDataFrame([(50, [10, 10], 1), (1, [10], 1), (2, [3, 4, 9], 2), (3, [], 2)], cols)
    assert [tuple(r) for r in hard_negatives.hard_negatives(uneven, F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 1, 2, 100, 70)]
    # beyond what doubles hold exactly
    big = 10**8
    large = spark.createDataFrame([(50, [big, 1], 1), (1, [big, 1], 1), (2, [big * 9 // 10, 7], 2), (3, [big * 9 // 10, 6], 2)], cols)
    assert [(r.negative_id, r.negative_score) for r in hard_negatives.hard_negatives(large, F.col("vec_id") == 50).orderBy("rank").collect()] == [(2, big * (big * 9 // 10) + 7), (3, big * (big * 9 // 10) + 6)]


def test_served_rings_hold_every_neighbour():
    """No bound drops a ring that holds one of an anchor's nearest rows."""
    rng = np.random.default_rng(8)
    for _ in range(20):
        x = np.floor(rng.normal(size=(300, 3)) * 90)
        space = hard_negatives.Space(3, float((x * x).sum(1).max()) * (1 + 1e-9), np.zeros((0, 4)), np.zeros(0), np.zeros(0), x, np.zeros(0))
        whole = space.augmented(x)
        space.pivots = np.unique(whole, axis=0)[rng.permutation(200)[:12]]
        far = space.to_pivots(whole)
        cell, dist = far.argmin(1), far.min(1)
        ring = np.searchsorted(np.quantile(dist, [0.3, 0.6]), dist)
        keys = sorted({*zip(cell.tolist(), ring.tolist())})
        bounds = np.array([(c, r, dist[(cell == c) & (ring == r)].min(), dist[(cell == c) & (ring == r)].max()) for c, r in keys])
        for a in x[:40]:
            score = x @ a
            need = np.sort(score)[-4]
            at = set(hard_negatives._served(space, bounds, a[None, :], np.array([[int(need)]]), np.array([[2**62]])).tolist())
            assert {keys.index((c, r)) for c, r in zip(cell[score >= need].tolist(), ring[score >= need].tolist())} <= at


# vector packing


def test_fill_keeps_all_limits():
    rng = random.Random(3)
    for _ in range(200):
        limits = Limits(rng.choice([16, 64, 100]), rng.randint(1, 6), rng.choice([9, 40, 100]))
        items = []
        for _ in range(rng.randint(0, 40)):
            n = rng.randint(1, limits.tokens)
            items.append((n, rng.randint(max(0, n - limits.loss), n)))
        length, prompt = np.array([x[0] for x in items], np.int64), np.array([x[1] for x in items], np.int64)
        seen = {i: [] for i in range(len(items))}
        for own in fill(length, prompt, limits):
            used = sum(n for _, _, n in own)
            loss = sum(max(0, f + n - max(f, prompt[i])) for i, f, n in own)
            assert own and used <= limits.tokens and len(own) <= limits.segments and loss <= limits.loss
            assert used == limits.tokens or used & (used - 1) == 0
            for i, f, n in own:
                seen[i].append((f, n))
        for i, parts in seen.items():
            at = 0
            for f, n in sorted(parts):
                assert f == at and n > 0
                at += n
            assert at == length[i]
    with pytest.raises(ValueError):
        fill(np.array([17]), np.array([0]), Limits(16, 4, 16))


def test_fill_takes_the_largest_dot_product():
    """With loss nearly used up, a long prompt goes before a longer text that bears loss."""
    out = fill(np.array([50, 30, 40]), np.array([0, 30, 10]), Limits(100, 10, 55))
    assert [[x[0] for x in own] for own in out][0][:2] == [0, 1]


def placed_well(rows, ids, limit):
    """Every id lies in one piece, sums and offsets are right; the padding."""
    parts, lines = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        lines.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert parts.keys() == ids.keys()
    for d, own in parts.items():
        want = Counter((lo, n, zlib.crc32(np.array(x[lo : lo + n], "<u4").tobytes()), len(x)) for r in own for x in [ids[d][0]] for lo, n in [(r.start, r.length)])
        assert want == Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)
        assert Counter(k for r in own for k in range(r.start, r.start + r.length)) == {k: ids[d][1] for k in range(len(ids[d][0]))}
    used = []
    for v in lines.values():
        at = 0
        for o, n in sorted(v):
            assert o == at and n > 0
            at += n
        used.append(at)
    assert max(used, default=0) <= limit
    return sum(0 if n & (n - 1) == 0 else limit - n for n in used)


def test_op12(spark, odd_docs, path, tmp_path):
    more = spark.createDataFrame([(20 + i, "some plain words of a text " * (i % 37 + 1), "s1") for i in range(60)], "doc_id long, text string, source string")
    docs = odd_docs.select("doc_id", "text", "source").unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    times = Counter(r.doc_id for r in docs.select("doc_id").collect())
    ids = {r.doc_id: ([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], times[r.doc_id]) for r in docs.collect()}
    assert placed_well(run(spark, str(tmp_path), 12).collect(), ids, 1024) == 0


def test_vector_pack_with_prompts(spark, odd_docs, path):
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    limits = Limits(256, 5, 200)
    docs = odd_docs.dropDuplicates(["doc_id"]).withColumn("prompt", F.expr("CASE WHEN doc_id = 3 THEN 'What is asked here, in some words?' WHEN doc_id = 5 THEN repeat('question ', 400) END"))
    ids = {r.doc_id: ([*tok.encode(r.prompt or "", add_special_tokens=False).ids, *tok.encode(r.text or "", add_special_tokens=False).ids, 0], 1) for r in docs.collect()}
    rows = vector_packing.vector_pack(docs, path("byte_bpe_50k.json"), limits=limits, shard_tokens=3000).collect()
    assert placed_well(rows, ids, 256) == 0
    heads = {r.doc_id: len(tok.encode(r.prompt or "", add_special_tokens=False).ids) for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(max(0, r.start + r.length - max(r.start, heads[r.doc_id])))
    assert all(sum(v) <= 200 and len(v) <= 5 for v in by.values())
    assert vector_packing.vector_pack(odd_docs.limit(0), path("byte_bpe_50k.json")).count() == 0


# source divergence


def brute_divergence(rows, least=10, most=10):
    rows = [tuple(x or "" for x in r) for r in rows]  # lang, source, text
    found = [(lang, source, [w.translate(ASCII) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = Counter(w for x, _, ws in found if x == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= least}
        count = {None: Counter()} | {s: Counter() for x, s, _ in rows if x == lang}
        for x, s, ws in found:
            if x == lang:
                own = [w for w in ws if w in kept]
                count[None].update(own)
                count[s].update(own)
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count.keys() - {None}:
            pairs = [(o, sum(f(p[s][w], p[o][w]) for w in kept)) for o in count.keys() - {None, s}]
            terms = [(w, f(p[s][w], p[None][w])) for w in kept if count[s][w] and p[s][w] > p[None][w]]
            for part, own, n in (("pair", pairs, len(pairs)), ("term", terms, most)):
                out |= {(lang, s, part, o, v, k) for k, (o, v) in enumerate(sorted(own, key=lambda x: (-x[1], x[0].encode()))[:n], 1)}
    return out


@pytest.fixture(scope="module")
def audited(spark, tmp_path_factory):
    rng = random.Random(6)
    words = ["Haus", "haus", "übung", "Ärger", "漢字", "river", "Stone", "x", "naïve", "don't", "a1b", "zz"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(400):
        source = "s0" if i % 3 == 0 else f"s{i % 7}"
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choice(words[(i % 7) * 3 :]) + rng.choice(["", ".", "\n", "\x00"]) for _ in range(rng.choice([0, 1, 5, 40])))))
    rows += [("fr", "s1", "only a few"), ("fr", "s2", None), ("fr", None, ""), ("en", "empty", "123 456"), (None, None, None), ("en", "s1", "river " * 30000)] + [rows[5]] * 15
    path = str(tmp_path_factory.mktemp("sf"))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string").withColumn("term", F.lit("x")).withColumn("n", F.lit(1))
    df.repartition(6).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_op13(spark, audited):
    got = run(spark, audited[0], 13).collect()
    assert {tuple(r) for r in got} == brute_divergence(audited[1]) and len(got) == len({tuple(r) for r in got})


def test_op13_sql_says_the_same(audited):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{audited[0]}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in con.execute(registry.oracle_sql()["op13_source_divergence"]).fetchall()} == brute_divergence(audited[1])


def test_divergence_of_small_shards(spark, audited):
    """Batches that end within a term, and counts summed again and again within a shard."""
    docs = spark.read.parquet(f"{audited[0]}/documents.parquet")
    got = divergence.source_divergence(docs, least_docs=3, most_terms=4, batch_bytes=2000, shard_rows=40).collect()
    assert {tuple(r) for r in got} == brute_divergence(audited[1], 3, 4)
    assert divergence.source_divergence(docs.limit(0)).collect() == []
    json.dumps([list(r) for r in got])
