"""Quality and toxicity by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, release, slices, table, text_buffers, written

#: Function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it for was on are as with by at this be or a an "
    "der die das und den von zu mit sich auf für ist nicht ein eine als auch es an dem des im in "
    "le la les de des du et un une en que qui dans pour par sur au avec ce il est pas ou "
    "el la los las de del y en que un una por con para se su al lo como es"
)
BITS = 20
#: Words also count by their first so many bytes, so that a stem is known in words not met before; such hashes are from WHOLE on.
PREFIXES = (4, 5, 6, 7, 8)
WHOLE = 1 << (BITS - 1)

_SPACES = np.arange(256).astype(np.uint8)
_SPACES[[0, *range(9, 14), 32]] = 0
_LETTERS = np.zeros(256, np.uint8)
for _b in [*range(0x61, 0x7B), *range(0x80, 0x100)]:
    _LETTERS[_b] = _b
for _b in range(0x41, 0x5B):
    _LETTERS[_b] = _b + 32
#: ASCII punctuation but for what ends words of plain sentences.
_SYMBOL = np.zeros(256, np.bool_)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,:;?'\")]"]] = True
_ALNUM = np.zeros(256, np.bool_)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Labellers of quality: share of words, junk from, sound up to.
_QUALITY = {"symbols": (0.2, 0.05), "repeats": (0.15, 0.05), "marks": (0.15, 0.03), "capitals": (0.5, 0.25), "no function words": (0.97, 0.9)}
#: Labellers of toxicity: as many lists of hashed words, each learned from labels of a part of the sample of its own.
FOLDS = 3
FEATURES = [*_QUALITY, "short"]


def _hashes_of(words: str) -> np.ndarray:
    import pyarrow as pa

    return np.unique(Words(pa.array([words]), _LETTERS).hashes())


@dataclass
class Seen:
    """Of a batch of texts: shares (a row each), and the hashed words with the text that each belongs to."""

    shares: np.ndarray
    owner: np.ndarray
    feature: np.ndarray


def look(col) -> Seen:
    """What the labellers and the scorer see of whole texts; null and empty ones have no words, and shares of 0."""
    tokens, words = Words(col, _SPACES), Words(col, _LETTERS)
    n = len(col)
    size, n_words = np.diff(tokens.doc), np.diff(words.doc)

    def per(doc, flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[doc]) if len(flags) else np.zeros(n)

    d, length = tokens.data, tokens.end - tokens.start
    symbols = (length >= 3) & _SYMBOL[d[tokens.end - 1]] & _SYMBOL[d[np.maximum(tokens.end - 2, 0)]] if len(d) else np.zeros(0, bool)
    known = np.concatenate([[0], np.cumsum(_ALNUM[d])])
    marks = known[tokens.end] == known[tokens.start]
    upper = np.concatenate([[0], np.cumsum((d >= 65) & (d <= 90))])
    lower = np.concatenate([[0], np.cumsum((d >= 97) & (d <= 122))])
    h = words.hashes()
    owner = np.repeat(np.arange(n), n_words)
    repeats = np.zeros(len(h), bool)
    if len(h):
        repeats[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    _, ends = text_buffers(col)
    ups, lows = np.diff(upper[ends]), np.diff(lower[ends])
    some, told = np.maximum(size, 1), np.maximum(n_words, 1)
    plain = np.isin(h, _hashes_of(FUNCTION_WORDS))
    shares = np.stack([per(tokens.doc, symbols) / some, per(words.doc, repeats) / told, per(tokens.doc, marks) / some, ups / np.maximum(ups + lows, 1), np.where(n_words > 0, 1 - per(words.doc, plain) / told, 0), np.minimum(1, 5 / (n_words + 5))], axis=1)
    low = np.uint64(WHOLE - 1)
    owners, features = [owner], [h & low]
    for k in PREFIXES:
        longer = words.end - words.start > k
        owners.append(owner[longer])
        features.append((words.hashes(k)[longer] + np.uint64(k) & low) + np.uint64(WHOLE))
    return Seen(shares, np.concatenate(owners), np.concatenate(features).astype(np.int32))


def votes(seen: Seen, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the labellers, a column each: 0 none, 1 against, 2 for. Of quality, and of toxicity: two words of a list speak for
    it, one alone doesn't tell. lists: of each hashed word the lists that hold it, as bits."""
    quality = np.zeros((len(seen.shares), len(_QUALITY)), np.int64)
    for k, (junk, sound) in enumerate(_QUALITY.values()):
        quality[:, k] = np.where(seen.shares[:, k] >= junk, 1, np.where(seen.shares[:, k] <= sound, 2, 0))
    at = np.flatnonzero(lists[seen.feature])
    pairs = np.unique(seen.owner[at].astype(np.int64) << BITS | seen.feature[at])
    owner, held = pairs >> BITS, lists[pairs & ((1 << BITS) - 1)]
    toxic = np.zeros((len(seen.shares), FOLDS), np.int64)
    for k in range(FOLDS):
        if (lists >> k & 1).any():
            n = np.bincount(owner[(held >> k & 1) > 0], minlength=len(seen.shares))
            toxic[:, k] = np.where(n >= 2, 2, np.where(n == 0, 1, 0))
    return quality, toxic


@dataclass
class LabelModel:
    """prior: of each class; table[j, y, v]: how often labeller j votes v on class y."""

    prior: np.ndarray
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)[None, :] + sum(np.log(self.table[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, positive: bool, rounds: int = 60, label_error: float = 1e-5) -> LabelModel:
    """Expectation-maximisation over the distinct patterns of votes with their counts: accuracies of the labellers and
    the classes' shares. The last column is the given labels, a labeller whose rate of errors is given. It starts from
    those labels, and where there are none from the votes themselves: `positive` asks for a majority of votes for, else any vote against
    makes the negative class."""
    counts = counts.astype(float)
    ayes, noes = (patterns == 2).sum(1), (patterns == 1).sum(1)
    p = np.where(ayes > noes, 0.9, 0.1) if positive else np.where(noes > 0, 0.1, 0.9)
    p = np.where(patterns[:, -1] > 0, np.where(patterns[:, -1] == 2, 0.99, 0.01), p)
    model = LabelModel(np.array([0.5, 0.5]), np.zeros((patterns.shape[1], 2, 3)))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * counts, p * counts])
        model.prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        for j in range(patterns.shape[1]):
            for v in range(3):
                model.table[j, :, v] = weight[:, patterns[:, j] == v].sum(1) + 0.5
        model.table /= model.table.sum(2, keepdims=True)
        model.table[-1] = [[1, 1 - label_error, label_error], [1, label_error, 1 - label_error]]
        p = model.posterior(patterns)
    return model


@dataclass
class Scorer:
    """A logistic model over shares and over which hashed words occur at all."""

    bias: float
    dense: np.ndarray
    words: np.ndarray

    def score(self, seen: Seen) -> np.ndarray:
        total = self.bias + seen.shares @ self.dense
        at = np.flatnonzero(self.words[seen.feature])
        pairs = np.unique(seen.owner[at].astype(np.int64) << BITS | seen.feature[at])
        np.add.at(total, pairs >> BITS, self.words[pairs & ((1 << BITS) - 1)])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def chosen_words(seen: np.ndarray, aye: np.ndarray, n: int, positive: float, least_z: float = 5.0, least_texts: int = 3) -> np.ndarray:
    """Hashed words that occur in least_texts texts of the sample and whose share of texts differs between the classes by least_z
    standard errors. seen, aye: in how many texts each occurs, and the sum of those texts' targets; n, positive: the same of all texts."""
    p, q, mean = aye / max(positive, 1), (seen - aye) / max(n - positive, 1), seen / max(n, 1)
    z = np.abs(p - q) / np.sqrt(np.maximum(mean * (1 - mean), 1e-12) * (1 / max(positive, 1) + 1 / max(n - positive, 1)))
    return np.flatnonzero((seen >= least_texts) & (z >= least_z))


def train(shares: np.ndarray, owner: np.ndarray, feature: np.ndarray, target: np.ndarray, chosen: np.ndarray, rounds: int = 400, sparse: float = 1e-4) -> Scorer:
    """A logistic model of which both classes weigh alike, over the chosen words; an L1 penalty drops more of them, so that long
    texts don't gather the noise of thousands of weak weights. Accelerated proximal gradient, columns scaled by how often they occur.
    target: probabilities, as the label model gives them."""
    n, positive = len(target), target.sum()
    weight = np.where(target > 0.5, 0.5 / max(positive, 1), 0.5 / max(n - positive, 1))
    column = np.full(1 << BITS, -1)
    column[chosen] = np.arange(len(chosen))
    use = column[feature] >= 0
    owner, col, m = owner[use], column[feature[use]], len(chosen)
    freq = np.maximum(np.bincount(col, weight[owner], m), 1e-4) if m else np.zeros(0)
    step = 0.1 / freq**0.5
    bias, dense, words = 0.0, np.zeros(shares.shape[1]), np.zeros(m)
    yb, yd, yw, t = bias, dense, words, 1.0
    for _ in range(rounds):
        margin = yb + shares @ yd + np.bincount(owner, yw[col], n)
        g = weight * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target)
        b, d, w = yb - g.sum(), yd - 4 * (shares.T @ g), yw - step * np.bincount(col, g[owner], m)
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        k = (t - 1) / s
        yb, yd, yw = b + k * (b - bias), d + k * (d - dense), w + k * (w - words)
        bias, dense, words, t = b, d, w, s
    full = np.zeros(1 << BITS, np.float32)
    full[chosen] = words
    return Scorer(bias, dense, full)


@dataclass
class Model:
    quality: Scorer
    toxic: Scorer
    labels: dict[str, LabelModel]


def _counted(sample: DataFrame, group: dict[int, tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each group: in how many texts of the sample each hashed word occurs, and the sum of those texts' values. group: of a doc_id
    pairs (group, value). What comes back is bounded by the number of hashes."""
    import pyarrow as pa

    held = sample.sparkSession.sparkContext.broadcast(group)

    def run(it):
        for batch in it:
            flat: dict[int, list] = {}
            for d, w in zip(batch.column(0).to_pylist(), batch.column(2)):
                for g, value in held.value.get(d, ()):
                    flat.setdefault(g, []).append((np.frombuffer(w.as_py(), "<i4"), value))
            for g, rows in flat.items():
                at = np.concatenate([x for x, _ in rows])
                u, back = np.unique(at, return_inverse=True)
                aye = np.bincount(back, np.repeat([v for _, v in rows], [len(x) for x, _ in rows]), len(u))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), g, np.int32)), pa.array(u), pa.array(np.bincount(back, minlength=len(u))), pa.array(aye)], names=["g", "word", "n", "aye"])

    found = sample.mapInArrow(run, "g int, word int, n long, aye double").groupBy("g", "word").agg(F.sum("n").alias("n"), F.sum("aye").alias("aye")).where("n > 1").toArrow()
    g, word, n, aye = (c.to_numpy() for c in found.columns)
    out = {}
    for k in {x for v in group.values() for x, _ in v}:
        seen, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
        seen[word[g == k]], total[word[g == k]] = n[g == k], aye[g == k]
        out[k] = seen, total
    return out


def fit(docs: DataFrame, labels: DataFrame | None, most_labelled: int = 6000, most_other: int = 2000) -> Model:
    """Fit on docs (doc_id, text) and labels (doc_id, quality, toxic; may be empty or None).

    The labellers vote on every document: of quality by shares of odd words, of toxicity by FOLDS lists of whole words' hashes, each
    learned from the labels of another part of the sample, where it has no vote itself; given labels are one more labeller. Expectation-maximisation
    runs over the counts of vote patterns, at most 3 to the number of labellers, whatever the table's size. The scorer is trained on the
    posterior labels of a bounded sample: most_labelled rows with a label and most_other without, of the least hash of
    doc_id; only its chosen hashed words come to the driver. Null and empty texts vote by their shares of 0; of rows that repeat a doc_id
    with other texts one is in the sample; rows with a null doc_id vote, but are in no sample. Empty tables give a model that keeps
    everything, and without labels no document is toxic."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    gold = spark.createDataFrame([], "doc_id long, gq int, gt int")
    if labels is not None:
        gold = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(c) + 1, F.lit(0)).cast("int").alias(f"g{c[0]}") for c in ("quality", "toxic")])
    drawn = docs.where("doc_id is not null").select("doc_id").join(gold, "doc_id", "left").select("doc_id", F.coalesce("gq", F.lit(0)).alias("gq"), F.coalesce("gt", F.lit(0)).alias("gt"), F.xxhash64("doc_id").alias("draw")).distinct()
    info = {r.doc_id: r for part, most in (("gq > 0 or gt > 0", most_labelled), ("gq = 0 and gt = 0", most_other)) for r in drawn.where(part).orderBy("draw", "doc_id").limit(most).collect()}

    def features(it):
        for batch in slices(it, 1 << 20):
            seen = look(batch.column(1))
            pairs = np.unique(seen.owner.astype(np.int64) << BITS | seen.feature)
            ends = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << BITS)
            low = (pairs & ((1 << BITS) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen.shares.tolist(), pa.list_(pa.float64())), pa.array([low[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["doc_id", "shares", "words"])

    ids = spark.createDataFrame([(i,) for i in info], "doc_id long")
    sample = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(features, "doc_id long, shares array<double>, words binary")
    sample = written(sample.dropDuplicates(["doc_id"]), "sample")

    fold = {i: (r.draw >> 8) % FOLDS for i, r in info.items() if r.gt > 0}
    lists = np.zeros(1 << BITS, np.uint8)
    for k, (seen, aye) in _counted(sample, {i: [(f, info[i].gt - 1.0)] for i, f in fold.items()}).items():
        # half of the texts with it or more are toxic by two standard errors (Wilson's bound): five of five at least
        lower = (aye + 2 - 2 * np.sqrt(aye * (seen - aye) / np.maximum(seen, 1) + 1)) / (seen + 4)
        lists |= ((aye >= 5) & (lower >= 0.5) & (np.arange(1 << BITS) < WHOLE)).astype(np.uint8) << np.uint8(k)
    held = spark.sparkContext.broadcast(lists)

    def vote(it):
        for batch in slices(it, 1 << 20):
            quality, toxic = votes(look(batch.column(1)), held.value)
            code = lambda v: pa.array(v @ 3 ** np.arange(v.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), code(quality), *(pa.array(x, pa.int32()) for x in toxic.T)], names=["doc_id", "q", *(f"t{k}" for k in range(FOLDS))])

    cast = docs.mapInArrow(vote, "doc_id long, q int, " + ", ".join(f"t{k} int" for k in range(FOLDS)))
    folds = spark.createDataFrame(list(fold.items()), "doc_id long, fold int")
    cast = cast.join(gold, "doc_id", "left").join(F.broadcast(folds), "doc_id", "left")
    toxic = sum((F.when(F.col("fold") == k, F.lit(0)).otherwise(F.col(f"t{k}")) * 3**k for k in range(FOLDS)), F.lit(0))
    cast = written(cast.select("doc_id", "q", toxic.alias("t"), F.coalesce("gq", F.lit(0)).alias("gq"), F.coalesce("gt", F.lit(0)).alias("gt")), "votes")
    kinds = (("quality", "q", "gq", len(_QUALITY)), ("toxic", "t", "gt", FOLDS))
    unpack = lambda rows, own, given, width: np.array([[*(r[own] // 3**j % 3 for j in range(width)), r[given]] for r in rows], np.int64).reshape(-1, width + 1)
    models = {}
    for name, own, given, width in kinds:
        rows = cast.groupBy(own, given).agg(F.count("*").alias("n")).collect() or [{own: 0, given: 0, "n": 0}]
        models[name] = fit_labels(unpack(rows, own, given, width), np.array([r["n"] for r in rows]), positive=name == "toxic")

    own_votes = {r.doc_id: r for r in cast.join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).collect()}
    names = sorted(own_votes)
    target = {name: dict(zip(names, models[name].posterior(unpack([own_votes[i] for i in names], own, given, width)).tolist())) if names else {} for name, own, given, width in kinds}
    counted = _counted(sample, {i: [(0, target["quality"][i]), (1, target["toxic"][i])] for i in names})
    none = np.zeros(1 << BITS)
    chosen = [chosen_words(*counted.get(k, (none, none)), len(names), sum(target[name].values())) for k, (name, *_) in enumerate(kinds)]
    every = np.union1d(*chosen)
    use = spark.sparkContext.broadcast(every)

    def kept(it):
        for batch in it:
            words = [np.frombuffer(w.as_py(), "<i4") for w in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w[np.isin(w, use.value)].tobytes() for w in words], pa.binary())], names=["doc_id", "shares", "words"])

    got = sample.mapInArrow(kept, sample.schema).toArrow()
    order = got.column("doc_id").to_pylist()
    shares = np.array(got.column("shares").to_pylist(), float).reshape(-1, len(FEATURES))
    words = [np.frombuffer(w, "<i4") for w in got.column("words").to_pylist()]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
    feature = np.concatenate([*words, np.zeros(0, np.int32)])
    release(sample, cast)
    scorers = []
    for (name, *_), own in zip(kinds, chosen):
        seen = shares if name == "quality" else np.zeros_like(shares)
        scorers.append(train(seen, owner, feature, np.array([target[name][i] for i in order]), own))
    return Model(*scorers, models)


def classify(docs: DataFrame, model: Model, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """(row, quality, toxic, keep) of every row of docs: all its columns as a struct, its scores and whether it stays.

    Null and empty texts have no words and are judged by the models' bias alone; repeated rows are judged alike, rows with a
    null doc_id like any other. An empty table stays empty."""
    import pyarrow as pa
    from pyspark.sql import types as T

    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for batch in slices(it, 1 << 20):
            seen = look(batch.column(1))
            q, t = held.value.quality.score(seen), held.value.toxic.score(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q), pa.array(t), pa.array((q >= least_quality) & (t < most_toxic))], names=["row", "quality", "toxic", "keep"])

    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    fields = [packed.schema.fields[0], T.StructField("quality", T.DoubleType()), T.StructField("toxic", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    return packed.mapInArrow(run, T.StructType(fields))


def keep_good(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The documents that the classifier keeps, with all their columns."""
    judged = classify(docs, fit(docs, labels)).where("keep")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = classify(docs, fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))
    return judged.select("row.doc_id", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"), "keep")
