"""Token counts that follow edits: a tree of segments per document, of which an edit renews only what it touches."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table, written
from .tokens import UnitEncoder, encoder

#: The tokenizer parts texts before a single space between other characters, whatever stands further off.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def segments(text: str, chars: int) -> list[str]:
    """Cut a text before single spaces into segments of at least `chars` characters (the last may be shorter)."""
    out, lo = [], 0
    while lo < len(text):
        at = _CUT.search(text, lo + chars)
        hi = at.start() if at else len(text)
        out.append(text[lo:hi])
        lo = hi
    return out


def _count(enc: UnitEncoder, parts: list[str]) -> list[int]:
    import pyarrow as pa

    _, ends = enc.encode(pa.array(parts, pa.string()))
    return np.diff(ends).tolist()


@dataclass
class Tree:
    """Segments of one text and a heap of subtree sums over them: node k has the children 2k and 2k + 1, leaf i is node size + i.

    sums[k] = (characters, tokens)."""

    leaves: list[tuple[int, int]]
    sums: list[tuple[int, int]] = field(init=False)

    def __post_init__(self) -> None:
        size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = [(0, 0)] * size + self.leaves + [(0, 0)] * (size - len(self.leaves))
        for k in range(size - 1, 0, -1):
            self._add(k)

    def _add(self, k: int) -> None:
        a, b = self.sums[2 * k], self.sums[2 * k + 1]
        self.sums[k] = (a[0] + b[0], a[1] + b[1])

    @property
    def size(self) -> int:
        return len(self.sums) // 2

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The segment that holds character `at`, and where it begins, by the sums from the root down."""
        k, before = 1, 0
        while k < self.size:
            k *= 2
            if at >= before + self.sums[k][0] and self.sums[k + 1][0]:
                before += self.sums[k][0]
                k += 1
        return k - self.size, before

    def replace(self, lo: int, hi: int, leaves: list[tuple[int, int]]) -> int:
        """Segments lo..hi become `leaves`; the number of sums that are renewed: the paths above them, or all if there are more or fewer."""
        if len(leaves) == hi - lo:
            level = {self.size + i for i in range(lo, hi)}
            for i, leaf in zip(range(lo, hi), leaves):
                self.sums[self.size + i] = leaf
            self.leaves[lo:hi] = leaves
            renewed = 0
            while level := {k // 2 for k in level} - {0}:
                for k in level:
                    self._add(k)
                renewed += len(level)
            return renewed
        self.leaves[lo:hi] = leaves
        self.__post_init__()
        return self.size


def build(enc: UnitEncoder, text: str, chars: int) -> Tree:
    parts = segments(text, chars)
    return Tree(list(zip(map(len, parts), _count(enc, parts))))


def touched(tree: Tree, text: str, start: int, stop: int) -> tuple[int, int, int, int]:
    """Segments (from, to) that an edit of text[start:stop] can change, and their characters (from, to).

    A cut stays one if the characters on either side of its space are unchanged, so the segments on both sides of the edit
    come along where it lies at their edge."""
    lo, a = tree.find(max(0, start - 2))
    hi, b = tree.find(min(len(text), stop + 1))
    return lo, hi + 1, a, min(len(text), b + (tree.leaves[hi][0] if tree.leaves else 0))


@dataclass
class Renewal:
    """An edit made ready: the new text, the segments lo..hi that it touches and the new ones in their place."""

    text: str
    lo: int
    hi: int
    parts: list[str]


def prepare(tree: Tree, text: str, start: int, stop: int, insert: str, chars: int) -> Renewal:
    """Replace text[start:stop]; only the touched segments' characters have to be encoded.

    The touched segments' text is cut into as many again (some may be empty), so that only sums above them change; only if they would
    hold more than 2 `chars` characters each, they become more, and the tree is made anew."""
    lo, hi, a, b = touched(tree, text, start, stop) if tree.leaves else (0, 0, 0, 0)
    own, n = text[a:start] + insert + text[stop:b], hi - lo
    if len(own) <= 2 * chars * n:
        parts = segments(own, -(-len(own) // n)) if own else []
        parts += [""] * (n - len(parts))
    else:
        parts = segments(own, chars)
        if len(parts) > 1 and len(parts[-1]) < chars // 2:
            parts[-2:] = [parts[-2] + parts[-1]]
    return Renewal(text[:start] + insert + text[stop:], lo, hi, parts)


def edit(enc: UnitEncoder, tree: Tree, text: str, start: int, stop: int, insert: str, chars: int) -> tuple[str, int]:
    """Make one edit and renew the tree; the new text, and how many characters were encoded."""
    new = prepare(tree, text, start, stop, insert, chars)
    tree.replace(new.lo, new.hi, list(zip(map(len, new.parts), _count(enc, new.parts))))
    return new.text, sum(map(len, new.parts))


_LEAVES = "array<struct<chars:bigint,tokens:bigint>>"
_EDITS = "array<struct<start:bigint,stop:bigint,insert:string>>"


def _arrow_leaves(trees: list[Tree]):
    import pyarrow as pa

    ends = np.cumsum([0, *(len(t.leaves) for t in trees)])
    flat = np.array([x for t in trees for x in t.leaves], np.int64).reshape(-1, 2)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["chars", "tokens"]))


def token_trees(docs: DataFrame, tokenizer: str, chars: int = 512) -> DataFrame:
    """docs with a column leaves: the (chars, tokens) of the segments of each whole text, to be kept beside it for count_edits.

    docs: doc_id, text and any others but leaves. Null and empty texts have no segments; repeated rows each have their own; an
    empty table gives an empty table."""
    import pyarrow as pa

    def run(it):
        enc = encoder(tokenizer, 300_000)
        for batch in slices(it, 1 << 20):
            # all trees of a batch are built with one call
            cut = [segments(x or "", chars) for x in batch.column(1).to_pylist()]
            counts, at, trees = _count(enc, [p for c in cut for p in c]), 0, []
            for parts in cut:
                trees.append(Tree(list(zip(map(len, parts), counts[at : at + len(parts)]))))
                at += len(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_leaves(trees)], names=["row", "leaves"])

    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"))
    out = packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructType.fromDDL(f"leaves {_LEAVES}").fields[0]]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "leaves")


def count_edits(docs: DataFrame, tokenizer: str, chars: int = 512) -> DataFrame:
    """(doc_id, n_tokens, edited_tokens, n_encoded, leaves): token counts before and after each document's edits, characters encoded
    for the edits, and the segments of the tree after them, for the next edits.

    docs: doc_id, text, leaves (as token_trees or an earlier call gave them for this text and these chars) and edits
    array<struct<start, stop, insert>>, in code points, applied one after another; places beyond the text are its end. Only what
    edits touch is encoded. Null texts are empty, null edits none; repeated rows and null doc_ids are counted like any other; an empty table
    gives an empty table; leaves that don't add up to their text are an error."""
    import pyarrow as pa

    def run(it):
        enc = encoder(tokenizer, 300_000)
        for batch in slices(it, 1 << 20):
            texts = [x or "" for x in batch.column(3).to_pylist()]
            edits = [x or [] for x in batch.column(1).to_pylist()]
            kept = batch.column(2)
            flat, ends = kept.flatten(), np.append(0, np.cumsum(np.nan_to_num(kept.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)))
            pairs = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
            trees = [Tree(pairs[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            if any(t.sums[1][0] != len(x) for t, x in zip(trees, texts)):
                raise ValueError("leaves and text differ in length")
            before, encoded = [t.tokens for t in trees], [0] * len(trees)
            for turn in range(max(map(len, edits), default=0)):
                ready = []  # each round of edits of a batch is encoded with one call
                for d, own in enumerate(edits):
                    if turn < len(own):
                        e, text = own[turn], texts[d]
                        stop = max(0, min(e["stop"], len(text)))
                        ready.append((d, prepare(trees[d], text, min(max(0, e["start"]), stop), stop, e["insert"] or "", chars)))
                counts, at = _count(enc, [p for _, new in ready for p in new.parts]), 0
                for d, new in ready:
                    trees[d].replace(new.lo, new.hi, list(zip(map(len, new.parts), counts[at : at + len(new.parts)])))
                    at += len(new.parts)
                    texts[d] = new.text
                    encoded[d] += sum(map(len, new.parts))
            cols = [batch.column(0), pa.array(before, pa.int64()), pa.array([t.tokens for t in trees], pa.int64()), pa.array(encoded, pa.int64()), _arrow_leaves(trees)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "edited_tokens", "n_encoded", "leaves"])

    ready = docs.select(F.col("doc_id").cast("long"), F.col("edits").cast(_EDITS), F.col("leaves").cast(_LEAVES), F.col("text").cast("string"))
    return ready.mapInArrow(run, f"doc_id long, n_tokens long, edited_tokens long, n_encoded long, leaves {_LEAVES}")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document gets two edits: 40 characters in its middle give way to its first 25, and its last 10 go. The trees are kept in a
    table beside the texts, and the edits are counted from that."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = written(token_trees(table(spark, sf_dir, "documents", "doc_id", "text"), path), "trees")
    n = F.length(F.coalesce("text", F.lit("")))
    half = F.floor(n / 2)
    kind = "struct<start:bigint,stop:bigint,insert:string>"
    first = F.struct(half.cast("long").alias("start"), F.least(half + 40, n).cast("long").alias("stop"), F.substring("text", 1, 25).alias("insert")).cast(kind)
    after = n - F.least(half + 40, n) + half + F.least(n, F.lit(25))
    last = F.struct(F.greatest(after - 10, F.lit(0)).cast("long").alias("start"), after.cast("long").alias("stop"), F.lit("").alias("insert")).cast(kind)
    out = count_edits(docs.select("doc_id", "text", "leaves", F.array(first, last).alias("edits")), path)
    return out.select("doc_id", "n_tokens", "edited_tokens", "n_encoded", F.size("leaves").cast("long").alias("n_segments"))
