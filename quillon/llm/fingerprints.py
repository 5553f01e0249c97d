"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table

#: A paragraph is a line; longer lines are paragraphs of up to 16 words each.
PARAGRAPH = r"[^\s]+(?:[^\S\n]+[^\s]+){0,15}"
#: Cells of each of the three sub-tables of a part of the stored sketch, and of a part that is tried again (at most 20, as a
#: key's cells are the bits of a long).
CELLS, RETRIES = 6, (12, 20)
#: A part of the stored sketch is for so many digests at most, on average; there are at most 2**MOST_BITS parts.
PER_PART, MOST_BITS = 4, 16


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _power(bits: Column) -> Column:
    return F.call_function("shiftleft", _long(1), bits)


def digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def part_bits(n: Column) -> Column:
    """A sketch of n digests has two to this power parts."""
    return F.greatest(F.lit(0), F.least(F.lit(MOST_BITS), F.ceil(F.log2(F.greatest(n, F.lit(1)) / PER_PART)).cast("int")))


def _dealt(items: Column, bits: Column, key) -> Column:
    """items in 2**bits lists, by 16 bits of their digests: four bits at a time, so that n of them take 16 n steps at a time."""

    def deal(lists: Column, done: int) -> Column:
        own = F.greatest(F.lit(0), F.least(F.lit(4), bits - done))
        low = F.greatest(F.lit(0), bits - done - 4) + 20
        every = F.sequence(_long(0), _power(own) - 1)
        part = lambda x: F.call_function("shiftrightunsigned", key(x), low).bitwiseAND(_power(own) - 1)
        return F.flatten(F.transform(lists, lambda one: F.transform(every, lambda g: F.filter(one, lambda x: part(x) == g))))

    many = F.array(items)
    for done in range(0, MOST_BITS, 4):
        many = deal(many, done)
    return F.when(bits == 0, F.array(items)).when(bits <= 4, deal(F.array(items), 0)).otherwise(many)


def _filed(keys: Column, m: int, signed: bool = False) -> Column:
    """Keys with a checksum and the three cells of each, as bits; m also seeds the choice of cells, so a retry chooses anew."""

    def cells(k: Column) -> Column:
        # three digits to the base m of one hash
        h = F.pmod(F.xxhash64(k, F.lit(31 * m)), _long(m**3))
        at = lambda d: F.pmod(F.floor(h / m**d), _long(m)).cast("int")
        return _power(at(0)) + _power(at(1) + m) + _power(at(2) + 2 * m)

    def one(x: Column) -> Column:
        k, n = (x.k, x.n) if signed else (x, _long(1))
        return F.struct(n.alias("n"), k.alias("k"), F.hash(k).alias("h"), cells(k).alias("at"))

    return F.transform(keys, one)


def _fold(filed: Column, bit: Column, start: Column, sign: int) -> Column:
    """A cell with all keys that have its bit put in (sign 1) or taken out (sign -1)."""
    put = lambda t, x: F.struct((t.n + x.n if sign > 0 else t.n - x.n).alias("n"), t.k.bitwiseXOR(x.k).alias("k"), t.h.bitwiseXOR(x.h).alias("h"))
    return F.aggregate(filed, start, lambda t, x: F.when(x.at.bitwiseAND(bit) != 0, put(t, x)).otherwise(t))


def _bits(m: int) -> Column:
    return F.array(*[_long(1 << i) for i in range(3 * m)])


def _cells(filed: Column, m: int) -> Column:
    zero = F.struct(_long(0).alias("n"), _long(0).alias("k"), F.lit(0).alias("h"))
    return F.transform(_bits(m), lambda i: _fold(filed, i, zero, 1))


def sketch(keys: Column, bits: Column, m: int = CELLS) -> Column:
    """2**bits parts of 3 m cells: how many of a part's keys fall in each (n), their exclusive or (k), and that of their checksums (h)."""
    return F.flatten(F.transform(_dealt(_filed(keys, m), bits, lambda x: x.k), lambda own: _cells(own, m)))


def signed_sketch(keys: Column, m: int) -> Column:
    """The difference of two versions' parts, cell by cell, from their digests with n = 1 and n = -1."""
    return _let(_filed(keys, m, True), lambda filed: _cells(filed, m))


def subtract(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda x, y: F.struct((x.n - y.n).alias("n"), x.k.bitwiseXOR(y.k).alias("k"), x.h.bitwiseXOR(y.h).alias("h")))


def peel(cells: Column, m: int, rounds: int = 6) -> Column:
    """The digests in one sketch only, recovered from the difference of two parts; null if a cell is left.

    A round takes the keys of all cells that hold a single one (n is 1 or -1 and the checksum is the key's) out of their
    cells."""

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s.cells, lambda c: (F.abs(c.n) == 1) & (F.hash(c.k) == c.h))
        lone = F.array_distinct(F.transform(pure, lambda c: F.struct(c.n.alias("n"), c.k.alias("k"))))

        def take(filed: Column) -> Column:
            hit = F.aggregate(filed, _long(0), lambda t, x: t.bitwiseOR(x.at))
            left = _let(hit, lambda bits: F.zip_with(s.cells, _bits(m), lambda c, i: F.when(bits.bitwiseAND(i) == 0, c).otherwise(_fold(filed, i, c, -1))))
            return F.when(F.size(filed) == 0, s).otherwise(F.struct(left.alias("cells"), F.concat(s.found, F.transform(filed, lambda x: x.k)).alias("found")))

        return _let(_filed(lone, m, True), take)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.when(F.forall(s.cells, lambda c: (c.n == 0) & (c.k == 0) & (c.h == 0)), s.found))


def _peeled(cells: Column, bits: Column) -> Column:
    """Of each part of a difference of stored sketches, how many digests it holds; null where it doesn't peel."""
    return F.transform(F.sequence(_long(0), _power(bits) - 1), lambda g: F.size(peel(F.slice(cells, (g * 3 * CELLS + 1).cast("int"), F.lit(3 * CELLS)), CELLS)))


def _again(found: Column, keys: Column, other_keys: Column, bits: Column) -> Column:
    """The sum of `found`, where each part that didn't peel is sketched again with more cells from the two versions' digests of that part, and
    is compared digest by digest if no sketch peels."""
    sign = lambda c, n: F.transform(c, lambda k: F.struct(_long(n).alias("n"), k.alias("k")))

    def part(p: Column) -> Column:
        of = lambda n: F.transform(F.filter(p, lambda x: x.n == n), lambda x: x.k)
        return F.coalesce(*[F.size(peel(signed_sketch(p, m), m)) for m in RETRIES], F.size(p) - 2 * F.size(F.array_intersect(of(1), of(-1))))

    both = F.zip_with(found, _dealt(F.concat(sign(keys, 1), sign(other_keys, -1)), bits, lambda x: x.k), lambda n, p: F.coalesce(n, part(p)))
    return F.when(F.exists(found, lambda n: n.isNull()), F.aggregate(both, F.lit(0), lambda s, n: s + n)).otherwise(F.aggregate(found, F.lit(0), lambda s, n: s + n))


def difference(one: Column, other: Column) -> Column:
    """How many digests two texts don't share. one, other: structs of keys, bits and cells (the stored sketch).

    The stored sketches are subtracted and peeled; of two with unequal numbers of parts the smaller is taken anew with the larger's
    number first. Parts that fail are tried again with more cells."""
    bits = F.greatest(one.bits, other.bits)
    sized = lambda x: F.when(x.bits == bits, x.cells).otherwise(sketch(x["keys"], bits))
    found = _let(subtract(sized(one), sized(other)), lambda cells: _peeled(cells, bits))
    return _let(found, lambda found: _again(found, one["keys"], other["keys"], bits))


def likeness(one: Column, other: Column) -> Column:
    """Jaccard likeness of two texts' sets of digests; two empty ones are alike."""
    both = F.size(one["keys"]) + F.size(other["keys"])
    return F.when(both == 0, F.lit(1.0)).otherwise(_let(difference(one, other), lambda d: (both - d) / (both + d)))


def printed(cells: Column) -> Column:
    """A sketch as text: of each cell n, k (16 digits) and h (8) in hex, nothing for an empty one, with commas between cells."""
    one = lambda c: F.concat(F.hex(c.n), F.lpad(F.hex(c.k), 16, "0"), F.lpad(F.hex(c.h.cast("long").bitwiseAND(_long(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(F.transform(cells, lambda c: F.when((c.n == 0) & (c.k == 0) & (c.h == 0), F.lit("")).otherwise(one(c))), ","))


def sketched(text: Column) -> Column:
    """keys, bits and cells of a text."""
    return _let(digests(text), lambda keys: _let(part_bits(F.size(keys)), lambda bits: F.struct(keys.alias("keys"), bits.alias("bits"), sketch(keys, bits).alias("cells"))))


def _below(limits: Column, size: int, x: Column, equal: bool) -> Column:
    """How many of the sorted limits are less than x (or equal to it), by halving."""
    step = size.bit_length()
    inside = lambda at: (F.element_at(limits, at) <= x) if equal else (F.element_at(limits, at) < x)
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(step))])
    return F.aggregate(halves, F.lit(0), lambda s, h: F.when((s + h <= size) & inside(F.least(s + h, F.lit(size))), s + h).otherwise(s))


def with_next(docs: DataFrame, columns, per_range: int = 512, most_ranges: int = 20_000) -> DataFrame:
    """docs (doc_id, text) with a struct next: what columns() makes of the next row by doc_id (nulls first; the first follows the last).

    columns: a function that adds a struct column `own` to a DataFrame. Rows are dealt into ranges of doc_id of about per_range rows, at
    most most_ranges of them, by a binary search of the quantiles of doc_id; each range also gets a copy of the next range's first row.
    So the texts are shuffled once, no task sees all rows, and what the driver holds is bounded by most_ranges. Rows of a doc_id that
    fills several ranges are dealt among those by a hash of their texts; equal doc_ids follow each other by that hash, then by text."""
    spark = docs.sparkSession
    n = docs.count()
    ranges = min(most_ranges, -(-n // per_range))
    limits: list[int] = []
    if ranges > 1:
        shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
        limits = sorted(docs.agg(F.percentile_approx("doc_id", shares, 4 * ranges)).first()[0] or [])
    tie = F.call_function("shiftrightunsigned", F.xxhash64("text"), F.lit(33))
    bucket = F.lit(0)
    if limits:
        held = F.split(F.lit(",".join(map(str, limits))), ",").cast("array<bigint>")
        low, upto = (_below(held, len(limits), F.col("doc_id"), equal) for equal in (False, True))
        bucket = F.coalesce(low + F.floor(F.greatest(upto - low, F.lit(1)) * (F.col("_tie") / float(1 << 31))).cast("int"), F.lit(0))
    dealt = docs.withColumn("_tie", tie).withColumn("_range", bucket)
    # a row for each range that isn't empty: its first row, and the range before it
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_tie")).alias("m")
    firsts = dealt.groupBy("_range").agg(least)
    around = Window.orderBy("_range")
    firsts = firsts.select(F.col("_range").alias("_from"), "m.doc_id", "m._tie", F.lag("_range").over(around).alias("_before"), F.max("_range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    firsts = firsts.select("_from", F.col("doc_id").alias("_first"), F.col("_tie").alias("_first_tie"), F.coalesce("_before", "_last").alias("_into"), F.col("_before").isNull().alias("_wrap"))
    copies = dealt.join(F.broadcast(firsts), (F.col("_range") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_first_tie")))
    copies = copies.select("doc_id", "text", "_tie", F.col("_into").alias("_range"), F.when(F.col("_wrap"), 2).otherwise(1).alias("_ghost"))
    order = Window.partitionBy("_range").orderBy("_ghost", "doc_id", "_tie", "text")
    # few bytes but much work follow each row: a number of partitions of its own, which adaptive execution doesn't lower
    both = dealt.select("doc_id", "text", "_tie", "_range", F.lit(0).alias("_ghost")).unionByName(copies).repartition(max(partitions(spark), ranges // 6), "_range")
    return columns(both).withColumn("next", F.lead("own").over(order)).where("_ghost = 0").select("doc_id", "text", "own", "next")


def compare(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_text (its last half replaced by the beginning of the next document), fingerprint and
    edited_fingerprint, near_edited and near_next.

    docs: doc_id, text. A fingerprint is a sketch in parts of 18 cells for two to four digests each, so its size follows the text's, and most
    edits are decided by two fingerprints alone. Null texts are empty: no digests, a sketch of empty cells; two texts without
    digests have likeness 1. Repeated rows follow each other, so the next of one is the other; a single document's next is itself; null
    doc_ids come first. An empty table gives an empty table."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    add = lambda df: df.withColumn("own", sketched(F.col("text"))).withColumn("own", F.struct("text", F.col("own.keys").alias("keys"), F.col("own.bits").alias("bits"), F.col("own.cells").alias("cells")))
    seen = with_next(own, add)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    seen = seen.select("doc_id", n.cast("long").alias("n_chars"), "own", "next", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited_text"))
    seen = seen.withColumn("edited", sketched(F.col("edited_text")))
    return seen.select(
        "doc_id", "n_chars", "edited_text", printed(F.col("own.cells")).alias("fingerprint"), printed(F.col("edited.cells")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
