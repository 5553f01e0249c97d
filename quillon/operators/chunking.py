"""Packing of elements into chunks of a bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import joined_count, split_parts, split_text, stable_id, token_count, unit_count


def check_sizes(max_tokens: int, min_tokens: int, threshold: float) -> None:
    if max_tokens < 32 or not 0 <= min_tokens <= max_tokens:
        raise ValueError("max_tokens must be 32 at least, min_tokens between 0 and max_tokens")
    if not -1 <= threshold <= 1:
        raise ValueError("the threshold must be between -1 and 1")


def fold_groups(parts: Column, max_tokens: int, min_tokens: int, gap: int = 2, prefix: Column | None = None) -> Column:
    """array<int>: the group of each part of an ordered array of structs (units, octets, section, alone, topic).

    A group ends where the section changes, before and after a part that stands alone, where the parts joined by `gap` bytes
    (with a prefix struct (units, octets) before them) would exceed max_tokens, and at a topic break once it has min_tokens.
    Sizes add up, so no text is joined in the fold."""
    zero = F.lit(0)
    before = prefix if prefix is not None else F.struct(zero.alias("units"), zero.alias("octets"))
    start = F.struct(F.lit(-1).alias("group"), zero.alias("n"), zero.alias("units"), zero.alias("octets"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("alone"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        over = joined_count(before.units + s.units + p.units, before.octets + s.octets + p.octets, s.n + 1, gap) > max_tokens
        topic = p.topic & (joined_count(s.units, s.octets, s.n, gap) >= min_tokens)
        new = (s.n == 0) | s.alone | p.alone | ~s.section.eqNullSafe(p.section) | over | topic
        group = F.when(new, s.group + 1).otherwise(s.group)
        return F.struct(
            group.alias("group"), F.when(new, 1).otherwise(s.n + 1).alias("n"), F.when(new, p.units).otherwise(s.units + p.units).alias("units"),
            F.when(new, p.octets).otherwise(s.octets + p.octets).alias("octets"), p.section.cast("string").alias("section"), p.alone.alias("alone"), F.concat(s.out, F.array(group)).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda s: s.out)


def grouped(rows: DataFrame, keys: list[str], max_tokens: int, min_tokens: int = 0, gap: int = 2) -> DataFrame:
    """rows (keys, ordinal, part, text, section, alone, topic, ...) with group: the fold over each document's rows in order."""
    others = [c for c in rows.columns if c not in keys]
    item = F.struct("ordinal", "part", F.struct(unit_count(F.col("text")).alias("units"), F.octet_length("text").alias("octets"), F.col("section").cast("string").alias("section"), "alone", "topic").alias("size"), F.struct(*[c for c in others if c not in ("ordinal", "part")]).alias("rest"))
    sorted_ = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a.ordinal != b.ordinal, F.signum(a.ordinal - b.ordinal)).otherwise(F.signum(a.part - b.part)).cast("int")).alias("items"))
    marked = sorted_.select(*keys, F.inline(F.arrays_zip("items", fold_groups(F.transform("items", lambda x: x.size), max_tokens, min_tokens, gap).alias("group"))))
    return marked.select(*keys, "items.ordinal", "items.part", "items.rest.*", "group")


def pack(elements: DataFrame, max_tokens: int = 384, min_tokens: int = 80, split: bool = True) -> DataFrame:
    """Text chunks of elements (doc_id, ordinal, text; section_id, topic where known): (doc_id, chunk, section_id, text, first, last, n,
    token_count). split: elements over the budget are cut first; without it they stay whole, each a chunk of its own."""
    check_sizes(max_tokens, min_tokens, 0)
    rows = elements.select("doc_id", "ordinal", "text", (F.col("section_id") if "section_id" in elements.columns else F.lit("")).alias("section"), (F.coalesce("topic", F.lit(False)) if "topic" in elements.columns else F.lit(False)).alias("topic"))
    if split:
        rows = rows.select("doc_id", "ordinal", "section", "topic", F.posexplode(split_parts(F.col("text"), max_tokens)).alias("part", "text"))
        rows = rows.withColumn("topic", F.col("topic") & (F.col("part") == 0))  # never between parts of one element
    else:
        rows = rows.withColumn("part", F.lit(0))
    groups = grouped(rows.withColumn("alone", F.lit(False)), ["doc_id"], max_tokens, min_tokens)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "part", "text")))
    chunks = groups.groupBy("doc_id", F.col("group").alias("chunk")).agg(F.first("section").alias("section_id"), F.array_join(F.transform(ordered, lambda x: x.text), "\n\n").alias("text"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count_distinct("ordinal").alias("n"))
    return chunks.withColumn("token_count", token_count(F.col("text")))


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with id, previous_id and next_id along the document."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    named = chunks.withColumn("id", stable_id("doc_id", "section_id", "chunk", "text"))
    return named.withColumn("previous_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))


def topic_breaks(elements: DataFrame, vectors: DataFrame, threshold: float = 0.35) -> DataFrame:
    """elements (doc_id, ordinal, kind, ...) with topic: true where the vectors of an element and the one before it are less alike than the threshold."""
    from ..functions.text import dot

    prose = F.col("kind").isin("paragraph", "list_item")
    joined = elements.join(vectors.select("doc_id", "ordinal", F.col("vector").alias("_v")), ["doc_id", "ordinal"], "left").withColumn("_v", F.when(prose, F.col("_v")))
    before = F.lag("_v").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return joined.withColumn("_b", before).withColumn("topic", F.coalesce(dot(F.col("_b"), F.col("_v")) < threshold, F.lit(False))).drop("_v", "_b")


def table_chunks(tables: DataFrame, max_tokens: int = 384) -> DataFrame:
    """Chunks of tables (doc_id, header, rows): (doc_id, chunk, text, first_row, last_row, row_fragment, token_count).

    Rows are packed in order under the header's text; the row that is the header itself is not repeated. A header of more than a quarter
    of the budget gives way to Col 1, Col 2, ..., and stays as a row. A row beyond the budget is cut. Row numbers start at 1 with
    the header's row."""
    check_sizes(max_tokens, 0, 0)
    quarter = max(8, max_tokens // 4)
    join = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    full = join(F.coalesce("header", F.array().cast("array<string>")))
    large = token_count(full) > quarter
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.size("header")), lambda i: F.concat(F.lit("Col "), i.cast("string"))), " | ")
    same = F.element_at("rows", 1).eqNullSafe(F.col("header"))
    lone = (F.size("rows") == 1) & same
    head = F.element_at(split_parts(F.when(large, names).otherwise(full), quarter), 1)
    start = F.when(same & ~large & ~lone, 2).otherwise(1)
    base = tables.select("doc_id", "rows", F.when(lone | (full == ""), F.lit("")).otherwise(F.concat(head, F.lit("\n"))).alias("prefix"), start.alias("start"))
    rows = base.select("doc_id", "prefix", F.posexplode(F.slice("rows", F.col("start"), F.greatest(F.size("rows") - F.col("start") + 1, F.lit(0)))).alias("at", "cells"), "start")
    rows = rows.select("doc_id", "prefix", (F.col("at") + F.col("start")).cast("int").alias("ordinal"), join(F.col("cells")).alias("text"))
    over = token_count(F.concat("prefix", "text")) > max_tokens
    whole = rows.where(~over).withColumn("part", F.lit(0)).withColumn("alone", F.lit(False))
    budget = F.lit(max_tokens) - token_count(F.col("prefix")) - 2
    cut = rows.where(over).withColumn("_budget", budget).select("doc_id", "prefix", "ordinal", F.posexplode(_parts_of("text", "_budget")).alias("part", "text")).withColumn("alone", F.lit(True))
    every = whole.unionByName(cut)
    item = F.struct("ordinal", "part", "text", "alone", F.struct(unit_count(F.col("text")).alias("units"), F.octet_length("text").alias("octets"), F.lit("").alias("section"), "alone", F.lit(False).alias("topic")).alias("size"))
    folded = every.groupBy("doc_id", "prefix").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a.ordinal != b.ordinal, F.signum(a.ordinal - b.ordinal)).otherwise(F.signum(a.part - b.part)).cast("int")).alias("items"))
    prefix = F.struct(unit_count(F.col("prefix")).alias("units"), F.octet_length("prefix").alias("octets"))
    marked = folded.select("doc_id", "prefix", F.inline(F.arrays_zip("items", fold_groups(F.transform("items", lambda x: x.size), max_tokens, 0, 1, prefix).alias("chunk"))))
    ordered = F.array_sort(F.collect_list(F.struct("items.ordinal", "items.part", "items.text")))
    body = F.array_join(F.transform(ordered, lambda x: x.text), "\n")
    out = marked.groupBy("doc_id", "prefix", "chunk").agg(body.alias("body"), F.min("items.ordinal").alias("first_row"), F.max("items.ordinal").alias("last_row"), F.bool_or("items.alone").alias("row_fragment"))
    out = out.withColumn("text", F.concat("prefix", "body"))
    return out.select("doc_id", "chunk", "text", "first_row", "last_row", "row_fragment", token_count(F.col("text")).alias("token_count"))


def _parts_of(text: str, budget: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, max(1, int(b))) for t, b in zip(x, n)])

    return cut(F.col(text), F.col(budget))


def expand(chunks: DataFrame, targets: DataFrame, budget: int = 1600) -> DataFrame:
    """The neighbours in their section of each target chunk that fit a budget of tokens: (target, id, chunk, token_count, total).

    chunks: id, doc_id, chunk (its place), section_id, token_count; targets: id. Backwards first, then forwards with what is
    left; each side ends at the section's end or before the first chunk that doesn't fit. A target over the budget is an error
    for a single call; here its row has no neighbours and a null total."""
    w = Window.partitionBy("doc_id").orderBy("chunk")
    new = F.when(F.lag("section_id").over(w).eqNullSafe(F.col("section_id")), 0).otherwise(1)
    runs = chunks.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    middle = runs.join(targets.select(F.col("id")).distinct(), "id", "left_semi").select(F.col("id").alias("target"), "doc_id", "_run", F.col("chunk").alias("_at"), F.col("token_count").alias("_own"))
    near = runs.join(middle, ["doc_id", "_run"])
    back = Window.partitionBy("target", (F.col("chunk") < F.col("_at"))).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, 0)
    before = near.where("chunk < _at").withColumn("_sum", F.sum("token_count").over(back)).where(F.col("_sum") + F.col("_own") <= budget)
    used = before.groupBy("target").agg(F.max("_sum").alias("_used"))
    ahead = Window.partitionBy("target").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    after = near.where("chunk > _at").withColumn("_sum", F.sum("token_count").over(ahead)).join(used, "target", "left").where(F.col("_sum") + F.coalesce("_used", F.lit(0)) + F.col("_own") <= budget)
    cols = ["target", "id", "chunk", "token_count"]
    every = before.select(cols).unionByName(after.select(cols)).unionByName(near.where("chunk = _at").select(cols))
    total = F.sum("token_count").over(Window.partitionBy("target"))
    return every.withColumn("total", F.when(total <= budget, total))


#: Beginnings of page warnings that ask for a review.
REVIEW = r"^(needs_ocr|ocr_|low_|replacement_|visual_|table_detection_failed)"


def with_citations(chunks: DataFrame, elements: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """chunks (doc_id, chunk, first, last) with element_ids, citations and needs_review.

    elements: doc_id, ordinal, id, source, page, bbox, extraction, confidence. A page and box is cited once, by the first element in it.
    pages: doc_id, page, warnings; a chunk needs a review if a page it cites has such a warning."""
    spans = chunks.select(F.col("doc_id").alias("_doc"), "chunk", "first", "last")
    rows = elements.join(spans, (F.col("doc_id") == F.col("_doc")) & F.col("ordinal").between(F.col("first"), F.col("last")))
    if pages is not None:
        bad = pages.select("doc_id", "page", F.exists("warnings", lambda w: w.rlike(REVIEW)).alias("_bad"))
        rows = rows.join(bad, ["doc_id", "page"], "left")
    else:
        rows = rows.withColumn("_bad", F.lit(False))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", "source", "page", "bbox", "extraction", "confidence")))
    grouped_ = rows.groupBy("doc_id", "chunk").agg(ordered.alias("_items"), F.bool_or(F.coalesce("_bad", F.lit(False))).alias("needs_review"))
    places = F.transform("_items", lambda x: F.struct(x.page.alias("page"), x.bbox.alias("bbox")))
    firsts = F.filter("_items", lambda x, i: F.array_position(F.col("_places"), F.struct(x.page.alias("page"), x.bbox.alias("bbox"))) == i + 1)
    cited = F.transform(firsts, lambda x: F.struct(x.source.alias("source"), x.page.alias("page"), x.bbox.alias("bbox"), x.id.alias("element_id"), x.extraction.alias("extraction"), x.confidence.alias("confidence")))
    out = grouped_.withColumn("_places", places).select("doc_id", "chunk", "needs_review", F.array_distinct(F.transform("_items", lambda x: x.id)).alias("element_ids"), cited.alias("citations"))
    return chunks.join(out, ["doc_id", "chunk"], "left")
