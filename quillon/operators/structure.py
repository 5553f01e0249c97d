"""Elements of documents as structured corpora: boilerplate, headings, sections, tables, and chunks that cite their places."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS, basename, stable_id
from ..sources.scratch import kept
from . import chunking, dense, layout
from .sections import section_tree

#: Columns of elements that only some parsers fill.
_OPTIONAL = {"rows": "array<array<string>>", "row_boxes": "array<array<double>>", "header": "array<string>", "table_id": "string", "extraction": "string", "confidence": "double"}


@dataclass
class Corpus:
    """What ingest makes of documents: the datasets that a store takes."""

    documents: DataFrame
    elements: DataFrame
    sections: DataFrame
    chunks: DataFrame
    pages: DataFrame


def text_elements(docs: DataFrame) -> DataFrame:
    """An element for each line that isn't blank of docs (doc_id, text, source): form feeds part pages; ordinal orders the lines of all pages.

    The outer lines of each page of a text with several pages stand in its margins. Plain text has one size and weight."""
    pages = docs.select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f", -1)).alias("page", "_text"))
    lines = pages.select("doc_id", "source", (F.col("page") + 1).alias("page"), F.posexplode(F.split("_text", "\n", -1)).alias("_line", "text")).where(F.col("text").rlike(rf"[^{SPACE_CLASS}]"))
    own, whole = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    several = F.max("page").over(whole) > F.min("page").over(whole)
    top, last = F.col("_line") == F.min("_line").over(own), F.col("_line") == F.max("_line").over(own)
    y0 = F.when(several & top, 20.0).when(several & last, 760.0).otherwise(100.0)
    placed = lines.withColumn("y0", y0).withColumn("ordinal", F.call_function("shiftleft", F.col("page").cast("long") - 1, F.lit(32)) + F.col("_line"))
    return placed.select(
        "doc_id", "source", "ordinal", "page", F.lit(50.0).alias("x0"), "y0", F.lit(560.0).alias("x1"), (F.col("y0") + 12).alias("y1"), F.lit(11.0).alias("font_size"), F.lit(False).alias("bold"),
        "text", F.lit("paragraph").alias("kind"), stable_id("doc_id", "page", "_line").alias("id"), F.lit("native").alias("extraction"), F.lit(None).cast("double").alias("confidence"),
    )


def parsed_elements(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Elements of a parser (schema ELEMENTS) with their box as columns and their document's source; tables that aren't sound go, others get a header."""
    box = [F.coalesce(F.try_element_at("bbox", F.lit(i + 1)), F.lit(0.0)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    rows = found.where("kind <> 'failure'").select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce("page", F.lit(1)).alias("page"), *box, F.coalesce("font_size", F.lit(11.0)).alias("font_size"), F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("kind", F.lit("paragraph")).alias("kind"),
        F.coalesce("id", stable_id("doc_id", "ordinal")).alias("id"), F.coalesce("extraction", F.lit("native")).alias("extraction"), "confidence", "rows", "row_boxes", F.col("header").alias("_given"), F.coalesce("table_id", F.col("id"), stable_id("doc_id", "ordinal")).alias("table_id"),
    )
    tables = layout.header_row(layout.sound_tables(rows.where("kind = 'table' AND size(rows) > 0"))).withColumn("header", F.coalesce("_given", "header"))
    plain = rows.where("kind <> 'table'").withColumn("header", F.lit(None).cast("array<string>")).withColumn("table_id", F.lit(None).cast("string"))
    return plain.unionByName(tables).drop("_given").join(documents.select(F.col("id").alias("doc_id"), "source"), "doc_id")


def structured(raw: DataFrame, documents: DataFrame | None = None, bookmarks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Elements with raw_kind, kind, level, excluded, section_id and section_path (null for excluded ones); and the sections, below a root named
    by the document's title."""
    rows = raw if "raw_kind" in raw.columns else raw.withColumn("raw_kind", F.col("kind"))
    # each step joins what it was given several times: its rows are kept, else every join would run all steps before it anew
    found = kept(layout.drop_contents(kept(layout.headings(kept(layout.boilerplate(rows)), bookmarks))))
    if documents is None:
        titled = found.withColumn("title", basename(F.col("source")))
    else:
        titled = found.join(documents.select(F.col("id").alias("doc_id"), "title"), "doc_id")
    placed, sections = section_tree(titled)
    return placed.unionByName(titled.where("excluded"), allowMissingColumns=True), sections


def _text_chunks(elements: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of what isn't a table; none spans one."""
    before = F.count_if(F.col("kind") == "table").over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0))
    parted = elements.withColumn("section_id", F.concat_ws("#", "section_id", before.cast("string"))).where("kind <> 'table'")
    packed = chunking.pack(parted, max_tokens, min(80, max_tokens))
    return packed.withColumn("section_id", F.regexp_replace("section_id", "#[0-9]+$", "")).select("doc_id", F.lit("text").alias("kind"), "section_id", "text", "first", "last", "token_count", F.col("chunk").cast("long").alias("_part"), F.lit(None).cast("string").alias("table_id"), F.lit(None).cast("array<int>").alias("row_range"), F.lit(False).alias("row_fragment"), F.lit(None).cast("array<double>").alias("_box"))


def _table_chunks(elements: DataFrame, max_tokens: int) -> DataFrame:
    """Chunks of tables, each with its rows' numbers and the box around them."""
    tables = elements.where("kind = 'table'").select("doc_id", "ordinal", "section_id", "table_id", "header", "rows", "row_boxes", F.struct("doc_id", "ordinal").alias("_key"))
    cut = chunking.table_chunks(tables.select(F.col("_key").alias("doc_id"), "header", "rows"), max_tokens).withColumnRenamed("doc_id", "_key")
    joined = cut.withColumnRenamed("chunk", "_part").join(tables.select("_key", "doc_id", "ordinal", "section_id", "table_id", "row_boxes"), "_key")
    boxes = F.slice("row_boxes", F.col("first_row"), F.greatest(F.col("last_row") - F.col("first_row") + 1, F.lit(0)))
    edge = lambda f, i: f(F.transform(boxes, lambda b: F.try_element_at(b, F.lit(i))))
    around = F.when(F.size(boxes) > 0, F.array(edge(F.array_min, 1), edge(F.array_min, 2), edge(F.array_max, 3), edge(F.array_max, 4)))
    return joined.select("doc_id", F.lit("table").alias("kind"), "section_id", "text", F.col("ordinal").alias("first"), F.col("ordinal").alias("last"), "token_count", F.col("_part").cast("long").alias("_part"), "table_id", F.array("first_row", "last_row").alias("row_range"), "row_fragment", around.alias("_box"))


def chunked_elements(elements: DataFrame, documents: DataFrame, max_tokens: int = 384, pages: DataFrame | None = None, embedder=None, threshold: float = 0.35) -> DataFrame:
    """Chunks of structured elements that aren't excluded, with context (title > section path), section_path, citations, element_ids and needs_review.

    documents: id, title, category. pages: the pages' warnings. embedder: topic breaks by its vectors end chunks too."""
    for name, kind in _OPTIONAL.items():
        if name not in elements.columns:
            elements = elements.withColumn(name, F.lit(None).cast(kind))
    elements = elements.where("NOT excluded")
    if embedder is not None:
        prose = elements.where(F.col("kind").isin("paragraph", "list_item")).select(F.struct("doc_id", "ordinal").alias("id"), "text")
        vectors = dense.encode_long(prose, embedder).select("id.doc_id", "id.ordinal", "vector")
        elements = chunking.topic_breaks(elements, vectors, threshold)
    every = _text_chunks(elements, max_tokens)
    if not elements.where("kind = 'table'").isEmpty():  # plain text has none
        every = every.unionByName(_table_chunks(elements, max_tokens))
    every = kept(every)
    placed = every.withColumn("chunk", (F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "_part")) - 1).cast("int")).drop("_part")
    cited = chunking.with_citations(kept(chunking.with_ids(placed)), elements.withColumn("bbox", F.array("x0", "y0", "x1", "y1")), pages)
    cited = cited.withColumn("citations", F.when(F.col("_box").isNotNull(), F.transform("citations", lambda c: c.withField("bbox", F.col("_box")))).otherwise(F.col("citations"))).drop("_box")
    paths = elements.groupBy("doc_id", "section_id").agg(F.min_by("section_path", "ordinal").alias("section_path"))
    titles = documents.select(F.col("id").alias("doc_id"), "category", F.col("title").alias("_title"))
    out = cited.join(paths, ["doc_id", "section_id"], "left").join(titles, "doc_id")
    how = F.lit("structure" if embedder is None else "structure+embedding")
    return out.withColumn("context", F.concat_ws(" > ", "_title", "section_path")).withColumn("chunking", how).drop("_title")


def corpus(raw: DataFrame, documents: DataFrame, max_tokens: int = 384, bookmarks: DataFrame | None = None, images: DataFrame | None = None, embedder=None, threshold: float = 0.35) -> Corpus:
    """All datasets of raw elements and their documents (id, source, title, category). The structure is computed once and kept."""
    raw = kept(raw)
    placed, sections = structured(raw, documents, bookmarks)
    elements = kept(placed)
    pages = kept(layout.page_quality(raw, images))
    chunks = kept(chunked_elements(elements, documents, max_tokens, pages, embedder, threshold))
    return Corpus(documents, elements, sections.select("doc_id", "id", "title", "level", "parent_id", "page", "path"), chunks, pages)


def rechunked(elements: DataFrame, documents: DataFrame, sections: DataFrame, pages: DataFrame, max_tokens: int = 384, embedder=None, threshold: float = 0.35) -> Corpus:
    """Stored elements chunked anew; their structure stays."""
    return Corpus(documents, elements, sections, kept(chunked_elements(elements, documents, max_tokens, pages, embedder, threshold)), pages)
