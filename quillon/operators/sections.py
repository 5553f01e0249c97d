"""The section tree above elements in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id

LEVELS = 6


def section_tree(elements: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """Elements (doc_id, ordinal, id, kind, level, text, page, excluded; title) with section_id and section_path, and the sections.

    The section of an element is the last heading of each level that no higher heading has ended since. Instead of a stack,
    the last heading of each level is carried along by a window; one is open if it came after the last of every lower level."""
    rows = elements.where(~F.col("excluded"))
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, LEVELS + 1):
        own = F.when((F.col("kind") == "heading") & (F.col("level") == n), F.struct("ordinal", "id", "text", F.lit(n).alias("level"), "page"))
        rows = rows.withColumn(f"_h{n}", F.last(own, ignorenulls=True).over(w))
    live, latest = [], None
    for n in range(1, LEVELS + 1):
        at = F.col(f"_h{n}.ordinal")
        live.append(F.when(at.isNotNull() if latest is None else at > latest, F.col(f"_h{n}")))
        latest = F.coalesce(at, F.lit(-1)) if latest is None else F.greatest(latest, F.coalesce(at, F.lit(-1)))
    rows = rows.withColumn("_open", F.array_compact(F.array(*live))).drop(*[f"_h{n}" for n in range(1, LEVELS + 1)])
    of = lambda x: stable_id("doc_id", x, F.lit("section"))
    root = stable_id("doc_id", F.lit("root"))
    placed = rows.withColumn("section_id", F.when(F.size("_open") > 0, of(F.element_at("_open", -1).id)).otherwise(root)).withColumn("section_path", F.transform("_open", lambda x: x.text))
    heads = placed.where("kind = 'heading'")
    parent = F.when(F.size("_open") > 1, of(F.try_element_at("_open", F.lit(-2)).id)).otherwise(root)
    sections = heads.select("doc_id", F.col("section_id").alias("id"), F.col("text").alias("title"), "level", parent.alias("parent_id"), "page", F.col("section_path").alias("path"), "ordinal")
    top = elements.groupBy("doc_id").agg(F.first(title).alias("title") if title in elements.columns else F.first(F.col("doc_id").cast("string")).alias("title"))
    roots = top.select("doc_id", root.alias("id"), "title", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("page"), F.array().cast("array<string>").alias("path"), F.lit(-1).alias("ordinal"))
    return placed.drop("_open"), sections.unionByName(roots)
