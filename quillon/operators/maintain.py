"""Renewal of stored structure and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout


def raw_elements(elements: DataFrame, documents: DataFrame, hashes: DataFrame) -> DataFrame:
    """Stored elements as they came from the parser, of documents whose file is unchanged.

    documents: id, sha256; hashes: id, sha256 of the files now. A changed file is an error, as its elements are not those of the file."""
    changed = documents.join(hashes.withColumnRenamed("sha256", "_now"), "id").where("sha256 <> _now")
    if not changed.isEmpty():
        raise ValueError("a source has changed; parse it again")
    made = ("excluded", "page_count", "section_id", "section_path", "title", "topic")
    return elements.withColumn("kind", F.coalesce("raw_kind", "kind")).drop(*made).withColumn("level", F.lit(0))


def refresh_structure(elements: DataFrame, documents: DataFrame, hashes: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """raw_elements structured anew: boilerplate, headings, contents pages."""
    return layout.drop_contents(layout.headings(layout.boilerplate(raw_elements(elements, documents, hashes)), bookmarks))


def active_revisions(history: DataFrame) -> DataFrame:
    """(source, id, revision): the newest revision of each source of a history of documents (id, source, revision)."""
    return history.groupBy("source").agg(F.max_by(F.struct("id", "revision"), "revision").alias("_r")).select("source", "_r.id", "_r.revision")


def stale_rows(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Rows (doc_id, revision) of exports that keep every revision, of those that aren't the newest of their source."""
    return rows.join(active_revisions(history).select(F.col("id").alias("doc_id"), "revision"), ["doc_id", "revision"], "left_anti")


def refresh_metadata(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """documents (id, source, metadata map) with the manifest's values over their own, by file name; others keep theirs."""
    from ..functions.text import basename

    names = [c for c in manifest.columns if c != "filename"]
    pairs = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(c).cast("string") for c in names])), lambda _, v: v.isNotNull())
    rows = manifest.dropDuplicates(["filename"]).select(F.col("filename").alias("_file"), pairs.alias("_new"))
    joined = documents.join(rows, basename(F.col("source")) == F.col("_file"), "left")
    kept = F.map_filter("metadata", lambda k, _: ~F.map_contains_key(F.coalesce("_new", F.create_map().cast("map<string,string>")), k))
    return joined.withColumn("metadata", F.map_concat(kept, F.coalesce("_new", F.create_map().cast("map<string,string>")))).drop("_file", "_new")
