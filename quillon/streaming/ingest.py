"""Incremental ingest of documents as they arrive: an extension, micro-batches into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators import structure
from ..operators.store import Store


def corpus_of(docs: DataFrame, max_tokens: int = 384) -> structure.Corpus:
    """All datasets of plain text rows (doc_id, text, source)."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source")
    ids = docs.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "doc_id").alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "text", basename(F.col("source")).alias("title"), F.col("source").alias("category"))
    return structure.corpus(structure.text_elements(docs), ids, max_tokens)


def chunked(docs: DataFrame, max_tokens: int = 384) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, sections and chunks (with context, section path and citations) of plain text rows (doc_id, text, source)."""
    made = corpus_of(docs, max_tokens)
    return made.documents, made.sections, made.chunks


def ingest(stream: DataFrame, store: Store, checkpoint: str, max_tokens: int = 384):
    """Start a query that puts each micro-batch of a stream of documents (doc_id, text, source) into the store. A batch that is run again after a failure
    replaces the same documents, so its effect is that of one run; what it writes follows the batch, not the store."""

    def one(batch: DataFrame, _: int) -> None:
        last = batch.dropDuplicates(["doc_id"])
        if not last.isEmpty():
            made = corpus_of(last, max_tokens)
            store.upsert(made.documents, made.sections, made.chunks, elements=made.elements, pages=made.pages)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
