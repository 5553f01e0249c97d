"""A store of append-only deltas: documents, elements, sections, chunks, postings, lengths, vectors and pages of ingested files."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexical import chunk_lengths, postings

#: Dataset -> the column that holds its document's id.
DATASETS = {"documents": "id", "elements": "doc_id", "sections": "doc_id", "chunks": "doc_id", "postings": "doc_id", "lengths": "doc_id", "vectors": "doc_id", "pages": "doc_id"}
#: The dataset of tombstones.
REMOVED = "removed"


def without(old: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of a dataset whose document isn't among ids (id)."""
    return old.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti")


def replaced_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of old documents that new ones take the place of: the same source, or the same id. Two equi-joins, not one on either."""
    return old.join(new.select("source").distinct(), "source", "left_semi").select("id").unionByName(old.join(new.select("id").distinct(), "id", "left_semi").select("id")).distinct()


class Store:
    """Deltas below a folder, named by numbered manifests.

    A write appends one delta a dataset, parted by a hash of the document's id, and tombstones for the documents that it replaces or removes; a
    tombstone hides rows of earlier revisions. Then it creates the next manifest, never over one that is there: of two writers the second finds
    its number taken, takes what it replaces from the new state, and tries again with the same delta. Readers take the newest manifest and see
    whole revisions only. What a write costs follows what is written, not what the store holds; `compact` makes one delta of all, `vacuum`
    removes files that no kept manifest names. The file system has to rename without overwriting, as HDFS does."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, compact_after: int = 200):
        self.spark, self.root, self.buckets, self.compact_after = spark, root.rstrip("/"), buckets, compact_after
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # manifests

    def _names(self, folder: str, pattern: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(x for x in names if re.fullmatch(pattern, x))

    def _versions(self) -> list[str]:
        return self._names("manifests", r"\d{20}\.json")

    def _manifest(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def settings(self) -> dict:
        """The newest manifest: version, embedding_model, deltas, removed, schemas; empty before the first write."""
        found = self._versions()
        return self._manifest(found[-1]) if found else {}

    def _publish(self, manifest: dict) -> bool:
        """Create the manifest of its version; false if there is one already."""
        folder = f"{self.root}/manifests"
        self._fs.mkdirs(self._path(folder))
        tmp = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        from py4j.protocol import Py4JJavaError

        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self._conf).rename(tmp, self._path(f"{folder}/{manifest['version']:020d}.json"), options)
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # reading

    def _rows(self, held: dict, dataset: str) -> DataFrame:
        """All rows of a dataset's deltas with `delta` and `bucket`; an error if the store never had it."""
        schema = T.StructType.fromJson(json.loads(held["schemas"][dataset])).add("delta", T.StringType()).add("bucket", T.IntegerType())
        paths = [f"{self.root}/{dataset}/delta={d['name']}" for d in held["removed" if dataset == REMOVED else "deltas"] if dataset in d["datasets"]]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{dataset}").parquet(*paths)

    def _revision(self, held: dict):
        """Which revision wrote a delta, by its name: a map of as many entries as there were writes since the last compaction."""
        known = {d["name"]: d["revision"] for d in held["deltas"] + held["removed"]}
        return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("delta"))

    def _history(self, held: dict, dataset: str) -> DataFrame:
        rows = self._rows(held, dataset).withColumn("revision", self._revision(held).cast("long")).drop("delta", "bucket")
        if not held["removed"]:
            return rows.withColumn("active", F.lit(True))
        gone = self._rows(held, REMOVED).withColumn("_gone", self._revision(held)).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_gone").alias("_gone"))
        joined = rows.join(gone, F.col(DATASETS[dataset]).cast("string") == F.col("_doc"), "left")
        return joined.withColumn("active", F.col("revision") >= F.coalesce("_gone", F.lit(0))).drop("_doc", "_gone")

    def _held(self) -> dict:
        held = self.settings()
        if not held:
            raise FileNotFoundError(f"no store in {self.root}")
        return held

    def has(self, dataset: str) -> bool:
        return dataset in self.settings().get("schemas", {})

    def history(self, dataset: str) -> DataFrame:
        """Every row since the last compaction, with revision (the number of its write) and active (no later write replaced or removed it)."""
        return self._history(self._held(), dataset)

    def read(self, dataset: str, held: dict | None = None) -> DataFrame:
        """The rows of a dataset as they are now."""
        held = held or self._held()
        if dataset not in held["schemas"]:
            raise FileNotFoundError(f"the store in {self.root} has no {dataset}")
        return self._history(held, dataset).where("active").drop("active", "revision")

    # writing

    def _append(self, dataset: str, df: DataFrame, name: str) -> None:
        key = "doc_id" if dataset == REMOVED else DATASETS[dataset]
        parted = df.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int"))
        # a large bucket is split into several files
        parted.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.root}/{dataset}/delta={name}")

    def _append_all(self, tables: dict[str, DataFrame], name: str) -> None:
        """Datasets side by side: each is a job of its own."""
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda x: self._append(x[0], x[1], name), tables.items()))

    def _commit(self, tables: dict[str, DataFrame], check: Callable[[dict], tuple[DataFrame | None, str | None]], attempts: int = 20) -> int:
        """Append tables, then publish them. check(manifest) says, for the state that the write meets, which ids (id) it removes and the
        store's model, or raises. The version that was written."""
        name, written = f"d{uuid.uuid4().hex}", False
        for _ in range(attempts):
            held = self.settings()
            version = held.get("version", 0) + 1
            gone, model = check(held)
            if not written:
                self._append_all(tables, name)
                written = True
            schemas = dict(held.get("schemas", {}))
            for dataset, df in tables.items():
                fields = T.StructType.fromJson(json.loads(schemas[dataset])).fields if dataset in schemas else []
                known = {f.name for f in fields}
                schemas[dataset] = T.StructType([*fields, *(f for f in df.schema.fields if f.name not in known)]).json()
            manifest = {"version": version, "embedding_model": model, "deltas": held.get("deltas", []), "removed": held.get("removed", []), "schemas": schemas}
            if tables:
                manifest["deltas"] = [*manifest["deltas"], {"name": name, "revision": version, "datasets": sorted(tables)}]
            if gone is not None:
                tomb = f"d{uuid.uuid4().hex}"
                ids = gone.select(F.col("id").cast("string").alias("doc_id")).distinct()
                self._append(REMOVED, ids, tomb)
                schemas[REMOVED] = ids.schema.json()
                manifest["removed"] = [*manifest["removed"], {"name": tomb, "revision": version, "datasets": [REMOVED]}]
            if self._publish(manifest):
                return version
        raise RuntimeError(f"{attempts} other writers came first")

    def upsert(self, documents: DataFrame, sections: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, model: str | None = None, elements: DataFrame | None = None, pages: DataFrame | None = None) -> int:
        """Put documents (id, source, ...) with their sections and chunks (id, doc_id, context, text, ...), and elements and pages where given,
        in place of those of the same source or id. The version that was written.

        Errors, before anything is published: chunks of other documents, chunk ids twice, vectors that don't match the chunks or hold other
        than finite values, a model that isn't the store's, vectors missing in a store that has them, vectors in one that hasn't."""
        if not chunks.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").isEmpty():
            raise ValueError("chunks of documents that aren't given")
        if not chunks.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("chunk ids must be unique")
        if vectors is not None:
            from .dense import check_vectors

            first = vectors.select(F.size("vector")).first()
            check_vectors(vectors, first[0] if first else 0)
            if chunks.count() != vectors.join(chunks.select("id"), "id", "left_semi").count():
                raise ValueError("one vector a chunk is needed")
        by_doc = chunks.select("id", "doc_id")
        tables = {"documents": documents, "sections": sections, "chunks": chunks, "postings": postings(chunks, "doc_id"), "lengths": chunk_lengths(chunks, "doc_id")}
        tables |= {d: df for d, df in (("vectors", vectors), ("elements", elements), ("pages", pages)) if df is not None}

        def check(held: dict):
            known = held.get("embedding_model")
            if known and model and known != model:
                raise ValueError(f"the store holds vectors of {known}, not of {model}")
            if known and vectors is None:
                raise ValueError(f"the store holds vectors of {known}; give vectors")
            if not held:
                return None, model if vectors is not None else None
            if not known and vectors is not None and not self.read("chunks", held).isEmpty():
                raise ValueError("the store has chunks without vectors; build a new one")
            gone = replaced_ids(self.read("documents", held).select("id", "source"), documents.select("id", "source"))
            if not without(self.read("chunks", held).select("id", "doc_id"), "doc_id", gone).join(by_doc.select("id"), "id", "left_semi").isEmpty():
                raise ValueError("chunk ids must be unique")
            return gone, model if vectors is not None else known

        version = self._commit(tables, check)
        if len(self.settings()["deltas"]) > self.compact_after:
            self.compact()
        return version

    def delete(self, ids: DataFrame) -> int:
        """Remove documents (id) from all datasets."""
        self._held()
        return self._commit({}, lambda held: (ids, held.get("embedding_model")))

    def compact(self) -> int:
        """One delta of all rows as they are, without tombstones; what was replaced is no longer in the history. If another write comes
        between, nothing is lost: it is done anew."""
        while True:
            held, name = self._held(), f"d{uuid.uuid4().hex}"
            kept = [d for d in held["schemas"] if d != REMOVED]
            self._append_all({d: self.read(d, held) for d in kept}, name)
            version = held["version"] + 1
            schemas = {d: s for d, s in held["schemas"].items() if d != REMOVED}
            if self._publish(held | {"version": version, "deltas": [{"name": name, "revision": version, "datasets": sorted(kept)}], "removed": [], "schemas": schemas}):
                return version

    def vacuum(self, keep: int = 1) -> int:
        """Remove deltas that none of the newest `keep` manifests names, and older manifests; how many deltas went. No write may be under way."""
        found = self._versions()
        used = {(x, d["name"]) for m in map(self._manifest, found[-keep:]) for d in m["deltas"] + m["removed"] for x in d["datasets"]}
        gone = [f"{x}/{n}" for x in (*DATASETS, REMOVED) for n in self._names(x, r"delta=.*") if (x, n.removeprefix("delta=")) not in used]
        for name in [*gone, *(f"manifests/{m}" for m in found[:-keep])]:
            self._fs.delete(self._path(f"{self.root}/{name}"), True)
        return len(gone)

    def stats(self) -> dict:
        """Numbers of documents, sections and chunks, and the embedding model."""
        held = self._held()
        return {d: self.read(d, held).count() for d in ("documents", "sections", "chunks")} | {"embedding_model": held.get("embedding_model")}
