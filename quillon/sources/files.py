"""File sources: binary documents with manifests, JSON cases, stored elements."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import basename, clean, normalized, stable_id

MANIFEST = (
    "id string, category string, title string, organization string, source_url string, download_url string, filename string, "
    "file_size_bytes long, sha256 string, page_count int, pdf_type string, notes string"
)


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, sha256, doc_id, content, category) of a file, or of all files below a folder that match; an error if there are none.

    A document's id comes from its bytes alone, so equal files are one document. The category is the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    if files.select("path").isEmpty():
        raise ValueError(f"no {pattern} in {path}")
    found = files.select("path", F.sha2("content", 256).alias("sha256"), "content", F.element_at(F.split("path", "/"), -2).alias("category"))
    return found.withColumn("doc_id", stable_id("sha256")).sort("path")


def with_manifest(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """docs (path, category) with the manifest's row of the same file name; the folder's name stands in for the category only where
    there is no row at all. title: the manifest's, else the document's own, else the file's stem."""
    rows = manifest.dropDuplicates(["filename"])
    m = F.struct(*rows.columns).alias("manifest")
    joined = docs.join(rows.select(F.col("filename").alias("_file"), m), basename(docs["path"]) == F.col("_file"), "left").drop("_file")
    own = F.col("title") if "title" in docs.columns else F.lit(None)
    return joined.withColumn("category", F.when(F.col("manifest").isNotNull(), F.coalesce("manifest.category", F.lit(""))).otherwise(F.col("category"))).withColumn("title", title(F.col("manifest.title"), own, F.col("path")))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(folder, and the fields of MANIFEST) of every manifest.json below a folder, and in the two folders above it."""
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(path.rstrip("/"))
    fs = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = fs.makeQualified(start)
    if fs.exists(start) and not fs.getFileStatus(start).isDirectory():
        start = start.getParent()
    places, at = [], start.getParent()
    for _ in range(2):
        if at is None:
            break
        if fs.exists(file := jvm.org.apache.hadoop.fs.Path(at, "manifest.json")):
            places.append(file.toString())
        at = at.getParent()
    reader = lambda: spark.read.schema(MANIFEST).option("multiLine", True)
    rows = reader().option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(start.toString())
    rows = rows.select(F.col("_metadata.file_path").alias("_file"), "*")
    for file in places:
        rows = rows.unionByName(reader().json(file).select(F.col("_metadata.file_path").alias("_file"), "*"))
    return rows.select(F.regexp_replace("_file", "/[^/]*$", "").alias("folder"), *[c for c in rows.columns if c != "_file"])


def plain_path(path: Column) -> Column:
    """A path without scheme and authority, so that equal places compare equal however they were named."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def with_nearest_manifest(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """docs (path, category) with the row that the nearest manifest has for the file: of the folders above a path the deepest that has a manifest counts,
    filenames are relative to it. Without a row there the folder's name is the category. title as in with_manifest.

    A path meets manifests by the folders above it, one row each, so this is an equi-join; the deepest is taken by max_by."""
    path = plain_path(F.col("path"))
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("name")))
    places = docs.select("path", F.explode(above).alias("a")).select("path", "a.depth", "a.folder", "a.name")
    rows = manifests.withColumn("folder", plain_path(F.col("folder"))).dropDuplicates(["folder", "filename"])
    governed = places.join(rows.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by(F.struct("folder", "name"), "depth").alias("at")).select("path", "at.folder", F.col("at.name").alias("filename"))
    fields = [c for c in rows.columns if c != "folder"]
    found = governed.join(rows, ["folder", "filename"]).select("path", F.struct(*fields).alias("manifest"))
    joined = docs.join(found, "path", "left")
    own = F.col("title") if "title" in docs.columns else F.lit(None)
    return joined.withColumn("category", F.when(F.col("manifest").isNotNull(), F.coalesce("manifest.category", F.lit(""))).otherwise(F.col("category"))).withColumn("title", title(F.col("manifest.title"), own, F.col("path")))


def title(manifest: Column, own: Column, path: Column) -> Column:
    """Title precedence: manifest, then the document's metadata, then the stem of the file name."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(manifest, F.lit("")), F.nullif(clean(own.cast("string")), F.lit("")), stem)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path, multiLine=True)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON lines file. A term of answer_evidence is one wording or a list of alternatives; blank lines are
    skipped; no case at all is an error."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    fields = schema.CASES.replace("answer_evidence array<array<string>>", "answer_evidence array<string>")
    cases = raw.select(F.from_json("value", fields).alias("c")).select("c.*")
    # a list inside answer_evidence reaches us as its JSON text
    term = lambda t: F.when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))
    cases = cases.withColumn("answer_evidence", F.transform("answer_evidence", term))
    if cases.isEmpty():
        raise ValueError(f"no cases in {path}")
    return cases


def parsed(docs: DataFrame, parser: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Elements of binary documents by a parser that is plugged in: bytes -> dicts with the fields of an element.

    A document that the parser fails on gives one excluded element that holds the error, so that one bad file doesn't end a job."""
    names = [f.split()[0] for f in schema.ELEMENTS.split(", ")]

    def run(it):
        import pyarrow as pa

        for batch in it:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [{"excluded": False, **e, "doc_id": doc, "ordinal": i} for i, e in enumerate(parser(content))]
                except Exception as e:
                    rows.append({"doc_id": doc, "ordinal": 0, "kind": "failure", "text": f"{type(e).__name__}: {e}", "excluded": True})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema.ELEMENTS))
    return docs.select("doc_id", "content").mapInArrow(run, schema.ELEMENTS)


def failures(found: DataFrame) -> DataFrame:
    """(doc_id, error) of documents that a parser failed on."""
    return found.where("kind = 'failure'").select("doc_id", F.col("text").alias("error"))


def outlines(found: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, page, key, level) of parsed elements of kind `bookmark` (page, level, text): the key is the heading without all but letters
    and digits, longer than 3 characters; of several on a page that read alike the last counts."""
    marks = found.where("kind = 'bookmark'").select("doc_id", "page", normalized(F.col("text")).alias("key"), F.greatest("level", F.lit(1)).alias("level"), "ordinal")
    return marks.where(F.length("key") > 3).groupBy("doc_id", "page", "key").agg(F.max_by("level", "ordinal").cast("int").alias("level"))
