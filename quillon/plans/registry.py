"""The registered queries over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, dense, evaluate, fusion, layout, lexical, search, sections, store
from ..sources import files
from ..sources import tables as S
from ..sources.scratch import kept, new_folder, written
from . import sql as Q

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.document_lines(S.read(spark, d, "documents", "doc_id", "text", "source"))


def _layout(spark: SparkSession, d: str) -> DataFrame:
    return S.synthetic_layout(_lines(spark, d))


def _structured(spark: SparkSession, d: str) -> DataFrame:
    return layout.headings(layout.boilerplate(_layout(spark, d)))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: id, doc_id, category, context (the source) and text."""
    return S.read(spark, d, "documents", "doc_id", "text", "source").select(F.col("doc_id").alias("id"), "doc_id", F.col("source").alias("category"), F.col("source").alias("context"), "text")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ingest_seq"), F.col("embedding").alias("vector"), F.col("label").alias("category"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries of a search: every vector whose id is divisible by 50."""
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@_query(f"SELECT doc_id, {Q.tokens('text')} AS tokens, {Q.units('text')} AS units FROM documents")
def token_count(spark, d):
    docs = S.read(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"), X.unit_count(F.col("text")).cast("long").alias("units"))


@_query("SELECT doc_id, substr(sha256(coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 24) AS id FROM documents")
def stable_ids(spark, d):
    return S.read(spark, d, "documents", "doc_id", "text", "source").select("doc_id", X.stable_id("source", "text").alias("id"))


@_query(f"SELECT doc_id, ordinal, {Q.margin_key('text')} AS margin_key, {Q.fold(Q.rx('text', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]+', ''))} AS normalized FROM ({Q.LINES})")
def margin_keys(spark, d):
    return _lines(spark, d).select("doc_id", "ordinal", X.margin_key(F.col("text"), False).alias("margin_key"), X.normalized(F.col("text")).alias("normalized"))


@_query(f"SELECT doc_id, ordinal, category, text FROM ({Q.LINES})")
def line_elements(spark, d):
    return _lines(spark, d)


@_query("SELECT doc_id, sha256(text) AS joined_sha256, 0 AS over FROM documents")
def split_text_parts(spark, d):
    parts = S.read(spark, d, "documents", "doc_id", "text").select("doc_id", X.split_parts(F.col("text"), 100).alias("parts"))
    return parts.select("doc_id", F.sha2(F.array_join("parts", ""), 256).alias("joined_sha256"), F.size(F.filter("parts", lambda p: X.token_count(p) > 100)).alias("over"))


@_query()
def html_elements(spark, d):
    return S.html_elements(S.read(spark, d, "pages", "page_id", "url", "html"))


@_query(Q.TURNS)
def conversation_sections(spark, d):
    return S.conversation_elements(S.read(spark, d, "conversations", "conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "section")


@_query()
def chunk_pack(spark, d):
    return chunking.with_ids(chunking.pack(_lines(spark, d)))


@_query(Q.PACKED + "SELECT doc_id, chunk, first, last, n, token_count, md5(text) AS text_md5 FROM chunks")
def chunk_pack_lines(spark, d):
    return chunking.pack(_lines(spark, d), split=False).select("doc_id", "chunk", "first", "last", "n", "token_count", F.md5("text").alias("text_md5"))


@_query(Q.PACKED + "SELECT doc_id, chunk, id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM (SELECT *, substr(sha256(doc_id || chr(0) || '' || chr(0) || chunk || chr(0) || text), 1, 24) AS id FROM chunks) WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)")
def chunk_neighbors(spark, d):
    return chunking.with_ids(chunking.pack(_lines(spark, d), split=False)).select("doc_id", "chunk", "id", "previous_id", "next_id")


@_query(Q.PACKED + f"""SELECT count(*) AS chunks, coalesce(sum(token_count), 0) AS tokens, round(coalesce(avg(token_count), 0), 2) AS mean_tokens, coalesce(min(token_count), 0) AS min_tokens,
coalesce(max(token_count), 0) AS max_tokens, coalesce(sum(token_count + 1), 0) AS context_tokens, round(coalesce(avg(token_count + 1), 0), 2) AS mean_context_tokens FROM chunks""")
def chunk_metrics(spark, d):
    return evaluate.chunk_metrics(chunking.pack(_lines(spark, d), split=False).withColumn("context", F.col("doc_id").cast("string")))


@_query(Q.PACKED + "SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM chunks GROUP BY doc_id")
def ingest_report(spark, d):
    return evaluate.document_report(chunking.pack(_lines(spark, d), split=False)).select("doc_id", "chunks", "tokens")


@_query(Q.PACKED + f"""SELECT c.doc_id, c.chunk, count(DISTINCT ordinal // 40) AS n_citations, count(*) AS n_elements, min(ordinal // 40) + 1 AS first_page, bool_or(ordinal // 40 = 2) AS needs_review
FROM chunks c JOIN ({Q.LINES}) l ON l.doc_id = c.doc_id AND l.ordinal BETWEEN c.first AND c.last GROUP BY c.doc_id, c.chunk""")
def citations(spark, d):
    lines = _lines(spark, d)
    page = (F.floor(F.col("ordinal") / 40) + 1).cast("int")
    elements = lines.select("doc_id", "ordinal", X.stable_id("doc_id", "ordinal").alias("id"), F.col("category").alias("source"), page.alias("page"), F.array(F.lit(0.0)).alias("bbox"), F.lit("native").alias("extraction"), F.lit(1.0).alias("confidence"))
    pages = elements.select("doc_id", "page").distinct().withColumn("warnings", F.when(F.col("page") == 3, F.array(F.lit("needs_ocr"))).otherwise(F.array(F.lit("sparse_page"))))
    out = chunking.with_citations(chunking.pack(lines, split=False).select("doc_id", "chunk", "first", "last"), elements, pages)
    return out.select("doc_id", "chunk", F.size("citations").cast("long").alias("n_citations"), F.size("element_ids").cast("long").alias("n_elements"), F.element_at("citations", 1).page.cast("long").alias("first_page"), "needs_review")


@_query("""WITH hits AS (SELECT item_id, r, 'd' || (item_id + r) AS source, item_id * r % 3 + 1 AS page FROM benchmark, unnest([1, 2, 3]) t(r)),
wanted AS (SELECT item_id, 'd' || (item_id + 2) AS source, unnest([1, 3]) AS page FROM benchmark),
m AS (SELECT w.item_id, min(r) AS first, count(DISTINCT CASE WHEN r IS NOT NULL THEN w.page END) AS found FROM wanted w LEFT JOIN hits h ON h.item_id = w.item_id AND h.source = w.source AND h.page = w.page GROUP BY w.item_id)
SELECT item_id AS query_id, first, found, 2 AS wanted FROM m""")
def page_eval(spark, d):
    asked = S.read(spark, d, "benchmark", "item_id").select(F.col("item_id").alias("query_id"))
    file = lambda n: F.concat(F.lit("folder/d"), n.cast("string"))
    rank = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")
    hits = asked.select("query_id", rank).select("query_id", "rank", F.array(F.struct(file(F.col("query_id") + F.col("rank")).alias("source"), (F.col("query_id") * F.col("rank") % 3 + 1).cast("int").alias("page"))).alias("citations"))
    cases = asked.select("query_id", F.array(F.struct(F.concat(F.lit("d"), (F.col("query_id") + 2).cast("string")).alias("source"), F.array(F.lit(1), F.lit(3)).alias("pages"))).alias("relevant"))
    return evaluate.page_matches(hits, cases)


@_query(Q.TABLE_CHUNKS)
def table_chunks(spark, d):
    lines = S.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return chunking.table_chunks(S.order_tables(lines), 64).select("doc_id", "chunk", "first_row", "last_row", "token_count", "row_fragment", F.md5("text").alias("text_md5"))


@_query(Q.LAYOUT + "SELECT doc_id, ordinal, page, kind, excluded FROM bounded")
def margin_boilerplate(spark, d):
    return layout.boilerplate(_layout(spark, d)).select("doc_id", "ordinal", "page", "kind", "excluded")


@_query(Q.LAYOUT + "SELECT doc_id, body, large FROM sizes")
def font_mode(spark, d):
    return layout.large_sizes(_layout(spark, d)).select("doc_id", "body", F.array_join(F.transform("large", lambda x: x.cast("string")), ",").alias("large"))


@_query(Q.LAYOUT + "SELECT doc_id, ordinal, kind, level FROM leveled")
def heading_levels(spark, d):
    return _structured(spark, d).select("doc_id", "ordinal", "kind", "level")


@_query(Q.LAYOUT + r"""SELECT doc_id, page, count(*) FILTER (regexp_matches(text, '\.{3,}\s*\p{Nd}+')) AS dotted,
count(*) FILTER (regexp_matches(text, '\.{3,}\s*\p{Nd}+')) >= 3 OR bool_or(regexp_matches(lower(text), '^(?:table of )?contents$')) AS toc FROM layout GROUP BY ALL""")
def toc_pages(spark, d):
    return layout.contents_pages(_layout(spark, d))


@_query(Q.LAYOUT + Q.SECTIONS)
def section_paths(spark, d):
    rows = _structured(spark, d).withColumn("id", X.stable_id("doc_id", "ordinal"))
    placed, _ = sections.section_tree(rows)
    return placed.select("doc_id", "ordinal", "section_id", F.array_join("section_path", " > ").alias("path"))


@_query(Q.LAYOUT + """, p AS (SELECT doc_id, page, sum(length(text)) AS characters, sum(length(text)) < 80 AS sparse, sum(length(text) - length(replace(text, chr(65533), ''))) / greatest(1, sum(length(text))) > 0.03 AS corrupt,
  CASE WHEN (doc_id + page) % 2 = 0 THEN (doc_id + page) % 10 / 10.0 END AS ratio FROM layout GROUP BY ALL),
q AS (SELECT *, coalesce(ratio IS NOT NULL AND (sparse OR ratio > 0.65 AND characters < 300), false) AS needs_ocr FROM p)
SELECT doc_id, page, characters, sparse, corrupt, needs_ocr, concat_ws(',', CASE WHEN needs_ocr THEN 'needs_ocr' WHEN ratio > 0.2 THEN 'visual_content_requires_review' END,
  CASE WHEN corrupt THEN 'replacement_characters_in_native_text' END, CASE WHEN sparse THEN 'sparse_page' END) AS warnings FROM q""")
def page_quality(spark, d):
    lines = _layout(spark, d)
    at = F.col("doc_id") + F.col("page")
    images = lines.select("doc_id", "page").distinct().where(at % 2 == 0).select("doc_id", "page", (at % 10 / 10.0).alias("region_ratio"))
    return layout.page_quality(lines, images).select("doc_id", "page", "characters", "sparse", "corrupt", "needs_ocr", F.array_join("warnings", ",").alias("warnings"))


@_query("""SELECT order_key, CASE WHEN order_key % 3 = 0 THEN 'Column 1|Column 2' WHEN order_key % 3 = 1 THEN 'Particulars|Qty' ELSE 'Rate|S. No' END AS header FROM (SELECT DISTINCT l_orderkey AS order_key FROM lineitem)""")
def table_headers(spark, d):
    keys = S.read(spark, d, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("order_key")).distinct()
    first = F.when(F.col("order_key") % 3 == 0, F.array(F.lit("Compliance"), F.lit("Price"))).when(F.col("order_key") % 3 == 1, F.array(F.lit("Particulars"), F.lit("Qty"))).otherwise(F.array(F.lit("Rate"), F.lit("S. No")))
    return layout.header_row(keys.withColumn("rows", F.array(first))).select("order_key", F.array_join("header", "|").alias("header"))


@_query("""SELECT l_orderkey AS order_key, count(*) + l_orderkey % 2 AS n_rows, CASE WHEN l_orderkey % 2 = 1 THEN 'Item|Supplier|Quantity|Amount' ELSE 'Column 1|Column 2|Column 3|Column 4' END AS header FROM lineitem GROUP BY l_orderkey""")
def sound_headers(spark, d):
    """Tables of orders, every other one without its header's row: what stands first is judged."""
    tables = S.order_tables(S.read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    bare = tables.drop("header").withColumn("rows", F.when(F.col("doc_id") % 2 == 1, F.col("rows")).otherwise(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))))
    out = layout.header_row(layout.sound_tables(bare))
    return out.select(F.col("doc_id").alias("order_key"), F.size("rows").cast("long").alias("n_rows"), F.array_join("header", "|").alias("header"))


@_query(Q.LAYOUT + Q.FRAGMENTS)
def fragment_flush(spark, d):
    out = layout.fragments(_layout(spark, d))
    return out.select("doc_id", "fragment", "page", "n", "x0", "y0", "x1", "y1", F.round("font_size", 6).alias("font_size"), "bold", F.md5("text").alias("text_md5"))


@_query()
def reading_order(spark, d):
    return layout.reading_order(_layout(spark, d))


@_query("""SELECT l_orderkey, "row", col, string_agg(t, chr(10) ORDER BY cy, cx, t) AS text FROM (
SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS t, l_quantity AS cx, l_linenumber AS cy, least(CASE WHEN l_quantity >= 50 THEN 4 WHEN l_quantity >= 40 THEN 3 WHEN l_quantity >= 25 THEN 2 WHEN l_quantity >= 10 THEN 1 ELSE 0 END, 3) AS col,
CASE WHEN l_linenumber >= 6 THEN 2 WHEN l_linenumber >= 3 THEN 1 ELSE 0 END AS "row" FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 AND l_linenumber BETWEEN 1 AND 8) GROUP BY ALL""")
def grid_assign(spark, d):
    points = S.read(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber").select("l_orderkey", F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").alias("cx"), F.col("l_linenumber").alias("cy"), F.lit(1.0).alias("confidence"))
    return layout.cell_texts(layout.assign_cells(points, [1.0, 10.0, 25.0, 40.0, 50.0], [1.0, 3.0, 6.0, 8.0]), "l_orderkey").drop("confidence")


@_query("""WITH s AS (SELECT l_suppkey, l_extendedprice AS v, CASE WHEN l_extendedprice - lag(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) <= 4.0 THEN 0 ELSE 1 END AS new FROM lineitem),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY v, new DESC ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT l_suppkey, round(avg(v), 4) AS center, count(*) AS n FROM g GROUP BY l_suppkey, g.g""")
def line_centers(spark, d):
    return layout.centers(S.read(spark, d, "lineitem", "l_suppkey", "l_extendedprice"), "l_suppkey", "l_extendedprice").select("l_suppkey", F.round("center", 4).alias("center"), "n")


@_query(Q.LAYOUT + """SELECT doc_id, ordinal FROM layout WHERE NOT ((x0 + x1) / 2 BETWEEN 300 AND 580 AND (y0 + y1) / 2 BETWEEN 100 AND 400 AND page % 2 = 1)""")
def outside_tables(spark, d):
    lines = _layout(spark, d)
    boxes = lines.select("doc_id", "page").distinct().where("page % 2 = 1").select("doc_id", "page", F.lit(300.0).alias("x0"), F.lit(100.0).alias("y0"), F.lit(580.0).alias("x1"), F.lit(400.0).alias("y1"))
    return layout.outside_tables(lines, boxes).select("doc_id", "ordinal")


@_query(f"SELECT item_id, array_to_string({Q.query_tokens('text')}, ' ') AS tokens FROM benchmark")
def query_tokens(spark, d):
    return S.read(spark, d, "benchmark", "item_id", "text").select("item_id", F.array_join(X.query_tokens(F.col("text")), " ").alias("tokens"))


@_query(Q.VARIANTS)
def query_variants(spark, d):
    asked = S.read(spark, d, "benchmark", "item_id", "text").withColumn("query", F.concat(F.lit("Please identify the OEM for "), F.substring("text", 1, 40), F.lit(" in the compliance matrix.")))
    return asked.select("item_id", F.array_join(X.query_variants(F.col("query")), "|").alias("variants"))


@_query(Q.POSTINGS + "SELECT term, count(*) AS df, sum(tf_context + tf_text) AS cf FROM postings GROUP BY term")
def term_stats(spark, d):
    return lexical.term_stats(lexical.postings(_chunks(spark, d)))


def _hits(scores: DataFrame, k: int) -> DataFrame:
    return lexical.top(scores, k, "id").select("query_id", "method", "id", "rank", F.round("score", 6).alias("score"))


@_query(Q.bm25("benchmark AS q", "q.text", "lexical", k=5))
def bm25_search(spark, d):
    chunks = _chunks(spark, d)
    return _hits(lexical.bm25_top(_asked(spark, d).withColumn("method", F.lit("lexical")), 5, chunks), 5)


@_query(Q.bm25("benchmark AS q", "q.text", "lexical", k=5, where="source = 'src0'"))
def bm25_filtered(spark, d):
    out = search.ranked_lists(_asked(spark, d), _chunks(spark, d), "lexical", 5, category="src0")
    return out.select("query_id", "method", "id", "rank", F.round("score", 6).alias("score"))


@_query(Q.BM25_VARIANTS)
def bm25_variants(spark, d):
    asked = _asked(spark, d).withColumn("text", F.concat(F.lit("Identify the EMD of "), "text"))
    out = search.ranked_lists(asked, _chunks(spark, d), "lexical", 5, variants=True)
    return out.select("query_id", "method", "id", "rank")


@_query(Q.dense(k=10))
def dense_search(spark, d):
    return dense.search(_vectors(spark, d), _vector_queries(spark, d), 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


@_query(Q.dense(k=10, where="c.label = 3"))
def dense_filtered(spark, d):
    return dense.search(_vectors(spark, d).where("category = 3"), _vector_queries(spark, d), 10).select("query_id", "id", "rank", F.round("score", 5).alias("score"))


def _both_lists(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with an embedding of their id: queries (text, vector), chunks, vectors."""
    chunks = _chunks(spark, d)
    vectors = _vectors(spark, d)
    asked = chunks.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("text"))
    asked = kept(asked.join(vectors.select(F.col("id").alias("query_id"), "vector"), "query_id"))  # few, read several times
    return asked, chunks, vectors.select("id", "ingest_seq", "vector").join(chunks.select("id"), "id", "left_semi")


@_query(Q.HYBRID)
def hybrid_rrf(spark, d):
    asked, chunks, vectors = _both_lists(spark, d)
    return search.search(asked, chunks, 5, "hybrid", 20, vectors=vectors).select("query_id", "id", "place", F.round("score", 9).alias("score"))


@_query(Q.RERANK)
def rerank(spark, d):
    asked, chunks, vectors = _both_lists(spark, d)
    out = search.search(asked, chunks, 5, "hybrid", 20, reranker=fusion.WordOverlap(), vectors=vectors)
    return out.select("query_id", "id", "place", F.round("score", 9).alias("score"), "score_type")


@_query("""WITH p AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place, 1 + vec_id % 7 AS w FROM embeddings), s AS (SELECT label, place, sum(w * CAST(x AS DOUBLE)) AS x FROM p GROUP BY ALL)
SELECT label, place, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12), 5) AS x FROM s""")
def window_pooled(spark, d):
    rows = S.read(spark, d, "embeddings", "vec_id", "embedding", "label").select(F.col("label").alias("owner"), (1 + F.col("vec_id") % 7).alias("weight"), F.col("embedding").alias("vector"))
    return dense.pooled(rows).select(F.col("owner").alias("label"), F.posexplode("vector").alias("place", "x")).select("label", "place", F.round("x", 5).alias("x"))


@_query("""SELECT vec_id, coalesce(list_inner_product(CAST(lag(embedding) OVER w AS DOUBLE[]), CAST(embedding AS DOUBLE[])) < 0.35, false) AS topic FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""")
def topic_breaks(spark, d):
    rows = S.read(spark, d, "embeddings", "vec_id", "embedding", "label")
    elements = rows.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ordinal"), F.lit("paragraph").alias("kind"))
    return chunking.topic_breaks(elements, rows.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("vector"))).select(F.col("ordinal").alias("vec_id"), "topic")


@_query(Q.EXPAND)
def expand_context(spark, d):
    turns = S.read(spark, d, "conversations", "conv_id", "turn", "text")
    chunks = turns.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.floor(F.col("turn") / 6).cast("string").alias("section_id"), X.token_count(F.col("text")).alias("token_count"))
    return chunking.expand(chunks, chunks.select("id"), 400)


@_query("""WITH old AS (SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || doc_id AS source, 'old' AS state FROM documents),
fresh AS (SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || doc_id AS source, 'new' AS state FROM documents WHERE lang = 'fr' UNION ALL SELECT 'x' || doc_id, source || '/' || doc_id, 'new' FROM documents WHERE lang = 'de')
SELECT id, source, state FROM fresh UNION ALL SELECT id, source, state FROM old WHERE id NOT IN (SELECT id FROM fresh) AND source NOT IN (SELECT source FROM fresh)""")
def upsert_merge(spark, d):
    docs = S.read(spark, d, "documents", "doc_id", "source", "lang").select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), "doc_id").alias("source"), "lang")
    old = docs.select("id", "source", F.lit("old").alias("state"))
    new = docs.where("lang = 'fr'").select("id", "source", F.lit("new").alias("state")).unionByName(docs.where("lang = 'de'").select(F.concat(F.lit("x"), "id").alias("id"), "source", F.lit("new").alias("state")))
    return store.without(old, "id", store.replaced_ids(old, new)).unionByName(new)


@_query(f"SELECT doc_id, ordinal FROM ({Q.LINES}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_cascade(spark, d):
    gone = S.read(spark, d, "labels", "doc_id", "toxic").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.without(_lines(spark, d), "doc_id", gone).select("doc_id", "ordinal")


@_query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'quality ' || quality END AS category FROM documents LEFT JOIN labels l USING (doc_id)")
def manifest_join(spark, d):
    rows = S.read(spark, d, "labels", "doc_id", "quality").withColumn("known", F.lit(True))
    docs = S.read(spark, d, "documents", "doc_id", "source").join(rows, "doc_id", "left")
    return docs.select("doc_id", F.when(F.col("known"), F.concat(F.lit("quality "), "quality")).otherwise(F.col("source")).alias("category"))


@_query(Q.EVAL)
def eval_metrics(spark, d):
    asked, docs = _asked(spark, d), S.read(spark, d, "documents", "doc_id", "text")
    pairs = _relevant(asked, docs)
    chunks = _chunks(spark, d)
    hits = lexical.top(lexical.bm25_top(asked.withColumn("method", F.lit("lexical")), 5, chunks), 5, "id")
    out = evaluate.retrieval_metrics(evaluate.first_hits(hits, pairs))
    return out.select("cases", *[F.round(c, 6).alias(c) for c in ("hit_rate", "mrr", "recall")])


def _relevant(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, id) of documents that hold a query's text as it stands, however short."""
    return evaluate.holders(asked.select("query_id", F.col("text").alias("passage")), docs.select(F.col("doc_id").alias("id"), "text"))


@_query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, n, round(avg(value), 6) AS mean, max(value) FILTER (i = (n - 1) // 2 + 1) AS p50, max(value) FILTER (i = ceil(round(0.95 * n, 9))) AS p95 FROM r GROUP BY event_type, n""")
def eval_latency(spark, d):
    return evaluate.latency(S.read(spark, d, "events", "event_type", "value"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@_query(Q.EVIDENCE)
def answer_evidence(spark, d):
    terms = F.array(F.array(F.lit("the"), F.lit("der")), F.array(F.lit("in of")), F.array(F.lit("QUE"), F.lit("les")))
    return S.read(spark, d, "benchmark", "item_id", "text").select("item_id", F.round(evaluate.evidence(terms, F.col("text")), 6).alias("evidence"))


@_query("""SELECT lang, source, count(*) AS documents, sum(n_chars) AS chars FROM documents GROUP BY lang, source""")
def corpus_report(spark, d):
    return S.read(spark, d, "documents", "lang", "source", "n_chars").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@_query(Q.BM25_PHRASES)
def bm25_phrases(spark, d):
    """Queries whose words are joined to phrases by underscores."""
    w = lambda *at: F.concat_ws("_", *[F.try_element_at("w", F.lit(i)) for i in at])
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = _asked(spark, d).withColumn("w", words).select("query_id", F.lit("lexical").alias("method"), F.concat_ws(" ", w(2, 3), w(5, 6, 7), w(9)).alias("text"))
    chunks = _chunks(spark, d)
    return _hits(lexical.bm25_top(asked, 5, chunks), 5).drop("method")


@_query(Q.ENCODE_LONG)
def encode_long(spark, d):
    texts = S.read(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    vectors = dense.encode_long(texts.where(F.col("text").rlike(rf"[^{X.SPACE_CLASS}]")), dense.Letters())
    return vectors.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("place", "x")).select("doc_id", "place", F.round("x", 6).alias("x"))


def _revised(spark, d) -> store.Store:
    """A store after three writes: all documents; the French ones anew, with another text and so another id, from the same sources; the Spanish ones removed."""
    docs = S.read(spark, d, "documents", "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat_ws("/", "source", "doc_id").alias("source"), "text")
    fresh = docs.where("lang = 'fr'").withColumn("doc_id", F.concat(F.lit("x"), "doc_id")).withColumn("text", F.concat("text", F.lit("\nRevised edition of this file.")))
    out = store.Store(spark, new_folder(spark, "store"), buckets=8)
    for rows in (docs, fresh):
        chunks = rows.select(X.stable_id("doc_id", "text").alias("id"), "doc_id", F.lit("").alias("context"), F.substring_index("text", "\n", 1).alias("text"))
        ids = rows.select(F.col("doc_id").alias("id"), "source")
        sections = rows.select("doc_id", X.stable_id("doc_id", F.lit("root")).alias("id"))
        out.upsert(ids, sections, chunks, elements=S.document_lines(rows))
    out.delete(docs.where("lang = 'es'").select(F.col("doc_id").alias("id")))
    return out


@_query(Q.REINDEX)
def reindex_active(spark, d):
    """Stored elements of the documents as they are now, chunked anew."""
    packed = chunking.pack(_revised(spark, d).read("elements"), split=False)
    return packed.select("doc_id", "chunk", "first", "last", "n", "token_count", F.md5("text").alias("text_md5"))


@_query(Q.HISTORY)
def store_history(spark, d):
    return _revised(spark, d).history("documents").select("id", "source", "revision", "active")


@_query(Q.FLAGGED)
def flagged_pages(spark, d):
    lines = _layout(spark, d)
    return evaluate.flagged_pages(layout.page_quality(lines, _images(lines))).select("doc_id", "page", "unread", F.array_join("warnings", ",").alias("warnings"))


def _images(lines: DataFrame) -> DataFrame:
    at = F.col("doc_id") + F.col("page")
    return lines.select("doc_id", "page").distinct().where(at % 2 == 0).select("doc_id", "page", (at % 10 / 10.0).alias("region_ratio"))


@_query(Q.TOTALS)
def ingest_totals(spark, d):
    lines = _layout(spark, d)
    chunks = chunking.pack(_lines(spark, d), split=False).withColumn("context", F.col("doc_id").cast("string"))
    failed = S.read(spark, d, "labels", "doc_id", "toxic").where("toxic = 1").select("doc_id", F.lit("unreadable").alias("error"))
    _, tree = sections.section_tree(_structured(spark, d).withColumn("id", X.stable_id("doc_id", "ordinal")))
    documents = S.read(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "id")
    return evaluate.ingest_totals(documents, lines, tree, chunks, layout.page_quality(lines, _images(lines)), failed)


@_query(Q.MANIFESTS)
def manifest_sources(spark, d):
    """Paths of documents and two manifests, one in the folder of a language below the other: the nearest counts."""
    docs = S.read(spark, d, "documents", "doc_id", "lang", "source")
    path = F.concat_ws("/", F.lit("file:///corpus"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    known = docs.join(S.read(spark, d, "labels", "doc_id", "quality", "toxic"), "doc_id")
    outer = known.where("quality IS NOT NULL").select(F.lit("/corpus").alias("folder"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("filename"), F.concat(F.lit("quality "), "quality").alias("category"), F.concat(F.lit("Outer "), "doc_id").alias("title"))
    inner = known.where("lang = 'fr' AND toxic = 1").select(F.lit("/corpus/fr").alias("folder"), F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("filename"), F.lit("toxic").alias("category"), F.concat(F.lit("Inner "), "doc_id").alias("title"))
    named = files.with_nearest_manifest(docs.select("doc_id", path.alias("path"), F.col("source").alias("category")), outer.unionByName(inner))
    return named.select("doc_id", "category", "title")


@_query(Q.BOOKMARKS)
def bookmark_levels(spark, d):
    lines = _layout(spark, d)
    marks = files.outlines(lines.where("ordinal % 7 < 3").select("doc_id", "page", "ordinal", "text", (1 + F.col("ordinal") % 8).cast("int").alias("level"), F.lit("bookmark").alias("kind")))
    return layout.headings(layout.boilerplate(lines), marks).select("doc_id", "ordinal", "kind", "level")


@_query(Q.PAGE_BOXES)
def page_boxes(spark, d):
    lines = _layout(spark, d)
    matrix = dict(a=F.lit(0.5), b=F.lit(0.25), c=F.lit(-0.25), d=F.lit(0.5), e=8.0 * F.col("page"), f=F.lit(16.0))
    turned = lines.select("doc_id", "page").distinct().where("page % 3 <> 0").select("doc_id", "page", *[v.alias(k) for k, v in matrix.items()])
    return layout.page_boxes(lines, turned).select("doc_id", "ordinal", "x0", "y0", "x1", "y1")


@_query(Q.EVAL_DETAILS)
def eval_details(spark, d):
    """Cases of benchmark items: their documents are the labelled sources, words of theirs the evidence."""
    asked, docs, chunks = _asked(spark, d), S.read(spark, d, "documents", "doc_id", "text"), _chunks(spark, d)
    label = F.struct(F.concat(F.lit("d"), F.col("id").cast("string")).alias("source"), F.array(F.lit(1)).alias("pages"))
    relevant = _relevant(asked, docs).groupBy("query_id").agg(F.collect_list(label).alias("relevant"))
    w = lambda n: F.try_element_at(F.regexp_extract_all("text", F.lit(X.WORD), F.lit(0)), F.lit(n))
    evidence = F.array(F.array(w(1)), F.array(F.concat(w(2), F.lit(" "), w(3))), F.array(F.lit("qqzz"), w(5)))
    cases = asked.select("query_id", evidence.alias("answer_evidence")).join(relevant, "query_id")
    top = lexical.top(lexical.bm25_top(asked.withColumn("method", F.lit("lexical")), 5, chunks), 5, "id")
    cited = F.array(F.struct(F.concat(F.lit("d"), F.col("id").cast("string")).alias("source"), F.lit(1).alias("page")))
    hits = top.join(chunks.select("id", "context", "text"), "id").select("query_id", F.col("rank").alias("place"), F.col("id").cast("string").alias("id"), "context", "text", cited.alias("citations"))
    out = evaluate.case_details(cases, hits)
    known = ~F.exists("matched_answer_evidence", lambda x: x.isNull())  # a short item has no such words
    return out.select("query_id", "first_relevant_rank", F.round("page_recall", 6).alias("page_recall"), F.when(known, F.round("answer_evidence_recall", 6)).alias("answer_evidence_recall"), F.array_join(F.transform("matched_answer_evidence", lambda x: x.cast("string")), ",").alias("matched"), F.array_join("retrieved_ids", ",").alias("retrieved_ids"))


@_query()
def search_hits(spark, d):
    """The flagship: chunks of all documents, searched for every benchmark item, with what a hit shows."""
    return _flagship(spark, d)


def _flagship(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    chunks = chunking.with_ids(chunking.pack(lines)).join(lines.groupBy("doc_id").agg(F.first("category").alias("category")), "doc_id").withColumn("context", F.col("doc_id").cast("string"))
    chunks = written(chunks, "chunks")  # packed once, read by postings, lengths and hits
    hits = search.search(_asked(spark, d), chunks, 5, "lexical")
    return hits.select("query_id", "place", "id", "doc_id", F.round("score", 9).alias("score"), "retrieval_mode", "context", "text", "first", "last")


flagship = _flagship
