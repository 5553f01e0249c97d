"""Source divergence audit: how sources of a language differ from each other and from the language, term by term."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, release, slices, table, text_buffers, written

#: What each byte becomes: letters of terms in lower case, 0 where terms are parted. Bytes from 0x80 on belong to terms.
_TERM = np.arange(256, dtype=np.uint8)
_TERM[65:91] += 32
_TERM[:65] = _TERM[91:97] = _TERM[123:128] = 0

_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTIAL = "lang string, source string, part string, item string, value long"

#: Counts of one batch: places are (document, group, number of the term).
_BATCH_SQL = """
SELECT grp, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs
FROM (SELECT doc, grp, term, count(*) AS n FROM places GROUP BY doc, grp, term) GROUP BY grp, term
"""

#: Counts of one shard of (lang, term), kept where enough documents of the language hold the term.
_SHARD_SQL = """
WITH one AS (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM counts GROUP BY lang, term, source),
     whole AS (SELECT *, sum(n) OVER w AS lang_n, sum(docs) OVER w AS lang_docs FROM one WINDOW w AS (PARTITION BY lang, term))
SELECT lang, source, term, CAST(n AS BIGINT) AS n, CAST(lang_n AS BIGINT) AS lang_n FROM whole WHERE lang_docs >= {least}
"""

#: Divergence of two weights.
_F = "({p} - {q}) * ({p} - {q}) // ({p} + {q})"

#: What two sources that share a term have more than if each stood alone against the other's weight of absent terms.
_PAIR_SQL = f"""
SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
       CAST(sum({_F.format(p="a.p", q="b.p")} - {_F.format(p="a.p", q="b.p0")} - {_F.format(p="a.p0", q="b.p")} + {_F.format(p="a.p0", q="b.p0")}) AS BIGINT) AS value
FROM rows AS a JOIN rows AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
"""

_TERM_SQL = f"""
SELECT lang, source, 'term' AS part, term AS item, {_F.format(p="p", q="q")} AS value FROM rows WHERE p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= {{most}}
"""


def _duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '700MB'")
    con.execute("SET temp_directory = ''")  # everything is bounded, nothing goes to a disk of one machine
    return con


def _arrow(con, sql: str):
    return con.sql(sql).to_arrow_table()


def _batches(rows, schema):
    for b in rows.select(schema.names).cast(schema).to_batches(max_chunksize=1 << 16):
        yield b


def _occurrences(texts):
    """(document, number of the term) of every term of an Arrow string column, and the terms by number."""
    import pyarrow as pa

    raw, ends = text_buffers(texts)
    raw = _TERM[raw]
    inside = np.zeros(len(raw) + 1, np.bool_)
    inside[:-1] = raw != 0
    cut = np.zeros(len(raw) + 1, np.bool_)
    cut[ends] = True
    cut[1:] |= inside[1:] != inside[:-1]
    cuts = np.flatnonzero(cut)
    units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(np.where(raw == 0, 32, raw).astype(np.uint8)))).dictionary_encode()
    is_term = inside[cuts[:-1]] if len(cuts) > 1 else np.zeros(0, np.bool_)
    doc = np.searchsorted(ends, cuts[:-1], "right") - 1
    return doc[is_term], units.indices.to_numpy(zero_copy_only=False)[is_term], units.dictionary


def _counted(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(lang, source, term, n, docs) of every batch of documents."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(it):
        con = _duck()
        for batch in slices(it, batch_bytes):
            doc, term, names = _occurrences(batch.column(2))
            if not len(doc):
                continue
            both = pa.StructArray.from_arrays(list(batch.columns[:2]), ["lang", "source"])
            keys = both.to_pylist()
            number: dict[tuple[str, str], int] = {}
            grp = np.array([number.setdefault((k["lang"], k["source"]), len(number)) for k in keys], np.int32)
            con.register("places", pa.table({"doc": doc.astype(np.int32), "grp": grp[doc], "term": term.astype(np.int32)}))
            found = _arrow(con, _BATCH_SQL)
            con.unregister("places")
            groups, at = list(number), found.column("grp").to_numpy()
            out = [pa.array([g[0] for g in groups]).take(pa.array(at)), pa.array([g[1] for g in groups]).take(pa.array(at)), names.take(pa.array(found.column("term").to_numpy())).cast(pa.string()), found.column("n"), found.column("docs")]
            yield from _batches(pa.Table.from_arrays(out, names=schema.names), schema)

    return docs.mapInArrow(run, _COUNTS)


def _kept(counts: DataFrame, least: int, shard_rows: int) -> DataFrame:
    """(lang, source, term, n, lang_n) of terms in `least` documents of their language or more; shards by lang and term.

    A shard's rows stream through DuckDB: beyond `shard_rows` they are summed by group and term before more are taken, so
    that memory follows a shard's distinct keys, not how often a common term was counted."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])

    def run(it):
        con = _duck()
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n HUGEINT, docs HUGEINT)")
        held = 0
        for batch in it:
            con.register("more", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO counts SELECT * FROM more")
            con.unregister("more")
            held += batch.num_rows
            if held > shard_rows:
                con.execute("CREATE TABLE summed AS SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM counts GROUP BY lang, source, term")
                con.execute("DROP TABLE counts")
                con.execute("ALTER TABLE summed RENAME TO counts")
                held = con.execute("SELECT count(*) FROM counts").fetchall()[0][0] // 2
        yield from _batches(_arrow(con, _SHARD_SQL.format(least=least)), schema)

    shards = max(partitions(counts.sparkSession), -(-counts.count() // shard_rows))
    return counts.repartition(shards, "lang", "term").mapInArrow(run, "lang string, source string, term string, n long, lang_n long")


def _partials(rows: DataFrame, most: int, batch_rows: int) -> DataFrame:
    """Partial pair sums and the first `most` terms of each group by shard; rows: sorted, a (lang, term) in one partition.

    Rows go to DuckDB by about `batch_rows`, cut between terms; pair sums of the batches are summed at the shard's end."""
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(it):
        con = _duck()
        con.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, part VARCHAR, item VARCHAR, value BIGINT)")
        con.execute("CREATE TABLE terms AS FROM pairs")

        def take(own):
            con.register("rows", own)
            con.execute(f"INSERT INTO pairs {_PAIR_SQL}")
            con.execute(f"INSERT INTO terms {_TERM_SQL.format(most=most)}")
            con.unregister("rows")
            con.execute("CREATE TABLE less AS SELECT lang, source, part, item, CAST(sum(value) AS BIGINT) AS value FROM pairs GROUP BY ALL")
            con.execute("DROP TABLE pairs")
            con.execute("ALTER TABLE less RENAME TO pairs")
            con.execute(f"CREATE TABLE less AS FROM terms QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {most}")
            con.execute("DROP TABLE terms")
            con.execute("ALTER TABLE less RENAME TO terms")

        held, n = [], 0
        for batch in it:
            held.append(batch)
            n += batch.num_rows
            if n >= batch_rows:
                own = pa.Table.from_batches(held).combine_chunks()
                # the last term may go on in the next batch
                lang, term = own.column("lang").to_pylist(), own.column("term").to_pylist()
                cut = n - 1
                while cut and (lang[cut - 1], term[cut - 1]) == (lang[-1], term[-1]):
                    cut -= 1
                if cut:
                    take(own.slice(0, cut))
                held, n = own.slice(cut).to_batches(), n - cut
        if n:
            take(pa.Table.from_batches(held))
        yield from _batches(_arrow(con, "FROM pairs"), schema)
        yield from _batches(_arrow(con, "FROM terms"), schema)

    return rows.mapInArrow(run, _PARTIAL)


def _weight(n: str, size: str, kept: str) -> str:
    """SQL of p = 1 + floor(10**9 * (n + 2) / (size + 2 * kept)), null where nothing is kept."""
    return f"1 + (cast({n} + 2 AS decimal(20,0)) * 1000000000) div nullif(cast({size} AS decimal(20,0)) + 2 * {kept}, 0)"


def source_divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, batch_bytes: int = 12 << 20, shard_rows: int = 1_000_000) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against every other of its language (part `pair`), and the
    terms by which it stands out from the language (part `term`, the first `most_terms`).

    docs: text, lang, source, other columns are not read; nulls count as ''. Terms are runs of letters A-Z (lower-cased
    only there) and of all characters beyond ASCII. A language keeps the terms of `least_docs` of its documents or more.
    A term weighs p = 1 + floor(10**9 (count + 2) / (N + 2 V)) in a source or language of N kept occurrences, V terms kept;
    two weights diverge by floor((p - q)**2 / (p + q)). A pair's value is the sum over all kept terms, 0 if none is.

    Counts are made by DuckDB in each batch, merged by DuckDB in shards by hash of lang and term, and so are the sums over
    terms that two sources share. What one source has and the other lacks depends on the term's count only, so it's summed
    over counts, and what both lack is a product: no shard lists pairs of sources that don't share the term.
    Repeated rows count each. Sources without terms are compared too. An empty table gives an empty table."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    docs = docs.select(*of)
    counts = written(_counted(docs, batch_bytes), "terms")
    kept = written(_kept(counts, least_docs, shard_rows), "kept")
    release(counts)

    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_size"))
    groups = docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "kept", "lang_size"])
    groups = written(groups.withColumn("p0", F.expr(_weight("0L", "size", "kept"))), "groups")

    rows = kept.join(groups.drop("terms"), ["lang", "source"]).select("lang", "source", "term", F.expr(_weight("n", "size", "kept")).alias("p"), "p0", F.expr(_weight("lang_n", "lang_size", "kept")).alias("q"))
    shards = max(partitions(docs.sparkSession), -(-kept.count() // shard_rows))
    partial = written(_partials(rows.repartition(shards, "lang", "term").sortWithinPartitions("lang", "term"), most_terms, shard_rows // 4), "partials")

    def f(p: str, q: str):
        return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")

    shared = partial.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("item_terms"))
    pairs = groups.join(other, "lang").filter("source <> item")
    neither = pairs.select("lang", "source", "item", F.coalesce((F.col("kept") - F.col("terms") - F.col("item_terms")) * f("p0", "q0"), F.lit(0).cast("long")).alias("value"))
    by_count = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(groups, ["lang", "source"]).withColumn("p", F.expr(_weight("n", "size", "kept")))
    alone = by_count.join(other, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * f("p", "q0")).alias("value"))
    turned = [x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for x in (shared, alone)]
    pair = neither.unionByName(shared).unionByName(turned[0]).unionByName(alone).unionByName(turned[1]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    term = partial.filter("part = 'term'").withColumn("rank", ranked).filter(F.col("rank") <= most_terms)
    cols = ("lang", "source", "part", "item", "value", "rank")
    return pair.withColumn("rank", ranked).select(*cols).unionByName(term.select(*cols))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents", "lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
     w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
     langs AS (SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
     g AS (SELECT DISTINCT lang, source FROM d),
     size AS (SELECT lang, source, sum(n) AS size FROM c GROUP BY lang, source),
     p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
                  1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(size.size, 0) + 2 * langs.v) AS p,
                  1 + 1000000000::HUGEINT * (kept.n + 2) // (langs.size + 2 * langs.v) AS q
           FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN size USING (lang, source) LEFT JOIN c USING (lang, source, term)),
     sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
               FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
               UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 10
"""
