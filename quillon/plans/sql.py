"""DuckDB SQL that the registered queries are held against."""

from __future__ import annotations

from ..functions.text import SPACE_CLASS, STOP_WORDS, UNIT, WORD

_P = UNIT.replace("'", "''")


def rx(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"


def units(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{_P}'))"


def tokens(text: str) -> str:
    return f"greatest({units(text)}, (strlen({text}) + 2) // 3)"


def fold(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


def margin_key(text: str) -> str:
    return rx(fold(f"trim({rx(text, '[' + chr(92) + 't ' + chr(92) + 'x{a0}]+', ' ')})"), r"\p{Nd}+", "#")


def query_tokens(text: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = f"regexp_extract_all({text}, '{WORD}')"
    telling = f"list_filter({words}, lambda w: NOT list_contains([{stops}], {fold('w')}))"
    some = f"(CASE WHEN len({telling}) > 0 THEN {telling} ELSE {words} END)[1:80]"
    # each word once, where it comes first
    return f"list_filter({some}, lambda w, i: list_position({some}, w) = i)"


LINES = f"""SELECT doc_id, ordinal, category, text FROM (SELECT doc_id, source AS category, unnest(string_split(text, chr(10))) AS text,
generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents) WHERE regexp_matches(text, '[^{SPACE_CLASS}]')"""

TURNS = """SELECT conv_id, turn, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM (
SELECT conv_id, turn, role, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations)"""

PACKED = f"""WITH RECURSIVE e AS (SELECT doc_id, ordinal, text, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS i, {units("text")} AS u, strlen(text) AS o FROM ({LINES})),
pack AS (SELECT doc_id, i, 0 AS chunk, 1 AS n, u, o FROM e WHERE i = 1 UNION ALL
  SELECT e.doc_id, e.i, CASE WHEN greatest(p.u + e.u, (p.o + e.o + 2 * p.n + 2) // 3) > 384 THEN p.chunk + 1 ELSE p.chunk END,
    CASE WHEN greatest(p.u + e.u, (p.o + e.o + 2 * p.n + 2) // 3) > 384 THEN 1 ELSE p.n + 1 END,
    CASE WHEN greatest(p.u + e.u, (p.o + e.o + 2 * p.n + 2) // 3) > 384 THEN e.u ELSE p.u + e.u END,
    CASE WHEN greatest(p.u + e.u, (p.o + e.o + 2 * p.n + 2) // 3) > 384 THEN e.o ELSE p.o + e.o END
  FROM pack p JOIN e ON e.doc_id = p.doc_id AND e.i = p.i + 1),
chunks AS (SELECT *, {tokens("text")} AS token_count FROM (SELECT e.doc_id, chunk, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY e.i) AS text
  FROM pack JOIN e ON e.doc_id = pack.doc_id AND e.i = pack.i GROUP BY e.doc_id, chunk))
"""

_OVER = "greatest(7 + p.u + e.u, (36 + p.o + e.o + p.n + 2) // 3) > 64"
TABLE_CHUNKS = f"""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_partkey || ' | ' || l_suppkey || ' | ' || CAST(l_quantity AS DECIMAL(12, 0)) || ' | ' || CAST(l_extendedprice AS DECIMAL(14, 2)) AS text,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(12, 0)) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(14, 2)) AS VARCHAR)) AS i FROM lineitem),
e AS (SELECT *, {units("text")} AS u, strlen(text) AS o FROM r),
pack AS (SELECT doc_id, i, 0 AS chunk, 1 AS n, u, o FROM e WHERE i = 1 UNION ALL
  SELECT e.doc_id, e.i, CASE WHEN {_OVER} THEN p.chunk + 1 ELSE p.chunk END, CASE WHEN {_OVER} THEN 1 ELSE p.n + 1 END, CASE WHEN {_OVER} THEN e.u ELSE p.u + e.u END, CASE WHEN {_OVER} THEN e.o ELSE p.o + e.o END
  FROM pack p JOIN e ON e.doc_id = p.doc_id AND e.i = p.i + 1),
t AS (SELECT e.doc_id, chunk, min(e.i) + 1 AS first_row, max(e.i) + 1 AS last_row, 'Item | Supplier | Quantity | Amount' || chr(10) || string_agg(text, chr(10) ORDER BY e.i) AS text
  FROM pack JOIN e ON e.doc_id = pack.doc_id AND e.i = pack.i GROUP BY e.doc_id, chunk)
SELECT doc_id, chunk, first_row, last_row, {tokens("text")} AS token_count, false AS row_fragment, md5(text) AS text_md5 FROM t"""

_SHORT = "(length(text) < 180 AND len(string_split(text, chr(10))) <= 3)"
_EXPLICIT = r"regexp_matches(text, '(?i)^(section|chapter|part|annexure|annex|appendix|schedule)\s*[-–:]?\s*([\p{Nd}IVXLC]+|[A-Z])(?:\b|:)')"
_BULLET = r"regexp_matches(text, '(?i)^(?:[•\x{f0b7}\x{fffd}]|\([a-zivx]+\))')"
_UPPER = "(upper(text) = text AND lower(text) <> text)"
_NUMBER = r"regexp_extract(text, '(?s)^(\p{Nd}+(?:\.\p{Nd}+)*)(?:\.|\))?\s+[A-Za-z].*', 1)"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"
LAYOUT = rf"""WITH lines AS ({LINES}),
placed AS (SELECT doc_id, (ordinal + 1) * 3 + 1 AS ordinal, ordinal // 40 + 1 AS page, CASE WHEN ordinal % 40 % 2 = 0 THEN 50.0 ELSE 320.0 END AS x0, CAST(80 + 16 * (ordinal % 40) AS DOUBLE) AS y0,
  CASE WHEN ordinal % 40 % 2 = 0 THEN 290.0 ELSE 560.0 END AS x1, CAST(92 + 16 * (ordinal % 40) AS DOUBLE) AS y1, CASE WHEN length(text) < 60 THEN 16.0 ELSE 11.0 END AS font_size, length(text) < 60 AS bold, text FROM lines),
pages AS (SELECT doc_id, unnest(range(1, CAST(last AS BIGINT) + 1)) AS page FROM (SELECT doc_id, max(page) AS last FROM placed GROUP BY doc_id)),
layout AS (SELECT doc_id, ordinal, page, CAST(x0 AS DOUBLE) AS x0, y0, CAST(x1 AS DOUBLE) AS x1, y1, CAST(font_size AS DOUBLE) AS font_size, bold, text FROM placed
  UNION ALL SELECT doc_id, (page - 1) * 120 + 3, page, 50.0, 20.0, 300.0, 32.0, 9.0, false, 'Report ' || doc_id || ' page ' || page FROM pages
  UNION ALL SELECT doc_id, page * 120 + 2, page, 50.0, 760.0, 300.0, 772.0, 9.0, false, 'Page ' || page || ' of 9' FROM pages),
sided AS (SELECT *, CASE WHEN y1 < 792 * 0.09 THEN 'top' WHEN y0 > 792 * 0.91 THEN 'bottom' END AS side, {margin_key("text")} AS key FROM layout),
margins AS (SELECT doc_id, side, key, count(DISTINCT page) AS n FROM sided WHERE side IS NOT NULL GROUP BY ALL),
counts AS (SELECT doc_id, max(page) AS page_count FROM layout GROUP BY doc_id),
flagged AS (SELECT s.*, coalesce(s.side IS NOT NULL AND (m.n >= greatest(3.0, c.page_count * 0.25) OR regexp_matches(text, '(?i)^(?:page\s*)?\p{{Nd}}+(?:\s*(?:of|/)\s*\p{{Nd}}+)?$')), false) AS excluded
  FROM sided s LEFT JOIN margins m ON s.doc_id = m.doc_id AND s.side = m.side AND s.key = m.key JOIN counts c ON s.doc_id = c.doc_id),
bounded AS (SELECT * EXCLUDE (side, key), CASE WHEN excluded THEN CASE WHEN side = 'top' THEN 'header' ELSE 'footer' END ELSE 'paragraph' END AS kind FROM flagged),
fonts AS (SELECT doc_id, font_size, sum(length(text)) AS chars, min(ordinal) AS first FROM layout GROUP BY ALL),
bodies AS (SELECT doc_id, arg_max(font_size, (chars, -first)) AS body FROM fonts GROUP BY doc_id),
sizes AS (SELECT f.doc_id, any_value(body) AS body, coalesce(string_agg(CAST(font_size AS VARCHAR), ',' ORDER BY font_size DESC) FILTER (font_size > body * 1.08 AND chars > 30), '') AS large
  FROM fonts f JOIN bodies b ON f.doc_id = b.doc_id GROUP BY f.doc_id),
locals AS (SELECT doc_id, page, arg_max(font_size, (chars, -first)) AS near FROM (SELECT doc_id, page, font_size, sum(length(text)) AS chars, min(ordinal) AS first FROM layout GROUP BY ALL) GROUP BY ALL),
judged AS (SELECT b.*, kind = 'paragraph' AND {_SHORT} AND ({_EXPLICIT} OR ({_WORDS} BETWEEN 2 AND 20 AND NOT {_BULLET} AND NOT regexp_matches(text, '[.;,]$') AND (bold OR font_size > greatest(body, near) * 1.08 OR {_UPPER})
    AND NOT regexp_matches(text, '(?i)^(?:yours |\(signature|\(to be given)'))) AS heading, large, {_NUMBER} AS number
  FROM bounded b JOIN sizes s ON b.doc_id = s.doc_id JOIN locals l ON b.doc_id = l.doc_id AND b.page = l.page),
leveled AS (SELECT doc_id, ordinal, text, excluded, CASE WHEN heading THEN 'heading' WHEN kind = 'paragraph' AND (number <> '' OR {_BULLET}) THEN 'list_item' ELSE kind END AS kind,
  CASE WHEN NOT heading THEN 0 WHEN number <> '' THEN least(6, len(string_split(number, '.'))) WHEN {_EXPLICIT} THEN 1 WHEN {_UPPER} AND {_WORDS} >= 3 THEN 1
    WHEN list_contains(string_split(large, ','), CAST(font_size AS VARCHAR)) THEN least(6, list_position(string_split(large, ','), CAST(font_size AS VARCHAR))) ELSE 2 END AS level FROM judged)
"""

_KEYS = ", ".join(f"max(CASE WHEN kind = 'heading' AND level = {n} THEN ordinal END) OVER w AS h{n}" for n in range(1, 7))
_OPEN = ", ".join(f"CASE WHEN h{n} > greatest({', '.join(['-1'] + [f'coalesce(h{m}, -1)' for m in range(1, n)])}) THEN h{n} END AS o{n}" for n in range(1, 7))
_PATH = ", ".join(f"CASE WHEN o{n} IS NOT NULL THEN (SELECT any_value(t.text) FROM leveled t WHERE t.doc_id = s.doc_id AND t.ordinal = s.o{n}) END" for n in range(1, 7))
SECTIONS = f""", carried AS (SELECT doc_id, ordinal, {_KEYS} FROM leveled WHERE NOT excluded WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
opened AS (SELECT doc_id, ordinal, {_OPEN} FROM carried)
SELECT doc_id, ordinal, CASE WHEN coalesce(o6, o5, o4, o3, o2, o1) IS NULL THEN substr(sha256(doc_id || chr(0) || 'root'), 1, 24)
  ELSE substr(sha256(doc_id || chr(0) || substr(sha256(doc_id || chr(0) || coalesce(o6, o5, o4, o3, o2, o1)), 1, 24) || chr(0) || 'section'), 1, 24) END AS section_id, concat_ws(' > ', {_PATH}) AS path FROM opened s"""

_CHANGE = r"""lag(page) OVER w <> page OR lag(bold) OVER w <> bold OR abs(lag(font_size) OVER w - font_size) > 1 OR regexp_matches(text, '(?i)^(?:\p{Nd}+(?:\.\p{Nd}+)*[.)]?\s|[•\x{f0b7}\x{fffd}]|\([a-zivx]+\))')"""
FRAGMENTS = f""", marked AS (SELECT *, CASE WHEN coalesce({_CHANGE}, true) THEN 1 ELSE 0 END AS new FROM layout WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS fragment FROM marked)
SELECT doc_id, fragment, min(page) AS page, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(sum(font_size * length(text)) / greatest(1, sum(length(text))), 6) AS font_size,
sum(CASE WHEN bold THEN length(text) ELSE 0 END) / greatest(1, sum(length(text))) > 0.6 AS bold, md5(string_agg(text, chr(10) ORDER BY ordinal)) AS text_md5 FROM runs GROUP BY doc_id, fragment"""

VARIANTS = rf"""WITH q AS (SELECT item_id, 'Please identify the OEM for ' || substring(text, 1, 40) || ' in the compliance matrix.' AS query FROM benchmark),
b AS (SELECT *, regexp_replace(regexp_replace(query, '(?i)^(?:please\s+)?(?:extract|identify|summarize|state|list|prepare)\s+', ''), '(?i)\b(?:for|in)\s+the\s+(?:technical |commercial )?compliance[- ]matrix\b', '', 'g') AS bare FROM q),
c AS (SELECT *, trim(trim({rx("bare", "[" + SPACE_CLASS + "]+", " ")}), ' .?') AS first, regexp_replace(regexp_replace(query, '(?i)\bEMD\b', 'earnest money deposit', 'g'), '(?i)\bOEM\b', 'original equipment manufacturer', 'g') AS spelled FROM b)
SELECT item_id, concat_ws('|', CASE WHEN first <> '' AND lower(first) <> lower(trim(query, ' .?')) THEN first END, CASE WHEN spelled <> query THEN spelled END) AS variants FROM c"""

_TERMS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_POST = f"""posts AS (SELECT doc_id AS id, unnest({_TERMS.format("source")}) AS term, 1 AS c, 0 AS t FROM documents UNION ALL SELECT doc_id, unnest({_TERMS.format("text")}), 0, 1 FROM documents),
postings AS (SELECT term, id, sum(c) AS tf_context, sum(t) AS tf_text FROM posts GROUP BY term, id),
lengths AS (SELECT doc_id AS id, len({_TERMS.format("source")}) + len({_TERMS.format("text")}) AS length FROM documents),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""
POSTINGS = f"WITH {_POST} "


def _asked(source: str, text: str, method: str) -> str:
    return f"SELECT item_id AS query_id, '{method}' AS method, unnest(flatten(list_transform({query_tokens(text)}, lambda w: {_TERMS.format('w')}))) AS term FROM {source}"


_PART = "ln((n - df + 0.5) / (df + 0.5))"
_F = "(0.7 * tf_context + tf_text)"
_SCORE = f"(CASE WHEN {_PART} > 0 THEN {_PART} ELSE 1e-6 END) * {_F} * 2.2 / ({_F} + 1.2 * (1 - 0.75 + 0.75 * length / mean))"
_SCORED = f"scores AS (SELECT query_id, method, p.id, sum({_SCORE}) AS score FROM asked JOIN postings p USING (term) JOIN dfs USING (term) JOIN lengths l ON l.id = p.id CROSS JOIN stats GROUP BY ALL)"


def bm25(source: str, text: str, method: str, k: int, where: str = "true") -> str:
    return f"""WITH {_POST}, asked AS ({_asked(source, text, method)}), {_SCORED},
ranked AS (SELECT query_id, method, id, score, row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 11) DESC, id) AS rank FROM scores JOIN documents ON id = doc_id WHERE {where})
SELECT query_id, method, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""


_SPELLED = "'Identify the earnest money deposit of ' || text"
BM25_VARIANTS = f"""WITH {_POST}, asked AS ({_asked("benchmark", "'Identify the EMD of ' || text", "lexical")} UNION ALL {_asked("benchmark", "trim('the EMD of ' || " + rx("trim(text)", "[" + SPACE_CLASS + "]+", " ") + ", ' .?')", "lexical_variant_1")}
UNION ALL {_asked("benchmark", _SPELLED, "lexical_variant_2")}), {_SCORED},
ranked AS (SELECT query_id, method, id, row_number() OVER (PARTITION BY query_id, method ORDER BY round(score, 11) DESC, id) AS rank FROM scores)
SELECT query_id, method, id, rank FROM ranked WHERE rank <= 5"""


def dense(k: int, where: str = "true") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, rank, round(score, 5) AS score FROM r WHERE rank <= {k}"""


HYBRID = f"""WITH {_POST}, heads AS (SELECT doc_id AS item_id, array_to_string(regexp_split_to_array(text, '\\s+')[1:12], ' ') AS text FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
asked AS ({_asked("heads", "text", "lexical")}), {_SCORED},
lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 11) DESC, id) AS rank FROM scores),
ds AS (SELECT h.item_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY h.item_id ORDER BY list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.vec_id) AS rank
  FROM heads h JOIN embeddings q ON q.vec_id = h.item_id, embeddings c WHERE c.vec_id IN (SELECT doc_id FROM documents)),
both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, coalesce(1.5 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS score
  FROM (SELECT * FROM lex WHERE rank <= 20) a FULL JOIN (SELECT * FROM ds WHERE rank <= 20) b ON a.query_id = b.query_id AND a.id = b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 13) DESC, id) AS place FROM both_) SELECT query_id, id, place, round(score, 9) AS score FROM r WHERE place <= 5"""

EXPAND = f"""WITH c AS (SELECT conv_id || '-' || turn AS id, conv_id AS doc_id, turn AS chunk, turn // 6 AS s, {tokens("text")} AS token_count FROM conversations),
near AS (SELECT m.id AS target, m.token_count AS own, m.chunk AS mid, n.* FROM c m JOIN c n ON m.doc_id = n.doc_id AND m.s = n.s),
back AS (SELECT * FROM (SELECT *, sum(token_count) OVER (PARTITION BY target ORDER BY chunk DESC ROWS UNBOUNDED PRECEDING) AS upto FROM near WHERE chunk < mid) WHERE upto + own <= 400),
used AS (SELECT target, max(upto) AS used FROM back GROUP BY target),
ahead AS (SELECT a.* FROM (SELECT *, sum(token_count) OVER (PARTITION BY target ORDER BY chunk ROWS UNBOUNDED PRECEDING) AS upto FROM near WHERE chunk > mid) a LEFT JOIN used USING (target) WHERE upto + coalesce(used, 0) + own <= 400),
every_ AS (SELECT target, id, chunk, token_count FROM back UNION ALL SELECT target, id, chunk, token_count FROM ahead UNION ALL SELECT target, id, chunk, token_count FROM near WHERE chunk = mid)
SELECT target, id, chunk, token_count, CASE WHEN sum(token_count) OVER (PARTITION BY target) <= 400 THEN sum(token_count) OVER (PARTITION BY target) END AS total FROM every_"""

EVAL = f"""WITH {_POST}, asked AS ({_asked("benchmark AS q", "q.text", "lexical")}), {_SCORED},
top AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 11) DESC, id) AS rank FROM scores) WHERE rank <= 5),
relevant AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
cases AS (SELECT r.query_id, count(*) AS wanted, count(t.id) AS found, min(t.rank) AS first FROM relevant r LEFT JOIN top t ON r.query_id = t.query_id AND r.id = t.id GROUP BY r.query_id)
SELECT count(*) AS cases, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS hit_rate, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(found / wanted), 6) AS recall FROM cases"""

_HAY = f"array_to_string(regexp_extract_all({fold('text')}, '{WORD}'), ' ')"
EVIDENCE = f"""SELECT item_id, round((CASE WHEN contains(h, 'the') OR contains(h, 'der') THEN 1 ELSE 0 END + CASE WHEN contains(h, 'in of') THEN 1 ELSE 0 END + CASE WHEN contains(h, 'que') OR contains(h, 'les') THEN 1 ELSE 0 END) / 3, 6) AS evidence
FROM (SELECT item_id, {_HAY} AS h FROM benchmark)"""

_JOINED = "concat_ws(' ', concat_ws('_', w[2], w[3]), concat_ws('_', w[5], w[6], w[7]), w[9])"
BM25_PHRASES = f"""WITH {_POST.split("stats AS")[0]} stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lengths),
asks AS (SELECT item_id, {_JOINED} AS text FROM (SELECT item_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark)),
lists AS (SELECT doc_id AS id, 0 AS col, {_TERMS.format("source")} AS t FROM documents UNION ALL SELECT doc_id, 1, {_TERMS.format("text")} FROM documents),
tok AS (SELECT id, col, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM lists),
tokens AS (SELECT item_id AS query_id, {_TERMS.format("token")} AS parts FROM (SELECT item_id, unnest({query_tokens("text")}) AS token FROM asks)),
asked AS (SELECT query_id, 'lexical' AS method, array_to_string(parts, '_') AS term FROM tokens WHERE len(parts) > 0),
kinds AS (SELECT DISTINCT parts FROM tokens), parts AS (SELECT array_to_string(parts, '_') AS key, len(parts) AS n, unnest(parts) AS term, generate_subscripts(parts, 1) AS i FROM kinds),
occ AS (SELECT key, id, col, pos - i AS start FROM parts JOIN tok USING (term) GROUP BY key, n, id, col, pos - i HAVING count(*) = n),
postings_ AS (SELECT key AS term, id, sum(1 - col) AS tf_context, sum(col) AS tf_text FROM occ GROUP BY key, id), dfs AS (SELECT term, count(*) AS df FROM postings_ GROUP BY term),
{_SCORED.replace("postings p", "postings_ p")},
ranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 11) DESC, id) AS rank FROM scores)
SELECT query_id, id, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5"""



def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{SPACE_CLASS}]+'), lambda x: x <> '')"


RERANK = HYBRID.split(" SELECT query_id, id, place, round(score, 9)")[0] + f""", pool AS (SELECT query_id, id, score FROM r WHERE place <= 20),
q AS (SELECT item_id AS query_id, list_distinct({_split("lower(text)")}) AS qs, 256 - 8 - len({_split("text")}) AS budget FROM heads),
pairs AS (SELECT query_id, id, score, qs, budget, {_split("lower(source || chr(10) || text)")} AS ws FROM pool JOIN q USING (query_id) JOIN documents ON doc_id = id),
windows AS (SELECT *, unnest(range(0, greatest(1, len(ws)), budget - 32)) AS st FROM pairs),
best AS (SELECT query_id, id, score, max(len(list_filter(qs, lambda x: list_contains(ws[st + 1:st + budget], x))) / greatest(1, len(qs))) AS rerank FROM windows WHERE st = 0 OR st + 32 < len(ws) GROUP BY query_id, id, score),
placed_ AS (SELECT query_id, id, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, round(score, 13) DESC, id) AS place FROM best)
SELECT query_id, id, place, round(rerank, 9) AS score, 'rerank' AS score_type FROM placed_ WHERE place <= 5"""

ENCODE_LONG = f"""WITH t AS (SELECT doc_id, {_split("text")} AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS i FROM t),
g AS (SELECT doc_id, (i - 1) // 112 AS part, count(*) AS weight, string_agg(lower(word), '') AS s FROM w GROUP BY ALL),
c AS (SELECT doc_id, part, weight, place, length(s) - length(replace(s, chr(CAST(97 + place AS INTEGER)), '')) AS x FROM g, range(26) r(place)),
n AS (SELECT doc_id, max(part) AS last FROM g GROUP BY doc_id), v AS (SELECT c.doc_id, place, sum(CASE WHEN last = 0 THEN x ELSE weight * x END) AS y FROM c JOIN n USING (doc_id) GROUP BY c.doc_id, place)
SELECT doc_id, place, round(y / greatest(sqrt(sum(y * y) OVER (PARTITION BY doc_id)), 1e-12), 6) AS x FROM v"""

#: Documents as three writes leave them: all; those in French anew under another id; those in Spanish removed.
ACTIVE = """active AS (SELECT CASE WHEN lang = 'fr' THEN 'x' ELSE '' END || doc_id AS doc_id, source, CASE WHEN lang = 'fr' THEN text || chr(10) || 'Revised edition of this file.' ELSE text END AS text FROM documents WHERE lang <> 'es')"""
REINDEX = PACKED.replace("FROM documents)", "FROM active)").replace("WITH RECURSIVE e AS", f"WITH RECURSIVE {ACTIVE}, e AS") + "SELECT doc_id, chunk, first, last, n, token_count, md5(text) AS text_md5 FROM chunks"
HISTORY = """SELECT CAST(doc_id AS VARCHAR) AS id, source || '/' || doc_id AS source, 1 AS revision, lang NOT IN ('fr', 'es') AS active FROM documents
UNION ALL SELECT 'x' || doc_id, source || '/' || doc_id, 2, true FROM documents WHERE lang = 'fr'"""

_PAGES = "p AS (SELECT doc_id, page, sum(length(text)) AS characters, sum(length(text)) < 80 AS sparse, sum(length(text) - length(replace(text, chr(65533), ''))) / greatest(1, sum(length(text))) > 0.03 AS corrupt, CASE WHEN (doc_id + page) % 2 = 0 THEN (doc_id + page) % 10 / 10.0 END AS ratio FROM layout GROUP BY ALL), q AS (SELECT *, coalesce(ratio IS NOT NULL AND (sparse OR ratio > 0.65 AND characters < 300), false) AS needs_ocr FROM p)"
_WARNED = "needs_ocr OR coalesce(ratio > 0.2, false) OR corrupt OR sparse"
FLAGGED = LAYOUT + f", {_PAGES} SELECT doc_id, page, needs_ocr AS unread, concat_ws(',', CASE WHEN needs_ocr THEN 'needs_ocr' WHEN ratio > 0.2 THEN 'visual_content_requires_review' END, CASE WHEN corrupt THEN 'replacement_characters_in_native_text' END, CASE WHEN sparse THEN 'sparse_page' END) AS warnings FROM q WHERE {_WARNED}"
TOTALS = PACKED + LAYOUT.replace("WITH lines AS", ", lines AS") + f""", {_PAGES},
counted AS (SELECT doc_id, 0 AS pages, count(*) AS elements, 0 AS sections, 0 AS tables, 0 AS chunks, 0 AS tokens, 0 AS context_tokens, 0 AS needs_review, 0 AS ocr_pages, 0 AS flagged_pages, 0 AS unread_pages, 0 AS failures FROM layout GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM documents WHERE doc_id IN (SELECT doc_id FROM layout) UNION ALL SELECT doc_id, 0, 0, count(*), 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM leveled WHERE kind = 'heading' AND NOT excluded GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 0, 0, 0, count(*), sum(token_count), sum(token_count + 1), 0, 0, 0, 0, 0 FROM chunks GROUP BY doc_id
  UNION ALL SELECT doc_id, count(*), 0, 0, 0, 0, 0, 0, 0, 0, count(*) FILTER ({_WARNED}), count(*) FILTER (needs_ocr), 0 FROM q GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM documents UNION ALL SELECT doc_id, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, count(*) FROM labels WHERE toxic = 1 GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("pages", "elements", "sections", "tables", "chunks", "tokens", "context_tokens", "needs_review", "ocr_pages", "flagged_pages", "unread_pages", "failures"))} FROM counted GROUP BY ROLLUP (doc_id)"""

MANIFESTS = """SELECT doc_id, CASE WHEN lang = 'fr' THEN CASE WHEN toxic = 1 THEN 'toxic' ELSE source END WHEN quality IS NOT NULL THEN 'quality ' || quality ELSE source END AS category,
CASE WHEN lang = 'fr' THEN CASE WHEN toxic = 1 THEN 'Inner ' || doc_id ELSE CAST(doc_id AS VARCHAR) END WHEN quality IS NOT NULL THEN 'Outer ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title FROM documents LEFT JOIN labels USING (doc_id)"""

_KEY = fold(rx("text", "[^" + chr(92) + "p{L}" + chr(92) + "p{N}_]+", ""))
BOOKMARKS = LAYOUT + f""", marks AS (SELECT doc_id, page, {_KEY} AS key, arg_max(1 + ordinal % 8, ordinal) AS mark FROM layout WHERE ordinal % 7 < 3 AND length({_KEY}) > 3 GROUP BY ALL),
outlined AS (SELECT j.*, mark FROM (SELECT *, {_KEY} AS key FROM judged) j LEFT JOIN marks m ON j.doc_id = m.doc_id AND j.page = m.page AND j.key = m.key),
again AS (SELECT *, heading OR (kind = 'paragraph' AND {_SHORT} AND mark IS NOT NULL) AS head FROM outlined)
SELECT doc_id, ordinal, CASE WHEN head THEN 'heading' WHEN kind = 'paragraph' AND (number <> '' OR {_BULLET}) THEN 'list_item' ELSE kind END AS kind,
  CASE WHEN NOT head THEN 0 WHEN number <> '' THEN least(6, len(string_split(number, '.'))) WHEN {_EXPLICIT} THEN 1 WHEN mark IS NOT NULL THEN least(6, mark) WHEN {_UPPER} AND {_WORDS} >= 3 THEN 1
    WHEN list_contains(string_split(large, ','), CAST(font_size AS VARCHAR)) THEN least(6, list_position(string_split(large, ','), CAST(font_size AS VARCHAR))) ELSE 2 END AS level FROM again"""

_MATRIX = "0.5 AS a, 0.25 AS b, -0.25 AS c, 0.5 AS d, 8.0 * page AS e, 16.0 AS f"
PAGE_BOXES = LAYOUT + f""", m AS (SELECT *, {_MATRIX} FROM layout), corner AS (SELECT *, a * d - b * c AS det, unnest([x0, x0, x1, x1]) - e AS u, unnest([y0, y1, y0, y1]) - f AS v FROM m)
SELECT doc_id, ordinal, min(CASE WHEN page % 3 = 0 THEN x0 ELSE (d * u - c * v) / det END) AS x0, min(CASE WHEN page % 3 = 0 THEN y0 ELSE (a * v - b * u) / det END) AS y0,
  max(CASE WHEN page % 3 = 0 THEN x1 ELSE (d * u - c * v) / det END) AS x1, max(CASE WHEN page % 3 = 0 THEN y1 ELSE (a * v - b * u) / det END) AS y1 FROM corner GROUP BY doc_id, ordinal"""

_HIT = "array_to_string(regexp_extract_all(" + fold("t") + f", '{WORD}'), ' ')"
EVAL_DETAILS = EVAL.split("cases AS (")[0] + f"""cases AS (SELECT r.query_id, count(*) AS wanted, count(t.id) AS found, min(t.rank) AS first FROM relevant r LEFT JOIN top t ON r.query_id = t.query_id AND r.id = t.id GROUP BY r.query_id),
got AS (SELECT query_id, string_agg(source || chr(10) || text, chr(10) ORDER BY rank) AS t, string_agg(id, ',' ORDER BY rank) AS ids FROM top JOIN documents ON doc_id = id GROUP BY query_id),
w AS (SELECT item_id AS query_id, regexp_extract_all(text, '{WORD}') AS w FROM benchmark),
m AS (SELECT query_id, first, found / wanted AS page_recall, coalesce(ids, '') AS ids, contains(h, {fold("w[1]")}) AS m1, contains(h, {fold("w[2]")} || ' ' || {fold("w[3]")}) AS m2, contains(h, 'qqzz') OR contains(h, {fold("w[5]")}) AS m3
  FROM (SELECT c.*, coalesce({_HIT}, '') AS h, ids, w FROM cases c LEFT JOIN got USING (query_id) JOIN w USING (query_id)))
SELECT query_id, first AS first_relevant_rank, round(page_recall, 6) AS page_recall, round((m1::INT + m2::INT + m3::INT) / 3, 6) AS answer_evidence_recall, concat_ws(',', m1, m2, m3) AS matched, ids AS retrieved_ids FROM m"""
