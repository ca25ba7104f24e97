"""DuckDB SQL that states what the queries return, over the same tables."""

from __future__ import annotations

from quire.plans.config import DOMAIN_KEYWORDS

def digest_sum(text: str) -> str:
    """A sum over rows that tells sets of texts apart: of the first 8 hex digits of their MD5."""
    return f"CAST(sum(CAST('0x' || md5({text})[1:8] AS BIGINT)) AS BIGINT)"


ENTRIES = """
ords AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, 'cust-' || o_custkey AS document_id FROM orders o),
numbered AS (SELECT *, CAST(floor(k / 2) AS INT) + 1 AS page FROM ords),
lines AS (SELECT l_orderkey, list('| ' || l_linenumber || ' | ' || CAST(l_quantity AS INT) || ' | ' || CAST(l_extendedprice AS DECIMAL(15,2)) || ' |' ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)) AS md,
  list('["' || l_linenumber || '", "' || CAST(l_quantity AS INT) || '", "' || CAST(l_extendedprice AS DECIMAL(15,2)) || '"]' ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)) AS js FROM lineitem GROUP BY 1),
raw_entries AS (
  SELECT document_id, page, k, o_orderkey, 10*k AS ord, 'text' AS rt, k || '. Order ' || o_orderkey AS text FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+1, 'text', k || '.1 Status and totals' FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+2, 'text', 'Order status: ' || o_orderstatus FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+3, 'text', 'Placed in Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || ' and FY ' || year(o_orderdate) FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+4, 'text', '- priority ' || o_orderpriority FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+5, 'text', CASE WHEN k % 3 = 0 THEN '' WHEN k % 5 = 0 THEN '1. numbered item' ELSE '- clerk check' END FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+6, 'table', NULL FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+7, 'text', 'See Table ' || k || ' and Figure 1.' FROM numbered
  UNION ALL SELECT document_id, page, k, o_orderkey, 10*k+8, 'figure', CASE WHEN k % 2 = 0 THEN 'Totals by line' ELSE '' END FROM numbered WHERE o_orderkey % 2 = 0),
flagged AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ord) AS i,
  rt = 'text' AND regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\.?\\s+\\S+') AS heading,
  rt = 'text' AND regexp_matches(text, '^([-*•]\\s+|\\(?[0-9]+[).\\]]\\s+|\\(?[a-zA-Z][).\\]]\\s+)') AS listed FROM raw_entries),
linked AS (SELECT *, coalesce(listed AND lag(listed) OVER w AND lag(page) OVER w = page, false) AS goes_on FROM flagged WINDOW w AS (PARTITION BY document_id ORDER BY i)),
runs AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY i) AS run FROM linked),
firsts AS (SELECT *, min(CASE WHEN listed AND NOT heading THEN i END) OVER (PARTITION BY document_id, run) AS fst FROM runs),
kinds AS (SELECT *, CASE WHEN listed AND i >= fst THEN 'list' WHEN heading THEN 'heading' WHEN rt = 'text' AND text <> '' THEN 'paragraph' WHEN rt <> 'text' THEN rt END AS kind FROM firsts),
started AS (SELECT *, sum(CASE WHEN kind <> 'list' OR i = fst THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS seq FROM kinds WHERE kind IS NOT NULL),
units AS (SELECT document_id, CAST(seq AS INT) AS seq, any_value(kind) AS kind, any_value(page) AS page, any_value(k) AS k, any_value(o_orderkey) AS o_orderkey,
  string_agg(text, '\\n' ORDER BY i) AS own FROM started GROUP BY 1, 2),
labelled AS (SELECT *, 'ldu_' || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INT), '0') AS ldu_id,
  CASE WHEN kind = 'table' THEN 'Table ' || sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) OVER w WHEN kind = 'figure' THEN 'Figure ' || sum(CASE WHEN kind = 'figure' THEN 1 ELSE 0 END) OVER w END AS label,
  CASE WHEN kind <> 'heading' THEN last_value(CASE WHEN kind = 'heading' THEN seq END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_seq
  FROM units WINDOW w AS (PARTITION BY document_id ORDER BY seq)),
ldus AS (SELECT u.document_id, u.seq, u.ldu_id, u.kind, u.page, u.label, u.k,
  CASE WHEN u.kind = 'figure' AND u.own = '' THEN 'other' ELSE u.kind END AS content_type,
  CASE WHEN u.kind = 'table' THEN 'Lines of order ' || u.o_orderkey || '\\n| Line | Quantity | Price |\\n| --- | --- | --- |' || CASE WHEN l.md IS NULL THEN '' ELSE '\\n' || array_to_string(l.md, '\\n') END
       WHEN u.own = '' THEN u.label ELSE u.own END AS text,
  CASE WHEN u.kind = 'table' THEN '|{"caption": "Lines of order ' || u.o_orderkey || '", "header": ["Line", "Quantity", "Price"], "label": "' || u.label || '", "rows": [' || coalesce(array_to_string(l.js, ', '), '') || ']}'
       WHEN u.kind = 'figure' THEN '|{' || CASE WHEN u.own = '' THEN '' ELSE '"caption": "Totals by line", ' END || '"label": "' || u.label || '", "type": "chart"}' ELSE '' END AS payload,
  'ldu_' || lpad(CAST(u.parent_seq AS VARCHAR), CAST(greatest(4, length(CAST(u.parent_seq AS VARCHAR))) AS INT), '0') AS parent_section_id
  FROM labelled u LEFT JOIN lines l ON u.kind = 'table' AND l.l_orderkey = u.o_orderkey)""".replace("\\\\", "\\")

SECTIONS = """
page_counts AS (SELECT document_id, max(page) AS page_count FROM numbered GROUP BY 1),
heads AS (SELECT document_id, seq, row_number() OVER (PARTITION BY document_id ORDER BY seq) - 1 AS n, text AS title, page AS page_start,
  length(regexp_extract(text, '^([0-9]+(\\.[0-9]+)*)', 1)) - length(replace(regexp_extract(text, '^([0-9]+(\\.[0-9]+)*)', 1), '.', '')) + 1 AS level FROM ldus WHERE kind = 'heading'),
nexts AS (SELECT h.document_id, h.seq, min(x.seq) AS end_seq FROM heads h JOIN heads x ON x.document_id = h.document_id AND x.seq > h.seq AND x.level <= h.level GROUP BY 1, 2),
ranges AS (SELECT h.document_id, 'sec_' || h.n AS section_id, h.n, h.title, h.level, h.page_start, h.seq, e.end_seq,
  greatest(h.page_start, CASE WHEN e.end_seq IS NULL THEN c.page_count ELSE least(c.page_count, CASE WHEN x.page_start > 1 THEN x.page_start - 1 ELSE 1 END) END) AS page_end
  FROM heads h JOIN page_counts c USING (document_id) LEFT JOIN nexts e USING (document_id, seq) LEFT JOIN heads x ON x.document_id = h.document_id AND x.seq = e.end_seq),
members AS (SELECT r.document_id, r.section_id, r.n, r.title, l.ldu_id, l.seq, l.content_type FROM ranges r JOIN ldus l ON l.document_id = r.document_id
  AND l.seq >= r.seq AND (r.end_seq IS NULL OR l.seq < r.end_seq) AND l.page <= r.page_end AND l.page >= r.page_start),
typed AS (SELECT *, CASE content_type WHEN 'table' THEN 'tables' WHEN 'figure' THEN 'figures' WHEN 'list' THEN 'lists' WHEN 'paragraph' THEN 'paragraphs' WHEN 'heading' THEN 'paragraphs' ELSE 'other' END AS data_type FROM members)"""

ROOTS = """
roots AS (SELECT document_id, 'root' AS section_id, string_agg(DISTINCT CASE content_type WHEN 'table' THEN 'tables' WHEN 'figure' THEN 'figures' WHEN 'list' THEN 'lists' WHEN 'paragraph' THEN 'paragraphs' WHEN 'heading' THEN 'paragraphs' ELSE 'other' END, ',' ORDER BY CASE content_type WHEN 'table' THEN 'tables' WHEN 'figure' THEN 'figures' WHEN 'list' THEN 'lists' WHEN 'paragraph' THEN 'paragraphs' WHEN 'heading' THEN 'paragraphs' ELSE 'other' END) AS data_types, count(*) AS units FROM ldus GROUP BY 1)"""

FACTS = """
cells AS (SELECT document_id, seq, k, o.o_orderkey FROM labelled o WHERE kind = 'table'),
table_facts AS (
  SELECT c.document_id, c.seq, row_number() OVER (PARTITION BY l_orderkey, col ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)) AS line, col, CAST(l_linenumber AS VARCHAR) AS entity, ['Line', 'Quantity', 'Price'][col + 1] AS metric,
    [CAST(l_linenumber AS VARCHAR), CAST(CAST(l_quantity AS INT) AS VARCHAR), CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)][col + 1] AS value
  FROM cells c JOIN lineitem ON l_orderkey = c.o_orderkey CROSS JOIN (SELECT unnest([0, 1, 2]) AS col)),
kv_facts AS (SELECT document_id, seq, 'Document' AS entity, regexp_extract(text, '^\\s*([A-Za-z][A-Za-z0-9\\s\\-]+?)\\s*[:\\-]\\s*(.+?)\\s*$', 1) AS metric,
  regexp_extract(text, '^\\s*([A-Za-z][A-Za-z0-9\\s\\-]+?)\\s*[:\\-]\\s*(.+?)\\s*$', 2) AS value FROM ldus
  WHERE kind IN ('paragraph', 'list') AND regexp_matches(text, '^\\s*([A-Za-z][A-Za-z0-9\\s\\-]+?)\\s*[:\\-]\\s*(.+?)\\s*$')),
period_facts AS (SELECT document_id, seq, n, v AS value FROM (
  SELECT document_id, seq, unnest(range(len(vs))) AS n, unnest(vs) AS v FROM (
    SELECT document_id, seq, regexp_extract_all(text, '(?i)(Q[1-4]\\s*[0-9]{4}|FY\\s*[0-9]{4})', 1) AS vs FROM ldus WHERE kind IN ('paragraph', 'list')))),
facts AS (SELECT document_id, seq, 0 AS a, line AS b, col AS c, entity, metric, value, '' AS period FROM table_facts
  UNION ALL SELECT document_id, seq, 0, 0, 0, entity, metric, value, '' FROM kv_facts
  UNION ALL SELECT document_id, seq, 1, n, 0, 'Document', 'period', value, value FROM period_facts)"""

LINES = """
doc_lines AS (SELECT doc_id AS document_id, unnest(range(len(parts))) AS n, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
BLANKS = "regexp_replace(trim(text, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)), '\\s+', ' ', 'g')"

CLAIMS = (
    ("c1", "the Status is F"),
    ("c2", "report says it should not be verified"),
    ("c3", "Quantity 17"),
    ("c4", "zzz nothing"),
    ("c5", "FY 1995 period"),
    ("c6", "every order was urgent"),
)
TOPICS = (("t1", "Status and totals"), ("t2", "order 7"), ("t3", "tables"))


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def half_even(value: str, places: int) -> str:
    """A value's decimal form, rounded half to even."""
    scaled = f"(CAST(CAST({value} AS VARCHAR) AS DECIMAL(28, 18)) * {10**places})"
    low = f"floor({scaled})"
    up = f"({scaled} - {low} > 0.5 OR ({scaled} - {low} = 0.5 AND CAST({low} AS BIGINT) % 2 = 1))"
    return f"CAST(CASE WHEN {up} THEN CAST({low} AS BIGINT) + 1 ELSE CAST({low} AS BIGINT) END AS DOUBLE) / {10**places}"


def claim_rows() -> str:
    return "claims AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{c}')" for i, c in CLAIMS) + ") v(query_id, query))"


KEYWORDS = [(domain, place, term) for place, (domain, terms) in enumerate(DOMAIN_KEYWORDS.items()) for term in terms]
KEYWORD_ROWS = ", ".join(f"('{d}', {p}, '{t}', {max(1, len(DOMAIN_KEYWORDS[d]) // 2)})" for d, p, t in KEYWORDS)
KEYWORD_LIST = "[" + ", ".join(f"'{t}'" for _, _, t in KEYWORDS) + "]"
SIGNALS = """
signals AS (SELECT l_orderkey AS document_id, CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE CAST(l_quantity AS INT) * 20 END AS chars, CAST(l_partkey % 65 AS DOUBLE) / 64 AS image_ratio,
  CAST(l_suppkey % 33 AS DOUBLE) / 64 AS table_ratio, l_linenumber % 3 AS table_regions, 1 + l_partkey % 2 AS columns FROM lineitem)"""
ORIGIN = """
origin_sums AS (SELECT document_id, count(*) AS pages, count(*) FILTER (chars >= 50) AS digital, avg(image_ratio) AS img FROM signals GROUP BY 1),
origin_rows AS (SELECT document_id, pages,
  CASE WHEN digital = 0 THEN 'scanned_image' WHEN digital / pages > 0.1 AND digital / pages < 0.9 THEN 'mixed' WHEN digital / pages >= 0.9 THEN 'native_digital' ELSE 'mixed' END AS origin,
  CASE WHEN digital = 0 THEN 0.9 WHEN digital / pages > 0.1 AND digital / pages < 0.9 THEN CASE WHEN img > 0.5 THEN 0.6 ELSE 0.85 END WHEN digital / pages >= 0.9 THEN CASE WHEN img <= 0.5 THEN 0.95 ELSE 0.75 END ELSE 0.6 END AS origin_confidence
  FROM origin_sums),
layout_sums AS (SELECT document_id, avg(table_ratio) AS t, avg(image_ratio) AS f, avg(table_regions) AS r, max(columns) AS c FROM signals GROUP BY 1),
layout_rows AS (SELECT document_id,
  CASE WHEN (t >= 0.25 OR r >= 2) AND f >= 0.4 THEN 'mixed' WHEN t >= 0.25 OR r >= 2 THEN 'table_heavy' WHEN f >= 0.4 THEN 'figure_heavy' WHEN c >= 2 THEN 'multi_column' ELSE 'single_column' END AS layout,
  CASE WHEN (t >= 0.25 OR r >= 2) AND f >= 0.4 THEN 0.85 WHEN t >= 0.25 OR r >= 2 THEN 0.9 WHEN f >= 0.4 THEN 0.9 WHEN c >= 2 THEN 0.85 ELSE 0.95 END AS layout_confidence FROM layout_sums)"""
COST = """
cost_rows AS (SELECT document_id, origin, layout, CASE WHEN origin = 'scanned_image' THEN 'needs_vision_model' WHEN origin = 'native_digital' AND layout = 'single_column' THEN 'fast_text_sufficient'
  ELSE 'needs_layout_model' END AS estimated_cost FROM origin_rows JOIN layout_rows USING (document_id))"""
CASCADE = """
chains AS (SELECT *, CASE WHEN estimated_cost = 'needs_vision_model' THEN ['vision', 'layout'] WHEN estimated_cost = 'fast_text_sufficient' THEN ['fast_text', 'layout', 'vision'] ELSE ['layout', 'vision'] END AS chain FROM cost_rows),
steps AS (SELECT document_id, unnest(range(len(chain))) AS step, unnest(chain) AS strategy FROM chains),
scored AS (SELECT *, CASE strategy WHEN 'fast_text' THEN 1 WHEN 'layout' THEN 2 ELSE 3 END AS s FROM steps),
tries AS (SELECT *, (document_id + s) % 4 <> 0 AS given, CAST((document_id * 7 + s * 3) % 10 AS DOUBLE) / 10 AS confidence, CASE WHEN (document_id + s) % 5 = 0 THEN 'n' || s END AS own_note, strategy = 'vision' AND document_id % 11 = 0 AS refused FROM scored),
gated AS (SELECT *, given AND NOT refused AND confidence >= CASE WHEN strategy = 'vision' THEN 0.0 ELSE 0.5 END AS ok FROM tries),
walked AS (SELECT *, coalesce(max(CAST(ok OR refused AS INT)) OVER (PARTITION BY document_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM gated),
noted AS (SELECT *, CASE WHEN refused THEN 'budget_exceeded' WHEN ok OR NOT given THEN own_note ELSE 'confidence_below_threshold' END AS note FROM walked WHERE ended = 0),
results AS (SELECT document_id, coalesce(max(strategy) FILTER (ok), 'escalation_failed') AS strategy_used, coalesce(arg_max(confidence, step) FILTER (NOT refused), 0.0) AS confidence,
  string_agg(strategy, '>' ORDER BY step) AS chain, string_agg(note, '; ' ORDER BY step) AS notes FROM noted GROUP BY 1)"""
VECTORS = """
pairs AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label,
  list_sum([(CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(v.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) for i in range(1, len(v.embedding) + 1)]) AS distance
  FROM embeddings v CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"""
TOP = "SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS rank FROM pairs{where}) WHERE rank <= 5"

ORACLE_SQL: dict[str, str] = {
    "content_hash": f"{with_(LINES)} SELECT document_id, n, substr(sha256('paragraph|' || {BLANKS}), 1, 16) AS content_hash FROM doc_lines WHERE {BLANKS} <> ''",
    "token_count": f"{with_(LINES)} SELECT document_id, n, len(string_split({BLANKS}, ' ')) AS tokens FROM doc_lines WHERE {BLANKS} <> ''",
    "block_classification": rf"""{with_(LINES)}, t AS (SELECT document_id, n, {BLANKS} AS text FROM doc_lines)
SELECT document_id, n, (length(text) <= 80 AND regexp_matches(text, '^[0-9]+(\.[0-9]+)*\.?\s+\S+')) OR (length(text) <= 60 AND regexp_matches(text, '\p{{Lu}}') AND NOT regexp_matches(regexp_replace(text, '\p{{Lu}}', '', 'g'), '\p{{L}}')) AS heading,
regexp_matches(text, '^([-*•]\s+|\(?[0-9]+[).\]]\s+|\(?[a-zA-Z][).\]]\s+)') AS listed FROM t WHERE text <> ''""",
    "ldu_chunking": f"""{with_(ENTRIES)} SELECT document_id, ldu_id, content_type, text, page, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token_count,
substr(sha256(content_type || '|' || regexp_replace(text, '\\s+', ' ', 'g') || payload), 1, 16) AS content_hash, parent_section_id FROM ldus""",
    "section_carry_forward": f"{with_(ENTRIES)} SELECT content_type, count(*) AS units, count(parent_section_id) AS with_parent, count(DISTINCT document_id || parent_section_id) AS parents FROM ldus GROUP BY 1",
    "cross_references": f"""{with_(ENTRIES)}, refs AS (SELECT a.document_id, a.ldu_id || ' ' || b.ldu_id AS ref FROM (SELECT document_id, ldu_id, seq, unnest(['Table ' || regexp_extract(text, 'Table ([0-9]+)', 1), 'Figure 1']) AS label FROM ldus WHERE kind = 'paragraph' AND text LIKE 'See Table %') a
JOIN ldus b ON b.document_id = a.document_id AND b.label = a.label AND b.seq < a.seq)
SELECT document_id, count(*) AS refs, {digest_sum("ref")} AS digest FROM refs GROUP BY 1""",
    "section_ranges": f"{with_(ENTRIES, SECTIONS)} SELECT document_id, section_id, title, level, page_start, page_end FROM ranges",
    "section_membership": f"{with_(ENTRIES, SECTIONS)} SELECT document_id, section_id, ldu_id FROM members",
    "section_data_types": f"{with_(ENTRIES, SECTIONS, ROOTS)} SELECT * FROM roots UNION ALL SELECT document_id, section_id, string_agg(DISTINCT data_type, ',' ORDER BY data_type) AS data_types, count(*) AS units FROM typed GROUP BY 1, 2",
    "table_facts": f"{with_(ENTRIES, FACTS)} SELECT document_id, seq, entity, metric, value FROM table_facts WHERE value <> ''",
    "keyvalue_facts": f"{with_(ENTRIES, FACTS)} SELECT document_id, seq, metric, value FROM kv_facts",
    "period_facts": f"{with_(ENTRIES, FACTS)} SELECT document_id, seq, value FROM (SELECT DISTINCT document_id, seq, value FROM period_facts)",
    "fact_search": f"""{with_(ENTRIES, FACTS, claim_rows())}, terms AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM claims),
found AS (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, seq, a, b, c) AS rank FROM found)
SELECT query_id, CAST(rank AS INT) AS rank, document_id, entity, metric, value FROM ranked WHERE rank <= 20""",
    "claim_audit": f"""{with_(ENTRIES, FACTS, claim_rows())}, terms AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM claims),
hits AS (SELECT query_id, least(20, count(*)) AS n FROM (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)) GROUP BY 1),
solid AS (SELECT DISTINCT query_id FROM terms WHERE length(term) >= 2 AND term NOT IN ('the', 'is', 'report', 'says', 'it', 'should', 'not', 'be', 'verified', 'every', 'was'))
-- each claim of substance has its nearest units, 10 of them, whatever they say: all have pages, boxes and hashes
SELECT c.query_id, CASE WHEN s.query_id IS NULL THEN 0 ELSE coalesce(h.n, 0) + (SELECT least(10, count(*)) FROM ldus) END AS n_items, CASE WHEN s.query_id IS NULL THEN 'unverifiable' ELSE 'verified' END AS status FROM claims c LEFT JOIN solid s USING (query_id) LEFT JOIN hits h USING (query_id)""",
    "vector_topk": f"{with_(VECTORS)} {TOP.format(where='')}",
    "vector_topk_filtered": f"{with_(VECTORS)} {TOP.format(where=' WHERE label IN (1, 3)')}",
    "section_narrowed_search": f"{with_(VECTORS)} {TOP.format(where=' WHERE label = 2')}",
    "origin_rules": f"{with_(SIGNALS, ORIGIN)} SELECT document_id, pages, origin, origin_confidence FROM origin_rows",
    "layout_rules": f"{with_(SIGNALS, ORIGIN)} SELECT document_id, layout, layout_confidence FROM layout_rows",
    "cost_rules": f"{with_(SIGNALS, ORIGIN, COST)} SELECT document_id, origin, layout, estimated_cost FROM cost_rows",
    "strategy_cascade": f"{with_(SIGNALS, ORIGIN, COST, CASCADE)} SELECT document_id, strategy_used, confidence, chain, notes FROM results",
    "ledger_summary": f"{with_(SIGNALS, ORIGIN, COST, CASCADE)} SELECT strategy_used, count(*) AS documents, round(sum(confidence), 4) AS confidence FROM results GROUP BY 1",
    "domain_rules": f"""WITH texts AS (SELECT p_partkey AS document_id, 'The ' || {KEYWORD_LIST}[CAST(p_partkey % 37 AS INT) + 1] || ' and the ' || {KEYWORD_LIST}[CAST(p_size % 30 AS INT) + 1] || ' of ' || {KEYWORD_LIST}[CAST((p_partkey + p_size) % 30 AS INT) + 1] AS text FROM part),
kw AS (SELECT * FROM (VALUES {KEYWORD_ROWS}) v(domain, place, term, half)),
hits AS (SELECT document_id, domain, place, least(1.0, count(*) / any_value(half)) AS score FROM texts JOIN kw ON contains(lower(text), term) GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, place) AS r FROM hits)
SELECT t.document_id, CASE WHEN b.score >= 0.3 THEN b.domain ELSE 'general' END AS domain, round(CASE WHEN b.score >= 0.3 THEN least(0.95, 0.3 + 0.5 * b.score) ELSE 0.5 END, 6) AS domain_confidence FROM texts t LEFT JOIN best b ON b.document_id = t.document_id AND b.r = 1""",
    "fast_text_confidence": """WITH p AS (SELECT l_orderkey AS document_id, count(*) AS pages, sum(CAST(l_quantity AS INT) * 3) AS chars, count(*) * 480000.0::DOUBLE AS area, sum(CAST(l_quantity AS INT) * 3000)::DOUBLE AS text_area, sum((l_suppkey % 8) * 60000)::DOUBLE AS image_area,
count(*) FILTER (CAST(l_quantity AS INT) * 3 < 50) AS low, count(*) FILTER (l_partkey % 4 <> 0) AS fonts FROM lineitem GROUP BY 1),
r AS (SELECT *, chars / (area / 10000.0) AS d, image_area / area AS img, greatest(0.0, 1.0 - text_area / area - image_area / area) AS white, low / pages AS ls FROM p)
SELECT document_id, CAST(chars AS BIGINT) AS chars, pages, low AS low_pages, (ls > 0.5 OR chars < 50) AS missing_text, round(greatest(0.0, least(1.0, (CASE WHEN d < 1.0 THEN greatest(0.0, d) ELSE 1.0 END) * (CASE WHEN img > 0.5 THEN greatest(0.0, 1.0 - (img - 0.5) / 0.5) ELSE 1.0 END)
* (CASE WHEN ls > 0 THEN 1.0 - ls * 0.5 ELSE 1.0 END) * (CASE WHEN fonts = 0 AND chars > 0 THEN 0.8 ELSE 1.0 END) * (CASE WHEN ls > 0.5 OR chars < 50 THEN 0.7 ELSE 1.0 END) * (CASE WHEN white > 0.8 THEN 0.9 ELSE 1.0 END))), 6) AS score FROM r""",
    "density_stats": f"""SELECT l_orderkey AS document_id, count(*) AS pages, CAST(sum(CAST(l_quantity AS INT) * 3) AS BIGINT) AS chars, {half_even("sum(CAST(l_quantity AS INT) * 3000)::DOUBLE / (count(*) * 480000)", 4)} AS text_ratio,
{half_even("sum((l_suppkey % 8) * 60000)::DOUBLE / (count(*) * 480000)", 4)} AS image_ratio, {half_even("sum(CAST(l_quantity AS INT) * 3)::DOUBLE / (count(*) * 480000)", 6)} AS char_density FROM lineitem GROUP BY 1""",
    "provenance_dedupe": """SELECT query_id, document_id, page_number, content_hash, source, rank FROM (SELECT l_suppkey % 50 AS query_id, CAST(l_partkey % 200 AS VARCHAR) AS document_id, l_linenumber AS page_number, l_returnflag AS content_hash, l_linenumber % 2 AS source, l_orderkey AS rank,
row_number() OVER (PARTITION BY l_suppkey % 50, l_partkey % 200, l_linenumber, l_returnflag ORDER BY l_linenumber % 2, l_orderkey) AS n FROM lineitem) WHERE n = 1""",
    "chunk_validation": f"""{with_(ENTRIES)}, bad AS (SELECT document_id, seq, kind, CASE WHEN seq % 83 = 0 THEN NULL ELSE parent_section_id END AS parent, max(kind = 'heading') OVER (PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ldus)
SELECT document_id, code, count(*) AS errors FROM (SELECT document_id, 'PAGE_REFS_EMPTY' AS code FROM bad WHERE seq % 97 = 0 UNION ALL SELECT document_id, 'CONTENT_HASH_MISSING' FROM bad WHERE seq % 89 = 0
UNION ALL SELECT document_id, 'PARENT_SECTION_MISSING' FROM bad WHERE seen AND kind <> 'heading' AND parent IS NULL) GROUP BY 1, 2""",
    "topic_topn": f"""{with_(ENTRIES, SECTIONS)}, types AS (SELECT document_id, section_id, list(DISTINCT data_type) AS dts FROM typed GROUP BY 1, 2),
topics AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(topic), '\\W+'), lambda w: length(w) > 1)) AS toks FROM (VALUES {", ".join(f"('{i}', '{t}')" for i, t in TOPICS)}) v(topic_id, topic)),
scored AS (SELECT t.topic_id, r.document_id, r.section_id, r.n, CAST(CASE WHEN contains(lower(r.title), lower(t.topic)) THEN 10 ELSE 0 END + 3 * len(list_filter(t.toks, lambda w: contains(lower(r.title), w)))
+ len(list_filter(coalesce(y.dts, []), lambda d: contains(d, lower(t.topic)) OR len(list_filter(t.toks, lambda w: contains(d, w))) > 0)) AS DOUBLE) AS score FROM ranges r CROSS JOIN topics t LEFT JOIN types y USING (document_id, section_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id, document_id ORDER BY score DESC, n) AS rank FROM scored) SELECT topic_id, document_id, section_id, score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3""",
    "deterministic_embedding": """WITH h AS (SELECT item_id, sha256(text) AS s FROM benchmark), b AS (SELECT item_id, [CAST('0x' || substr(s, 2 * i + 1, 2) AS INT) for i in range(0, 32)] AS o FROM h),
v AS (SELECT item_id, [xor(o[i + 1], o[(i + 1) % 32 + 1]) / 255.0 - 0.5 for i in range(0, 32)] AS r FROM b), z AS (SELECT item_id, r, sqrt(12 * list_sum([x * x for x in r])) AS size FROM v)
SELECT item_id, CAST(i AS INT) AS place, round(r[CAST(i % 32 AS INT) + 1] / size, 9) AS value FROM z, range(384) p(i)""",
}
