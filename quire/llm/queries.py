"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, infill, lines, mixing, pii, quality, sharding, simhash, tokens, toxicity, tries, urls, vectors

#: The vocabulary whose pieces op1 counts, among the public tokenizer files.
VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        return tokens.count_tokens(table(spark, sf_dir, "documents"), file.read())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removals(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), urls.rules(spark))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokens": op1_tokens,
    "op2_decontamination": op2_decontamination,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_embeddings": op5_embeddings,
    "op6_lines": op6_lines,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_infill": op11_infill,
    "op12_urls": op12_urls,
    "op13_trie": op13_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": r"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
cut AS (SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM texts),
made AS (SELECT DISTINCT side, id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM cut)),
sizes AS (SELECT id, count(*) AS n FROM made WHERE side = 'b' GROUP BY 1)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS item_shingles, count(*) AS found, count(*) / any_value(n) AS containment
FROM made d JOIN made b ON d.side = 'd' AND b.side = 'b' AND d.s = b.s JOIN sizes z ON z.id = b.id GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n) - 1e-9""",
    "op5_embeddings": """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
u AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y for y in e])) for x in e] AS e FROM v WHERE label IS NOT NULL AND list_sum([abs(y) for y in e]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c AS component_id, c = v.vec_id AS kept FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op10_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM d GROUP BY 1),
total AS (SELECT 1.5 * sum(source_size) AS budget FROM s),
levels AS (SELECT 0 AS step, CAST(budget / (SELECT sum(w) FROM s) AS DOUBLE) AS level FROM total
  UNION ALL SELECT step + 1, (SELECT (any_value(t.budget) - sum(CASE WHEN w * l.level > 2 * source_size THEN 2 * source_size ELSE 0 END)) / sum(CASE WHEN w * l.level > 2 * source_size THEN 0 ELSE w END) FROM s, total t) FROM levels l WHERE step < 30),
goals AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(2.0 * source_size AS DOUBLE), CAST(w * (SELECT level FROM levels WHERE step = 30) AS DOUBLE)) AS target FROM s),
parts AS (SELECT *, CAST(floor(target / nullif(source_size, 0)) AS BIGINT) AS whole FROM goals),
by_hash AS (SELECT source, h, sum(size) AS words FROM d GROUP BY 1, 2),
run AS (SELECT b.source, b.h, words, sum(words) OVER (PARTITION BY b.source ORDER BY b.h) - words AS before, p.target - p.source_size * coalesce(p.whole, 0) AS rest FROM by_hash b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source),
chosen AS (SELECT source, h, before + words <= rest OR (before <= rest AND words - (rest - before) < rest - before) AS more FROM run)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (coalesce(p.whole, 0) + CASE WHEN c.more THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h""",
    "op11_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2, CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_urls": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS own FROM u),
s AS (SELECT page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(own) + 1), '^[^?#]*') AS path, substring(rest, length(own) + 1) AS tail FROM h),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, host, path)),
fits AS (SELECT page_id, s.host, s.path, max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) AS best FROM s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path) GROUP BY 1, 2, 3),
words AS (SELECT * FROM (VALUES ('adult-'), ('spam-'), ('casino-'), ('porn-'), ('warez.')) w(word)),
others AS (SELECT * FROM (VALUES ('/ads/'), ('/adserver/'), ('/xxx/'), ('/gambling/'), ('?sessionid='), ('&sessionid='), ('/ads/policy/')) w(part)),
found AS (SELECT page_id, host, path, tail, '||' || word || '*' AS pattern, CASE WHEN regexp_matches(host || tail, '^([^/?#]*[.])?' || regexp_escape(word)) THEN true END AS fit FROM s, words
  UNION ALL SELECT page_id, host, path, tail, part, CASE WHEN contains(host || tail, part) THEN true END FROM s, others),
longest AS (SELECT page_id, host, path, tail, max(struct_pack(n := length(pattern), pattern := pattern)) AS p FROM found WHERE fit GROUP BY 1, 2, 3, 4)
SELECT s.page_id, s.host, s.path, best.rule AS rule, coalesce(best.verdict, CASE WHEN p.pattern IS NOT NULL AND p.pattern <> '/ads/policy/' THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce('||' || best.rule, p.pattern) AS pattern
FROM s LEFT JOIN fits f ON f.page_id = s.page_id AND f.host = s.host AND f.path = s.path LEFT JOIN longest l ON l.page_id = s.page_id AND l.host = s.host AND l.tail = s.tail""",
    "op13_trie": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns FROM t GROUP BY 1),
cut AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(CAST(a AS BIGINT), CAST(x AS BIGINT)) >> 1, 3988292384 * (xor(CAST(a AS BIGINT), CAST(x AS BIGINT)) & 1))), 4294967295) % 4 AS h FROM own),
whole AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
ids AS (SELECT conv_id, list_transform(turns, lambda t: md5(length(t.role) || ':' || t.role || t.text)) AS key, list_transform(turns, lambda t: len(regexp_extract_all(t.text, '[^ 	-]+'))) AS words FROM whole),
spot AS (SELECT conv_id, key, words, unnest(range(0, len(key) + 1)) AS depth FROM ids),
node AS (SELECT depth, key[1:depth] AS path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(words[depth], 0)) AS words,
  coalesce(sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(key) = depth)), sha256('')) AS ends_sha256 FROM spot GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1, 2),
known AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)),
up AS (SELECT depth AS own, path AS whole, n_children, (n_convs - 1) * words AS saved, unnest(range(0, depth + 1)) AS depth FROM known),
sums AS (SELECT depth, whole[1:depth] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY 1, 2)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.depth = k.depth AND s.path = k.path LEFT JOIN node p ON p.depth = k.depth - 1 AND p.path = k.path[1:k.depth - 1]""",
}
