"""Queries over stores, indexes and answers, each beside the DuckDB SQL that states its result from the inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions import vectors as vx
from quire.operators import fact_index as facts_index
from quire.operators import chunking, facts, memo, retrieval, sections, triage
from quire.operators import trees as section_trees
from quire.operators import vector_index as vectors_index
from quire.plans import derived
from quire.plans.derived import table
from quire.plans.oracle import CLAIMS, COST, FACTS, ORACLE_SQL, ORIGIN, SECTIONS, SIGNALS, claim_rows, digest_sum, half_even, with_
from quire.plans.oracle import ENTRIES as UNITS
from quire.plans.storage import folder, stored
from quire.plans.schemas import FACTS as FACTS_SCHEMA
from quire.sources import batches, readers, sinks

HASH = "substr(sha256(content_type || '|' || regexp_replace(text, '\\s+', ' ', 'g') || payload), 1, 16)"


def place(spark: SparkSession, name: str) -> str:
    """A folder of its own, which goes when the program ends."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLAIMS), "query_id string, query string")


def index_of(spark: SparkSession, sf_dir: str, summarizer=None) -> DataFrame:
    return sections.build_index(derived.ldus(spark, sf_dir), derived.page_counts(spark, sf_dir), summarizer)


def ldu_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = F.get("bounding_boxes", F.lit(0))
    return derived.ldus(spark, sf_dir).select("document_id", "ldu_id", *[boxes[s].alias(s) for s in ("x0", "y0", "x1", "y1")], F.size("page_refs").alias("pages"))


BOXES = f"""{with_(UNITS)}, spans AS (SELECT document_id, seq, min(ord) AS low, max(ord) + 8 AS high FROM started GROUP BY 1, 2)
SELECT l.document_id, l.ldu_id, 10.0::DOUBLE AS x0, CAST(low AS DOUBLE) AS y0, 110.0::DOUBLE AS x1, CAST(high AS DOUBLE) AS y1, 1 AS pages FROM ldus l JOIN spans s ON s.document_id = l.document_id AND s.seq = l.seq"""


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written, those of some documents put in place of what they had, read again and searched."""
    found, path = facts.extract_facts(derived.ldus(spark, sf_dir)), place(spark, "facts")
    sinks.write_facts(found, path)
    # what is counted, numbered and written is extracted once
    sinks.write_facts(stored(found.filter(F.endswith("document_id", F.lit("7")))), path, replace_documents=True)
    hits = facts.search_facts(readers.facts(spark, path), claims(spark))
    return hits.select("query_id", "rank", "document_id", "entity", "metric", "value")


STORED_FACTS = f"""{with_(UNITS, FACTS, claim_rows())}, terms AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM claims),
found AS (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id LIKE '%7', document_id, seq, a, b, c) AS rank FROM found)
SELECT query_id, CAST(rank AS INT) AS rank, document_id, entity, metric, value FROM ranked WHERE rank <= 20"""


def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after facts were appended twice and some documents' replaced: numbers of facts and of ids."""
    found, path = stored(facts.text_facts(derived.ldus(spark, sf_dir))), place(spark, "facts")
    sinks.write_facts(found, path)
    sinks.write_facts(found, path)
    sinks.write_facts(found.filter(F.endswith("document_id", F.lit("7"))), path, replace_documents=True)
    rows = readers.facts(spark, path)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("fact_id").alias("ids"))


FACT_IDS = f"""{with_(UNITS, FACTS)}, found AS (SELECT * FROM facts WHERE NOT (entity <> 'Document')), per AS (SELECT document_id, count(*) * CASE WHEN document_id LIKE '%7' THEN 1 ELSE 2 END AS n FROM (
  SELECT DISTINCT document_id, seq, a, CASE WHEN a = 1 THEN value ELSE metric END AS what, value FROM found) GROUP BY document_id) SELECT document_id, CAST(n AS BIGINT) AS facts, CAST(n AS BIGINT) AS ids FROM per"""


def replaced_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored after documents were processed again: those that have no facts any more, and what one writer put beside another.

    All facts are stored; then documents that end in 7 come again, with facts only if they end in 17; meanwhile facts of
    those that end in 3 are stored once more. Then all batches are made one, and a last one comes after it.
    """
    found, path = stored(facts.text_facts(derived.ldus(spark, sf_dir))), place(spark, "facts")
    ending = lambda df, end: df.filter(F.endswith("document_id", F.lit(end)))
    sinks.write_facts(found, path)
    sinks.write_facts(ending(found, "3"), path)
    sinks.write_facts(ending(found, "17"), path, replace_documents=True, documents=ending(derived.page_counts(spark, sf_dir), "7"))
    batches.compact(spark, path, FACTS_SCHEMA, number="fact_id")
    sinks.write_facts(ending(found, "9"), path, replace_documents=True)
    rows = readers.facts(spark, path)
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("fact_id").alias("ids"))


REPLACED_FACTS = f"""{with_(UNITS, FACTS)}, found AS (SELECT * FROM facts WHERE NOT (entity <> 'Document')), per AS (SELECT document_id, count(*) * CASE WHEN document_id LIKE '%3' THEN 2 ELSE 1 END AS n FROM (
  SELECT DISTINCT document_id, seq, a, CASE WHEN a = 1 THEN value ELSE metric END AS what, value FROM found) WHERE document_id NOT LIKE '%7' OR document_id LIKE '%17' GROUP BY document_id)
SELECT document_id, CAST(n AS BIGINT) AS facts, CAST(n AS BIGINT) AS ids FROM per"""


def fact_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references as JSON text, and what is read back from it."""
    rows = sinks.facts_with_references(facts.text_facts(derived.ldus(spark, sf_dir)).filter(F.col("at.a") == 0))
    back = facts.reference_read(F.col("source_reference"))
    return rows.select("document_id", "seq", "source_reference", back["ldu_id"].alias("ldu_id"), back["page"].alias("page"), F.array_join(back["bbox"].cast("array<string>"), ",").alias("bbox"))


FACT_REFERENCES = f"""{with_(UNITS, FACTS)}, spans AS (SELECT document_id, seq, min(ord) AS low, max(ord) + 8 AS high FROM started GROUP BY 1, 2)
SELECT l.document_id, l.seq, '{{"bbox":[10.0,' || low || '.0,110.0,' || high || '.0],"content_hash":"' || {HASH} || '","document_id":"' || l.document_id || '","ldu_id":"' || ldu_id || '","page":' || page || '}}' AS source_reference,
ldu_id, page, '10.0,' || low || '.0,110.0,' || high || '.0' AS bbox FROM kv_facts k JOIN ldus l ON l.document_id = k.document_id AND l.seq = k.seq JOIN spans s ON s.document_id = l.document_id AND s.seq = l.seq"""


def reference_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and boxes of units as JSON, read back, and the text that is embedded for units without one of their own."""
    units = derived.ldus(spark, sf_dir)
    rows = units.select("document_id", "ldu_id", "content_type", "text", "raw_payload", retrieval.page_refs_json(units).alias("pages"), retrieval.boxes_json(units).alias("boxes"))
    pages, boxes = retrieval.references_read(F.col("pages"), F.col("boxes"))
    bare = rows.withColumn("text", F.when(F.col("content_type") == "paragraph", F.col("text")).otherwise("  "))
    return bare.select("document_id", "ldu_id", "pages", "boxes", F.get(pages, F.lit(0)).alias("page"), F.get(boxes, F.lit(0))["y0"].alias("y0"), F.substring(retrieval.searchable(bare), 1, 60).alias("content"))


REFERENCE_JSON = f"""{with_(UNITS)}, spans AS (SELECT document_id, seq, min(ord) AS low, max(ord) + 8 AS high FROM started GROUP BY 1, 2)
SELECT l.document_id, l.ldu_id, '[' || page || ']' AS pages, '[[10.0, ' || low || '.0, 110.0, ' || high || '.0]]' AS boxes, page, CAST(low AS DOUBLE) AS y0,
substr(CASE WHEN content_type = 'paragraph' THEN text WHEN payload <> '' THEN payload[2:] WHEN content_type = 'list' THEN '{{"list_complete": true}}' ELSE ' ' END, 1, 60) AS content
FROM ldus l JOIN spans s ON s.document_id = l.document_id AND s.seq = l.seq"""


def json_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON strings of document starts in ASCII: what is beyond it is escaped."""
    rows = derived.document_lines(spark, sf_dir).filter("n = 0")
    text = F.concat(F.substring("text", 1, 40), F.lit(' "é😀" \\'))
    return rows.select("document_id", tx.json_ascii(tx.json_string(text)).alias("json"))


JSON_ESCAPES = """WITH t AS (SELECT doc_id AS document_id, substr(string_split(text, chr(10))[1], 1, 40) || ' "é😀" \\' AS s FROM documents WHERE text IS NOT NULL),
c AS (SELECT document_id, i, s[i] AS c, unicode(s[i]) AS u FROM t, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS i)),
e AS (SELECT document_id, i, CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN u = 9 THEN '\\t' WHEN u = 13 THEN '\\r' WHEN u < 128 THEN c WHEN u < 65536 THEN '\\u' || lower(lpad(hex(u), 4, '0'))
  ELSE '\\u' || lower(hex(55296 + ((u - 65536) >> 10))) || '\\u' || lower(hex(56320 + ((u - 65536) & 1023))) END AS x FROM c)
SELECT document_id, '"' || string_agg(x, '' ORDER BY i) || '"' AS json FROM e GROUP BY 1"""


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors upserted twice, the second time half of them with other contents, and read again."""
    rows, path = table(spark, sf_dir, "embeddings"), place(spark, "vectors")

    def made(word: str, every: int) -> DataFrame:
        some = rows.filter(F.col("vec_id") % every == 0)
        vectors = some.select(F.concat(F.lit("d"), F.coalesce("label", F.lit(-1)).cast("string")).alias("document_id"), F.col("vec_id").cast("string").alias("ldu_id"), F.lit(1).alias("seq"), F.lit(word).alias("content"))
        box = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>").alias("bbox")
        return vectors.select("*", F.lit("paragraph").alias("content_type"), F.lit(1).alias("page_number"), F.lit(word).alias("content_hash"), box, F.lit(None).cast("string").alias("parent_section_id"), F.array(F.lit(1.0)).alias("embedding"))

    sinks.upsert_vectors(made("first", 2), path)
    sinks.upsert_vectors(made("second", 3), path)
    sinks.upsert_vectors(made("second", 3), path)
    return readers.vectors(spark, path).select("document_id", "ldu_id", "content")


STORED_VECTORS = """SELECT 'd' || coalesce(label, -1) AS document_id, CAST(vec_id AS VARCHAR) AS ldu_id, CASE WHEN vec_id % 3 = 0 THEN 'second' ELSE 'first' END AS content FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0"""


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each fiftieth vector, from an index of cells: what vector_topk finds by comparing all."""
    rows, path = table(spark, sf_dir, "embeddings"), place(spark, "cells")
    vectors_index.write(rows, path)
    asked = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = vectors_index.nearest(spark, path, asked, 5, keys=("vec_id",))
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def fact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that claims find in all documents, from an index of grams and words: what fact_search finds."""
    path = place(spark, "facts-index")
    facts_index.write(facts.extract_facts(derived.ldus(spark, sf_dir)), path)
    return facts_index.search(spark, path, claims(spark)).select("query_id", "rank", "document_id", "entity", "metric", "value")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "index")
    sinks.write_index(index_of(spark, sf_dir), path)
    back = readers.section_index(spark, path)
    return back.select("document_id", "section_id", "parent_id", "title", "level", "page_start", "page_end", F.size("ldu_ids").cast("long").alias("units"))


STORED_INDEX = f"""{with_(UNITS, SECTIONS)}, sizes AS (SELECT document_id, section_id, count(*) AS units FROM members GROUP BY 1, 2)
SELECT document_id, section_id, 'root' AS parent_id, title, 1 AS level, page_start, page_end, coalesce(units, 0) AS units FROM ranges LEFT JOIN sizes USING (document_id, section_id)
UNION ALL SELECT document_id, 'root', NULL, 'Document', 0, 1, page_count, (SELECT count(*) FROM ldus l WHERE l.document_id = p.document_id) FROM page_counts p"""


def index_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = sinks.index_trees(index_of(spark, sf_dir))
    at = lambda path, kind: F.get_json_object("tree", path).cast(kind)
    first = "$.root.child_sections[0]"
    return trees.select(
        "document_id", at("$.page_count", "int").alias("page_count"), at("$.root.id", "string").alias("root"), F.json_array_length(F.get_json_object("tree", "$.root.child_sections")).alias("sections"),
        at(f"{first}.id", "string").alias("first"), at(f"{first}.page_end", "int").alias("first_end"), F.json_array_length(F.get_json_object("tree", "$.root.ldu_ids")).alias("units"),
    )


INDEX_TREES = f"""{with_(UNITS, SECTIONS)} SELECT r.document_id, any_value(p.page_count) AS page_count, 'root' AS root, CAST(count(*) AS INT) AS sections, 'sec_0' AS first, max(page_end) FILTER (n = 0) AS first_end,
CAST(any_value(u.units) AS INT) AS units FROM ranges r JOIN page_counts p USING (document_id) JOIN (SELECT document_id, count(*) AS units FROM ldus GROUP BY 1) u USING (document_id) GROUP BY 1"""


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a summarizer that says the title and the start of the content."""
    say = lambda title, content, section_id, document_id: F.concat(title, F.lit(": "), F.substring(content, 1, 50))
    return index_of(spark, sf_dir, say).filter("section_id <> 'root'").select("document_id", "section_id", "summary")


SECTION_SUMMARIES = f"""{with_(UNITS, SECTIONS)}, t AS (SELECT m.document_id, m.section_id, any_value(m.title) AS title, string_agg(l.text, ' ' ORDER BY m.seq) FILTER (place <= 20) AS content
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, section_id ORDER BY seq) AS place FROM members) m JOIN ldus l ON l.document_id = m.document_id AND l.seq = m.seq GROUP BY 1, 2)
SELECT r.document_id, r.section_id, t.title || ': ' || substr(content, 1, 50) AS summary FROM ranges r LEFT JOIN t USING (document_id, section_id)"""


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sections of nested trees: a customer's years, their orders, and the orders' lines, as JSON."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("doc", F.concat(F.lit("d"), F.col("o_custkey").cast("string")))

    def section(ident: Column, title: Column, level: int, children: Column | None) -> Column:
        own = [ident.alias("id"), F.col("doc").alias("document_id"), title.alias("title"), F.lit(level).alias("level"), F.lit(level).alias("page_start"), F.lit(9).alias("page_end")]
        return F.struct(*own, *([] if children is None else [children.alias("child_sections")]))

    line = lambda x: section(F.concat_ws("_", F.lit("l"), F.col("o_orderkey").cast("string"), x["l_linenumber"].cast("string")), x["l_quantity"].cast("int").cast("string"), 3, None)
    one = section(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderstatus"), 2, F.transform(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), line))
    years = orders.groupBy("doc", F.year("o_orderdate").alias("year")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("s")))), lambda x: x["s"]).alias("orders"))
    year = section(F.concat(F.lit("y"), F.col("year").cast("string")), F.lit("Year"), 1, F.col("orders"))
    whole = years.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("year", year.alias("s")))), lambda x: x["s"]).alias("years"))
    tree = F.struct(F.col("doc").alias("document_id"), F.lit(9).alias("page_count"), section(F.lit("root"), F.lit("Document"), 0, F.col("years")).alias("root"))
    found = section_trees.sections(whole.select(F.to_json(tree).alias("tree")))
    return found.select("document_id", "section_id", "parent_id", "n", "title", "level", "page_start", "page_end", "owner", F.size("ldu_ids").alias("units"))


NESTED_INDEX = """WITH o AS (SELECT 'd' || o_custkey AS doc, year(o_orderdate) AS y, o_orderkey AS k, o_orderstatus AS st FROM orders),
flat AS (SELECT DISTINCT doc, 'root' AS id, NULL AS parent, 'Document' AS title, 0 AS level, [0, 0, 0] AS way FROM o UNION ALL SELECT DISTINCT doc, 'y' || y, 'root', 'Year', 1, [y, 0, 0] FROM o
  UNION ALL SELECT doc, 'o' || k, 'y' || y, st, 2, [y, k, 0] FROM o UNION ALL SELECT doc, 'l_' || k || '_' || l_linenumber, 'o' || k, CAST(CAST(l_quantity AS INT) AS VARCHAR), 3, [y, k, row_number() OVER (PARTITION BY k ORDER BY l_linenumber, l_quantity)] FROM o JOIN lineitem ON l_orderkey = k)
SELECT doc AS document_id, id AS section_id, parent AS parent_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY way) - 2 AS INT) AS n, title, level, CAST(level AS INT) AS page_start, 9 AS page_end, doc AS owner, 0 AS units FROM flat"""


def spoken() -> Callable[[list[dict]], list]:
    """A summarizer that says the start of a content, and fails for some titles."""

    def say(rows: list[dict]) -> list:
        if any(row["title"].endswith("3") for row in rows):
            raise ValueError("no summary of this")
        return [row["content"][:20] for row in rows]

    return say


def remembered_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of a model that fails for some sections, asked twice over: what is said, and how often the model gave a summary."""
    path = place(spark, "memo")
    ask = memo.summarizer(path, spoken)

    def asked_twice(contents: DataFrame) -> DataFrame:
        ask(contents)
        return ask(contents)

    index = sections.build_index(derived.ldus(spark, sf_dir), derived.page_counts(spark, sf_dir), said_of=asked_twice).filter("section_id <> 'root'")
    calls = spark.read.parquet(f"{path}/rows").filter("reason is null").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return index.select("document_id", "section_id", "summary").unionByName(calls.select(F.lit("calls").alias("document_id"), F.lit(None).cast("string").alias("section_id"), F.col("n").alias("summary")))


REMEMBERED = SECTION_SUMMARIES.split("SELECT r.document_id, r.section_id, t.title")[0] + """SELECT r.document_id, r.section_id, CASE WHEN t.title NOT LIKE '%3' THEN substr(content, 1, 20) END AS summary FROM ranges r LEFT JOIN t USING (document_id, section_id)
UNION ALL SELECT 'calls', NULL, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT title, content FROM t WHERE title NOT LIKE '%3')"""


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units where every other customer's document has no reading order: its text blocks come by their index, its tables and figures not at all."""
    blocks, tables, figures, order = derived.extracted(spark, sf_dir)
    units = chunking.chunk(blocks, tables, figures, order.filter(F.substring("document_id", 6, 99).cast("int") % 2 == 0))
    digest = F.conv(F.substring(F.md5(F.concat_ws(" ", "ldu_id", "content_type", "text", F.coalesce("parent_section_id", F.lit("-")))), 1, 8), 16, 10).cast("long")
    return units.groupBy("document_id").agg(F.count(F.lit(1)).alias("units"), F.sum(digest).alias("digest"))


INDEX_ORDER = f"""{with_(UNITS.replace("FROM raw_entries", "FROM (SELECT * FROM raw_entries WHERE rt = 'text' OR CAST(substr(document_id, 6) AS INT) % 2 = 0)"))}
SELECT document_id, count(*) AS units, {digest_sum("ldu_id || ' ' || content_type || ' ' || text || ' ' || coalesce(parent_section_id, '-')")} AS digest FROM ldus GROUP BY 1"""


def listed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a list of documents, and of an empty one, which finds none."""
    found = facts.extract_facts(derived.ldus(spark, sf_dir))
    rows = facts.search_facts(found, claims(spark), document_ids=["cust-4", "cust-7", "cust-7", "nowhere"])
    none = facts.search_facts(found, claims(spark), document_ids=[])
    return rows.unionByName(none).select("query_id", "rank", "document_id", "entity", "metric", "value")


LISTED_FACTS = ORACLE_SQL["fact_search"].replace("SELECT DISTINCT query_id, f.* FROM facts f JOIN", "SELECT DISTINCT query_id, f.* FROM (SELECT * FROM facts WHERE document_id IN ('cust-4', 'cust-7')) f JOIN")


def blank_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries where some documents' units have blank texts: sections without content are not put to the summarizer."""
    blank = F.endswith("document_id", F.lit("7"))
    units = derived.ldus(spark, sf_dir).withColumn("text", F.when(blank, F.lit(" \n ")).otherwise(F.col("text")))
    say = lambda title, content, section_id, document_id: F.concat(F.lit("said: "), F.substring(content, 1, 30))
    index = sections.build_index(units, derived.page_counts(spark, sf_dir), say).filter("section_id <> 'root'")
    return index.groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"), F.count("summary").alias("summaries"), F.max("summary").alias("last"))


BLANK_SECTIONS = SECTION_SUMMARIES.split("SELECT r.document_id, r.section_id, t.title")[0] + """SELECT r.document_id, count(*) AS sections, count(content) FILTER (r.document_id NOT LIKE '%7') AS summaries,
max('said: ' || substr(content, 1, 30)) FILTER (r.document_id NOT LIKE '%7') AS last FROM ranges r LEFT JOIN t USING (document_id, section_id) GROUP BY 1"""


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations' document names: from a file of names where it has one, else the id; and the keys of documents by their paths."""
    ids, path = derived.page_counts(spark, sf_dir), place(spark, "names")
    some = ids.filter(F.col("page_count") % 2 == 0).select(F.map_from_entries(F.array(F.struct("document_id", F.concat(F.lit('The "'), "document_id", F.lit('" file.pdf'))))).alias("m"))
    # one JSON object of all names
    whole = some.select(F.to_json("m").alias("json")).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.collect_list("json"), lambda j: F.substring(j, F.lit(2), F.length(j) - 2)), ","), F.lit("}")).alias("value"))
    whole.coalesce(1).write.text(path)
    rows = retrieval.named(ids, readers.document_names(spark, path))
    return rows.select("document_id", "document_name", triage.document_key(F.concat(F.lit("/files/"), "document_id", F.lit(".pdf"))).alias("key"))


NAMED_DOCUMENTS = f"""{with_(UNITS, SECTIONS)} SELECT document_id, CASE WHEN page_count % 2 = 0 THEN 'The "' || document_id || '" file.pdf' ELSE document_id END AS document_name,
substr(sha256('/files/' || document_id || '.pdf'), 1, 32) AS key FROM page_counts"""


def first_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.first_document(index_of(spark, sf_dir)).select("document_id", "section_id", "title")


FIRST_DOCUMENT = f"""{with_(UNITS, SECTIONS)}, f AS (SELECT min(document_id) AS document_id FROM ranges) SELECT document_id, section_id, title FROM ranges JOIN f USING (document_id) UNION ALL SELECT document_id, 'root', 'Document' FROM f"""


def stored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that grew by two batches, read again."""
    path = place(spark, "ledger")
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.when(F.col("o_orderkey") % 3 == 0, "vision").otherwise("layout").alias("strategy_used"), F.col("o_orderdate").alias("start_time"))
    for rest in (0, 1):
        sinks.append_ledger(entries.filter(F.col("document_id").cast("long") % 2 == rest), path)
    back = readers.rows_or_none(spark, path, "document_id string, strategy_used string, start_time timestamp", "json")
    return back.groupBy("strategy_used").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("document_id").alias("documents"), F.max(F.unix_seconds("start_time")).alias("latest"))


STORED_LEDGER = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'vision' ELSE 'layout' END AS strategy_used, count(*) AS runs, count(DISTINCT o_orderkey) AS documents, CAST(max(epoch(o_orderdate)) AS BIGINT) AS latest FROM orders GROUP BY 1"""


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and profiles as JSON lines by buckets of documents, read again; no folder for each document."""
    units, path = derived.ldus(spark, sf_dir), place(spark, "units")
    sinks.write_ldus(units, path)
    back = spark.read.schema("document_id string, ldu_id string, token_count int, bucket int").json(path)
    return back.groupBy("document_id").agg(F.count(F.lit(1)).alias("units"), F.sum("token_count").alias("tokens"), F.count_distinct("bucket").alias("buckets"), F.max("ldu_id").alias("last"))


STORED_UNITS = f"""{with_(UNITS)} SELECT document_id, count(*) AS units, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS tokens, 1 AS buckets, max(ldu_id) AS last FROM ldus GROUP BY 1"""


def stored_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "profiles")
    sinks.write_profiles(derived.cost_rules(spark, sf_dir), path)
    return spark.read.schema("document_id long, origin string, layout string, estimated_cost string").json(path).drop("bucket")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.markdown(derived.ldus(spark, sf_dir)).select("document_id", F.md5(F.col("value").cast("binary")).alias("md5"), F.length("value").cast("long").alias("chars"))


MARKDOWN = f"""{with_(UNITS)}, m AS (SELECT document_id, string_agg(CASE WHEN content_type = 'heading' THEN '## ' || text ELSE replace(text, chr(92) || 'n', chr(10)) END, chr(10) || chr(10) ORDER BY seq) AS v FROM ldus GROUP BY 1)
SELECT document_id, md5(v) AS md5, length(v) AS chars FROM m"""


def stored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "report")
    sinks.write_report(triage.densities(derived.measured_pages(spark, sf_dir)), path)
    return spark.read.schema("document_id long, pages long, chars long, text_ratio double").json(path).drop("bucket")


STORED_REPORT = f"""SELECT l_orderkey AS document_id, count(*) AS pages, CAST(sum(CAST(l_quantity AS INT) * 3) AS BIGINT) AS chars, {half_even("sum(CAST(l_quantity AS INT) * 3000)::DOUBLE / (count(*) * 480000)", 4)} AS text_ratio FROM lineitem GROUP BY 1"""


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines, moved to 0 to 1, of neighbouring vectors."""
    rows = table(spark, sf_dir, "embeddings")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), rows.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y"))
    return a.join(b, "a").select(F.col("a").alias("vec_id"), F.round(vx.similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


SIMILARITIES = """WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings)
SELECT a.vec_id, round(greatest(0, least(1, (list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) + 1) / 2)), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""


def text_table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of tables without a payload, from the lines of their texts."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit("Name | Total\nrow"), k, F.lit(" | "), F.col("o_orderstatus"), F.lit("\nlast\t"), k, F.lit("\n"))
    payload = F.struct(F.lit(None).cast("array<string>").alias("header"), F.lit(None).cast("array<array<string>>").alias("rows"))
    units = table(spark, sf_dir, "orders").select(
        k.alias("document_id"), F.lit("ldu_0001").alias("ldu_id"), F.lit(1).alias("seq"), F.lit("table_section").alias("content_type"), text.alias("text"), payload.alias("raw_payload"),
        F.array(F.lit(4)).alias("page_refs"), F.lit("h").alias("content_hash"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>").alias("bounding_boxes"),
    )
    return facts.table_facts(units).select("document_id", "entity", "metric", "value", "source_page")


TEXT_TABLE_FACTS = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, * FROM orders) SELECT k AS document_id, 'row' || k AS entity, 'Name' AS metric, 'row' || k AS value, 4 AS source_page FROM o
UNION ALL SELECT k, 'row' || k, 'Total', o_orderstatus, 4 FROM o UNION ALL SELECT k, 'last', 'Name', 'last', 4 FROM o UNION ALL SELECT k, 'last', 'Total', k, 4 FROM o"""


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text, and read back from it and from text with a Z."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", tx.utc_text(F.col("o_orderdate").cast("timestamp")).alias("text"))
    back, zulu = tx.utc_time(F.col("text")), tx.utc_time(F.replace("text", F.lit("+00:00"), F.lit("Z")))
    return rows.select("o_orderkey", "text", F.unix_seconds(back).alias("seconds"), (back == zulu).alias("same"), tx.utc_time(F.lit("no time")).isNull().alias("none"))


def small_embedding(text: Column) -> Column:
    """A vector that SQL can make too: a text's length and its first character."""
    return F.array(F.length(text).cast("double"), F.ascii(text).cast("double"))


#: Questions over all documents, over one of them, and over one that has no sections.
QUESTIONS = (("q1", "Status and totals", None), ("q2", "order status quantity", "cust-5"), ("q3", "Quantity 17", "nowhere"), ("q4", "priority", "cust-11"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each answer cites, in order, for questions that go through sections, facts and vectors."""
    units = derived.ldus(spark, sf_dir)
    asked = spark.createDataFrame(list(QUESTIONS), "query_id string, query string, document_id string")
    found = retrieval.answers(asked, index_of(spark, sf_dir), retrieval.embedded(units, small_embedding), facts.extract_facts(units), embed=small_embedding)
    cited = found.select("query_id", "verified", F.posexplode_outer("items").alias("n", "item"))
    return cited.select("query_id", "verified", "n", "item.source", "item.document_id", "item.page_number", "item.snippet")


ANSWERS = f"""{with_(UNITS, SECTIONS, FACTS)}, questions AS (SELECT * FROM (VALUES {", ".join(f"('{q}', '{t}', {'NULL' if d is None else repr(d)})" for q, t, d in QUESTIONS)}) v(query_id, query, only_document)),
types AS (SELECT document_id, section_id, list(DISTINCT data_type) AS dts FROM typed GROUP BY 1, 2),
topics AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\W+'), lambda w: length(w) > 1)) AS toks FROM questions),
scored AS (SELECT t.query_id, r.document_id, r.section_id, r.n, CASE WHEN contains(lower(r.title), lower(t.query)) THEN 10 ELSE 0 END + 3 * len(list_filter(t.toks, lambda w: contains(lower(r.title), w)))
  + len(list_filter(coalesce(y.dts, []), lambda d: contains(d, lower(t.query)) OR len(list_filter(t.toks, lambda w: contains(d, w))) > 0)) AS score
  FROM ranges r JOIN topics t ON t.only_document IS NULL OR t.only_document = r.document_id LEFT JOIN types y USING (document_id, section_id)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, n) AS r FROM scored) WHERE r <= 5),
inside AS (SELECT DISTINCT b.query_id, m.document_id, m.ldu_id FROM best b JOIN members m ON m.document_id = b.document_id AND m.section_id = b.section_id),
near AS (SELECT q.query_id, l.*, (length(l.text) - length(q.query)) ** 2 + (unicode(l.text) - unicode(q.query)) ** 2 AS distance FROM questions q JOIN inside i ON i.query_id = q.query_id JOIN ldus l ON l.document_id = i.document_id AND l.ldu_id = i.ldu_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id, ldu_id) AS rank FROM near) WHERE rank <= 10),
terms AS (SELECT query_id, only_document, unnest(string_split(lower(query), ' ')) AS term FROM questions),
matched AS (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON (t.only_document IS NULL OR t.only_document = f.document_id) AND contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)),
told AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, seq, a, b, c) AS rank FROM matched) WHERE rank <= 20),
cited AS (SELECT query_id, 0 AS source, rank, document_id, page, {HASH} AS hash, trim(substr(text, 1, 300)) AS snippet FROM hits
  UNION ALL SELECT query_id, 1, t.rank, t.document_id, l.page, {HASH.replace("content_type", "l.content_type").replace("(text", "(l.text").replace("|| payload", "|| l.payload")}, substr(entity || ' ' || metric || ' ' || value, 1, 300) FROM told t JOIN ldus l ON l.document_id = t.document_id AND l.seq = t.seq),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, page, hash ORDER BY source, rank) AS r FROM cited) WHERE r = 1)
SELECT q.query_id, o.query_id IS NOT NULL AS verified, CASE WHEN o.query_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY source, rank) - 1 AS INT) END AS n, source, document_id, page AS page_number, snippet
FROM questions q LEFT JOIN once o ON o.query_id = q.query_id"""


#: As QUESTIONS, and one over a document that has vectors but no sections.
TOLD = (*QUESTIONS, ("q5", "order status", "cust-13"), ("q6", "Quantity", "cust-23"))


def said_by_model(question: Column, context: Column) -> Column:
    """A model that answers some questions, and fails for the others."""
    return F.when(F.contains(question, F.lit("Quantity")), F.concat(F.lit("of "), F.length(context).cast("string"), F.lit(" characters: "), F.substring(context, 1, 20)))


def answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their texts and the first document's name. Documents that end in 3 have no sections: of these all units are searched."""
    units = derived.ldus(spark, sf_dir)
    asked = spark.createDataFrame(list(TOLD), "query_id string, query string, document_id string")
    index = index_of(spark, sf_dir).filter(~F.endswith("document_id", F.lit("3")) | (F.col("section_id") == "root"))
    names = derived.page_counts(spark, sf_dir).filter(F.endswith("document_id", F.lit("1"))).select("document_id", F.concat(F.lit("Customer "), F.substring("document_id", 6, 99)).alias("document_name"))
    found = retrieval.answers(asked, index, retrieval.embedded(units, small_embedding), facts.extract_facts(units), names, said_by_model, small_embedding)
    return found.select("query_id", "verified", F.length("answer").alias("chars"), F.md5("answer").alias("answer"), F.size("items").alias("items"), F.get("items", F.lit(0))["document_name"].alias("name"))


ANSWER_TEXTS = (
    ANSWERS.split("\nSELECT q.query_id, o.query_id")[0]
    .replace(", ".join(f"('{q}', '{t}', {'NULL' if d is None else repr(d)})" for q, t, d in QUESTIONS), ", ".join(f"('{q}', '{t}', {'NULL' if d is None else repr(d)})" for q, t, d in TOLD))
    .replace("FROM ranges r JOIN topics t ON t.only_document", "FROM (SELECT * FROM ranges WHERE document_id NOT LIKE '%3') r JOIN topics t ON t.only_document")
    .replace("AND m.section_id = b.section_id),", "AND m.section_id = b.section_id UNION ALL SELECT q.query_id, l.document_id, l.ldu_id FROM questions q JOIN ldus l ON l.document_id = q.only_document WHERE q.query_id NOT IN (SELECT query_id FROM best)),")
    + """,
lines_of AS (SELECT query_id, 0 AS source, rank, '[Source ' || rank || ']' || chr(10) || substr(trim(text), 1, 800) AS line FROM hits WHERE rank <= 8
  UNION ALL SELECT query_id, 1, rank, '[Fact] ' || entity || ' — ' || metric || ': ' || value || CASE WHEN period <> '' THEN ' (' || period || ')' ELSE '' END FROM told WHERE rank <= 5),
context AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY source, rank) AS c FROM lines_of GROUP BY 1),
answer AS (SELECT q.query_id, CASE WHEN c IS NULL THEN 'No relevant content was found in the corpus for this query.' WHEN contains(query, 'Quantity') THEN 'of ' || length(c) || ' characters: ' || substr(c, 1, 20)
  ELSE 'Retrieved context:' || chr(10) || chr(10) || c END AS a FROM questions q LEFT JOIN context USING (query_id)),
cites AS (SELECT query_id, count(*) AS items, arg_min(CASE WHEN document_id LIKE '%1' THEN 'Customer ' || substr(document_id, 6) ELSE document_id END, source * 1000 + rank) AS name FROM once GROUP BY 1)
SELECT a.query_id, items IS NOT NULL AS verified, CAST(length(a) AS INT) AS chars, md5(a) AS answer, CAST(items AS INT) AS items, name FROM answer a LEFT JOIN cites USING (query_id)"""
)


def plain_vectors() -> Callable[[list[str]], list]:
    """A model whose vectors SQL can make too: a text's length and its first character, both moved."""
    return lambda texts: [[float(len(t) - 20), float((ord(t[0]) if t else 0) - 80)] for t in texts]


def ranked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of claims ranked by how near their snippets are, each distinct text embedded once; an empty snippet counts for nothing."""
    found = facts.search_facts(facts.extract_facts(derived.ldus(spark, sf_dir)), claims(spark), limit=9)
    found = found.withColumns({c: F.when(F.col("rank") == 2, "").otherwise(F.col(c)) for c in ("entity", "metric", "value")})
    hits = retrieval.embedded(derived.ldus(spark, sf_dir).limit(0), small_embedding).select(F.lit("").alias("query_id"), F.lit(0).alias("rank"), "*")
    cited = retrieval.evidence(claims(spark), hits, found, least=0.4, vectors_of=lambda texts: memo.embeddings(texts, place(spark, "embeddings"), plain_vectors))
    return cited.select("query_id", "place", "rank", "document_id", "snippet", F.round("similarity", 6).alias("similarity"))


RANKED_EVIDENCE = f"""{with_(UNITS, FACTS, claim_rows())}, terms AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM claims),
found AS (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, seq, a, b, c) AS rank FROM found),
solid AS (SELECT query_id, query FROM claims WHERE len(list_filter(string_split(lower(query), ' '), lambda w: length(w) >= 2 AND w NOT IN ({", ".join(f"'{w}'" for w in tx.CLAIM_STOPWORDS)}))) > 0),
cited AS (SELECT s.query_id, query, rank, r.document_id, l.page, CASE WHEN rank = 2 THEN '' ELSE substr(trim(entity || ' ' || metric || ' ' || value), 1, 300) END AS snippet FROM ranked r JOIN solid s USING (query_id) JOIN ldus l ON l.document_id = r.document_id AND l.seq = r.seq WHERE rank <= 9),
v AS (SELECT *, length(query) - 20 AS qx, unicode(query) - 80 AS qy, length(snippet) - 20 AS sx, unicode(snippet) - 80 AS sy FROM cited WHERE snippet <> ''),
near AS (SELECT *, greatest(0, least(1, ((qx * sx + qy * sy) / nullif(sqrt(qx * qx + qy * qy) * sqrt(sx * sx + sy * sy), 0) + 1) / 2)) AS sim FROM v)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank, document_id, page) AS INT) AS place, CAST(rank AS INT) AS rank, document_id, snippet, round(sim, 6) AS similarity FROM near WHERE sim >= 0.4"""


def audit_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits with evidence from a search of the caller's: facts alone."""
    found = facts.extract_facts(derived.ldus(spark, sf_dir))
    search = lambda asked: retrieval.fact_citations(facts.search_facts(found, asked, limit=3))
    return retrieval.audited(claims(spark), search).select("query_id", "status", "n_items", "response")


AUDIT_RESPONSES = f"""{with_(UNITS, FACTS, claim_rows())}, terms AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM claims),
found AS (SELECT DISTINCT query_id, f.* FROM facts f JOIN terms t ON contains(lower(entity || ' ' || metric || ' ' || value || ' ' || period), term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY document_id, seq, a, b, c) AS rank FROM found),
best AS (SELECT query_id, count(*) AS n, max(entity || ' ' || metric || ' ' || value) FILTER (rank = 1) AS said FROM ranked WHERE rank <= 3 GROUP BY 1)
SELECT c.query_id, CASE WHEN n IS NULL THEN 'unverifiable' ELSE 'verified' END AS status, coalesce(n, 0) AS n_items,
CASE WHEN n IS NULL THEN '{retrieval.UNVERIFIABLE}' ELSE '{retrieval.VERIFIED}' || chr(10) || chr(10) || 'Best matching evidence: "' || said || '"' END AS response FROM claims c LEFT JOIN best USING (query_id)"""

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "ldu_boxes": (ldu_boxes, BOXES),
    "stored_facts": (stored_facts, STORED_FACTS),
    "fact_ids": (fact_ids, FACT_IDS),
    "replaced_facts": (replaced_facts, REPLACED_FACTS),
    "fact_references": (fact_references, FACT_REFERENCES),
    "reference_json": (reference_json, REFERENCE_JSON),
    "json_escapes": (json_escapes, JSON_ESCAPES),
    "stored_vectors": (stored_vectors, STORED_VECTORS),
    "stored_index": (stored_index, STORED_INDEX),
    "vector_index": (vector_index, ORACLE_SQL["vector_topk"]),
    "fact_index": (fact_index, ORACLE_SQL["fact_search"]),
    "index_trees": (index_trees, INDEX_TREES),
    "section_summaries": (section_summaries, SECTION_SUMMARIES),
    "nested_index": (nested_index, NESTED_INDEX),
    "remembered_summaries": (remembered_summaries, REMEMBERED),
    "ranked_evidence": (ranked_evidence, RANKED_EVIDENCE),
    "named_documents": (named_documents, NAMED_DOCUMENTS),
    "index_order": (index_order, INDEX_ORDER),
    "listed_facts": (listed_facts, LISTED_FACTS),
    "blank_sections": (blank_sections, BLANK_SECTIONS),
    "answer_texts": (answer_texts, ANSWER_TEXTS),
    "first_document": (first_document, FIRST_DOCUMENT),
    "stored_ledger": (stored_ledger, STORED_LEDGER),
    "stored_units": (stored_units, STORED_UNITS),
    "stored_profiles": (stored_profiles, f"{with_(SIGNALS, ORIGIN, COST)} SELECT * FROM cost_rows"),
    "markdown": (markdown, MARKDOWN),
    "stored_report": (stored_report, STORED_REPORT),
    "similarities": (similarities, SIMILARITIES),
    "times": (times, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS text, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, true AS same, true AS none FROM orders"),
    "text_table_facts": (text_table_facts, TEXT_TABLE_FACTS),
    "answers": (answers, ANSWERS),
    "audit_responses": (audit_responses, AUDIT_RESPONSES),
}
