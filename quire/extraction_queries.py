"""Queries over extraction, triage and constraints, each beside the DuckDB SQL that states its result from the inputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import extraction, trees, triage, validation
from quire.plans import derived
from quire.plans.config import Rules
from quire.plans.derived import table
from quire.plans.oracle import CASCADE, COST, ORIGIN, SIGNALS, with_
from quire.sources import readers

WIDTH, HEIGHT = 600.0, 800.0


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("document_id", F.col("l_orderkey"))


def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of an order's document: one for each line number."""
    rows = lines(spark, sf_dir).groupBy("document_id", F.col("l_linenumber").alias("page")).agg(F.max((F.col("l_partkey") % 4 != 0).cast("int")).alias("font"))
    return rows.select("document_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), (F.col("font") == 1).alias("has_font"))


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pages = lines(spark, sf_dir).withColumn("page", F.col("l_linenumber")), page_rows(spark, sf_dir)
    many = (F.col("l_quantity").cast("int") % 7).cast("int")
    chars = rows.filter(many > 0).select("document_id", "page", "l_partkey", F.explode(F.sequence(F.lit(1), many)).alias("i"))
    chars = chars.select("document_id", "page", ((F.col("l_partkey") * 13 + F.col("i") * 97) % 640).cast("double").alias("x0"))
    images = rows.filter(F.col("l_suppkey") % 3 == 0).select("document_id", "page", ((F.col("l_suppkey") % 8) * 60).cast("double").alias("width"), F.lit(200.0).alias("height"))
    ruled = rows.filter(F.col("l_linenumber") % 2 == 1)
    tables = ruled.select("document_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), ((F.col("l_partkey") % 10) * 50 + 1).cast("double").alias("x1"), F.lit(100.0).alias("y1"))
    found = triage.page_signals(pages, chars, images, tables)
    return found.withColumns({c: F.round(c, 6) for c in ("image_ratio", "table_ratio")})


PAGE_SIGNALS = """WITH li AS (SELECT l_orderkey AS document_id, l_linenumber AS page, * FROM lineitem), p AS (SELECT DISTINCT document_id, page FROM li),
c AS (SELECT document_id, page, CAST((l_partkey * 13 + i * 97) % 640 AS DOUBLE) AS x0 FROM (SELECT document_id, page, l_partkey, unnest(range(1, CAST(l_quantity AS INT) % 7 + 1)) AS i FROM li)),
ch AS (SELECT document_id, page, count(*) AS chars, count(DISTINCT greatest(0, least(4, CAST(trunc(x0 / CAST(600 AS DOUBLE) * 5) AS INT)))) AS columns FROM c GROUP BY 1, 2),
im AS (SELECT document_id, page, sum(l_suppkey % 8 * 60 * 200) AS area FROM li WHERE l_suppkey % 3 = 0 GROUP BY 1, 2),
tb AS (SELECT document_id, page, sum((l_partkey % 10 * 50 + 1) * 100) AS area, count(*) AS regions FROM li WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
SELECT document_id, page, CAST(coalesce(chars, 0) AS INT) AS chars, round(least(coalesce(im.area, 0) / 480000::DOUBLE, 1), 6) AS image_ratio, round(least(coalesce(tb.area, 0) / 480000::DOUBLE, 1), 6) AS table_ratio,
CAST(coalesce(regions, 0) AS INT) AS table_regions, CAST(coalesce(columns, 1) AS INT) AS columns FROM p LEFT JOIN ch USING (document_id, page) LEFT JOIN im USING (document_id, page) LEFT JOIN tb USING (document_id, page)"""


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, x0 = (F.col("l_linenumber") * 3 + F.col("l_partkey") % 4).cast("double"), (F.col("l_suppkey") % 500).cast("double")
    text = F.concat(F.lit("w"), F.col("l_partkey").cast("string"))
    return lines(spark, sf_dir).select("document_id", (1 + F.col("l_linenumber") % 2).alias("page"), x0.alias("x0"), top.alias("top"), (x0 + 20).alias("x1"), (top + 8).alias("bottom"), text.alias("text"))


WORDS = """
w AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY top, x0, x1, bottom, text) AS n FROM (SELECT l_orderkey AS document_id, 1 + l_linenumber % 2 AS page, CAST(l_suppkey % 500 AS DOUBLE) AS x0,
  CAST(l_linenumber * 3 + l_partkey % 4 AS DOUBLE) AS top, CAST(l_suppkey % 500 + 20 AS DOUBLE) AS x1, CAST(l_linenumber * 3 + l_partkey % 4 + 8 AS DOUBLE) AS bottom, 'w' || l_partkey AS text FROM lineitem)),
walk AS (SELECT document_id, page, n, top AS start, 0 AS line FROM w WHERE n = 1
  UNION ALL SELECT w.document_id, w.page, w.n, CASE WHEN abs(k.start - w.top) > 5 THEN w.top ELSE k.start END, k.line + CASE WHEN abs(k.start - w.top) > 5 THEN 1 ELSE 0 END
  FROM walk k JOIN w ON w.document_id = k.document_id AND w.page = k.page AND w.n = k.n + 1),
text_lines AS (SELECT document_id, page, line, string_agg(text, ' ' ORDER BY n) AS text, min(x0) AS x0, min(top) AS top, max(x1) AS x1, max(bottom) AS bottom FROM w JOIN walk USING (document_id, page, n) GROUP BY 1, 2, 3)"""


def line_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.lines_of_words(word_rows(spark, sf_dir))


def plain_text(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> tuple[extraction.Elements, DataFrame]:
    """What plain text extraction gives, for all documents or some (document_id)."""
    words = word_rows(spark, sf_dir)
    words = words if ids is None else words.join(ids, "document_id", "left_semi")
    pages = words.select("document_id", "page").distinct().select("document_id", "page", F.lit(WIDTH).alias("width"), F.lit(60.0).alias("height"), (F.col("document_id") % 3 != 0).alias("has_font"))
    images = pages.filter(F.col("document_id") % 4 == 0).select("document_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(450.0).alias("x1"), F.lit(60.0).alias("bottom"))
    return extraction.fast_text(extraction.text_lines(words), pages, images)


def fast_text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _, _, order = plain_text(spark, sf_dir)[0]
    rows = blocks.join(order.select("document_id", F.col("ref_id").alias("id"), "order"), ["document_id", "id"])
    return rows.select("document_id", "id", "page_number", "text", "bbox.*", F.col("order").cast("int").alias("order"))


def fast_text_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_text(spark, sf_dir)[1].select("document_id", "strategy", "has_document", F.round("confidence", 6).alias("confidence"), "notes")


FAST_TEXT = f"""WITH RECURSIVE {WORDS.strip()} SELECT document_id, 'block_' || page || '_' || n AS id, page AS page_number, text, x0, 60 - bottom AS y0, x1, 60 - top AS y1, CAST(n AS INT) AS "order"
FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, line) - 1 AS n FROM text_lines)"""
FAST_ATTEMPTS = f"""WITH RECURSIVE {WORDS.strip()}, per_page AS (SELECT document_id, page, sum(length(text)) AS chars, sum((x1 - x0) * (bottom - top)) AS text_area FROM text_lines GROUP BY 1, 2),
per AS (SELECT document_id, count(*) AS pages, sum(chars) AS chars, count(*) * 36000::DOUBLE AS area, sum(text_area) AS text_area, sum(CASE WHEN document_id % 4 = 0 THEN 27000 ELSE 0 END)::DOUBLE AS image_area,
  count(*) FILTER (chars < 50) AS low, count(*) FILTER (document_id % 3 <> 0) AS fonts FROM per_page GROUP BY 1),
r AS (SELECT *, chars / (area / 10000::DOUBLE) AS d, image_area / area AS img, greatest(0::DOUBLE, 1 - text_area / area - image_area / area) AS white, low / pages AS ls FROM per),
s AS (SELECT document_id, greatest(0::DOUBLE, least(1::DOUBLE, (CASE WHEN d < 1 THEN greatest(0::DOUBLE, d) ELSE 1 END) * (CASE WHEN img > 0.5 THEN greatest(0::DOUBLE, 1 - (img - 0.5::DOUBLE) / 0.5::DOUBLE) ELSE 1 END)
  * (CASE WHEN ls > 0 THEN 1 - ls * 0.5::DOUBLE ELSE 1 END) * (CASE WHEN fonts = 0 AND chars > 0 THEN 0.8::DOUBLE ELSE 1 END) * (CASE WHEN ls > 0.5 OR chars < 50 THEN 0.7::DOUBLE ELSE 1 END) * (CASE WHEN white > 0.8 THEN 0.9::DOUBLE ELSE 1 END))) AS score FROM r)
SELECT document_id, 'fast_text' AS strategy, score >= 0.5 AS has_document, round(score, 6) AS confidence, CASE WHEN score < 0.5 THEN 'confidence_below_threshold' END AS notes FROM s"""


def span_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    text = F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(" s"), F.col("l_partkey").cast("string")))
    spans = rows.select(
        "document_id", F.lit(1).alias("page"), (F.col("l_linenumber") % 2).alias("block"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("span"), text.alias("text"),
        F.lit(1.0).alias("x0"), F.lit(2.0).alias("top"), F.lit(30.0).alias("x1"), F.lit(40.0).alias("bottom"),
    )
    return extraction.span_blocks(spans).select("document_id", "page", F.col("at").alias("block"), "x0", "top", "x1", "bottom", "text", "typed")


SPANS = """SELECT l_orderkey AS document_id, 1 AS page, l_linenumber % 2 AS block, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS top, 30.0::DOUBLE AS x1, 40.0::DOUBLE AS bottom,
trim(string_agg(t, ' ' ORDER BY l_linenumber, l_partkey, t)) AS text, CAST(sum(length(t)) AS BIGINT) AS typed FROM (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE ' s' || l_partkey END AS t FROM lineitem) GROUP BY 1, 3"""


def elements_of(found: extraction.Elements) -> DataFrame:
    """All elements in one table, with what each kind holds as text."""
    blocks, tables, figures, order = found
    cells = F.concat_ws("/", F.array_join("header", ","), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";"), F.coalesce("caption", F.lit("-")))
    rows = blocks.select("document_id", F.lit("text_block").alias("ref_type"), "id", "page_number", "bbox", F.col("text").alias("content"))
    rows = rows.unionByName(tables.select("document_id", F.lit("table").alias("ref_type"), "id", "page_number", "bbox", cells.alias("content")))
    rows = rows.unionByName(figures.select("document_id", F.lit("figure").alias("ref_type"), "id", "page_number", "bbox", F.coalesce("caption", F.lit("-")).alias("content")))
    order = order.select("document_id", "ref_type", F.col("ref_id").alias("id"), F.col("order").cast("int").alias("order"))
    return rows.join(order, ["document_id", "ref_type", "id"]).select("document_id", "ref_type", "id", "page_number", "bbox.*", "content", "order")


def layout_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderkey") % 100
    box = lambda **sides: F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in sides.items()])
    prov = F.array(F.struct((1 + k % 3).alias("page_no"), box(l=10, t=t, r=60, b=t + 12).alias("bbox")))
    texts = F.to_json(F.struct(F.concat(F.lit("Order "), k.cast("string")).alias("text"), prov.alias("prov")))
    second = F.to_json(F.struct(F.col("o_orderstatus").alias("text"), F.lit(9).alias("page_no"), box(x0=5, y0=20).alias("bbox")))
    cells = F.array(F.array(k.cast("string"), F.col("o_orderstatus")))
    framed = F.to_json(F.struct(F.lit(2).alias("page_no"), box(r=300).alias("bbox"), F.array(F.lit("a"), F.lit("b")).alias("header"), cells.alias("rows")))
    picture = F.to_json(F.struct(F.lit(1).alias("page_no"), box(l=200, t=50, r=10, b=50).alias("bbox")))
    json = F.concat(F.lit('{"texts": ['), texts, F.lit(", "), second, F.lit('], "tables": ['), framed, F.lit(', {"page": 3}], "pictures": ['), picture, F.lit("]}"))
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), F.when(k % 7 == 0, "not json").otherwise(json).alias("export"))


def layout_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_of(extraction.layout_model(layout_exports(spark, sf_dir))[0])


def layout_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.layout_model(layout_exports(spark, sf_dir))[1]


LAYOUT = """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey % 100 AS DOUBLE) AS t, * FROM orders WHERE o_orderkey % 7 <> 0)
SELECT k AS document_id, 'text_block' AS ref_type, 'block_' || (1 + k % 3) || '_0' AS id, CAST(1 + k % 3 AS INT) AS page_number, 10.0::DOUBLE AS x0, 842 - (t + 12) AS y0, 60.0::DOUBLE AS x1, 842 - t AS y1, 'Order ' || k AS content, 0 AS "order" FROM o
UNION ALL SELECT k, 'text_block', 'block_1_1', 1, 5, 822, 100, 823, o_orderstatus, 1 FROM o
UNION ALL SELECT k, 'table', 'table_2_0', 2, 0, 792, 300, 842, 'a,b/' || k || ',' || o_orderstatus || '/-', 2 FROM o
UNION ALL SELECT k, 'table', 'table_3_1', 3, 0, 792, 100, 842, '//-', 3 FROM o
UNION ALL SELECT k, 'figure', 'figure_1_0', 1, 10, 792, 200, 793, '-', 4 FROM o"""
LAYOUT_ATTEMPTS = """SELECT o_orderkey AS document_id, 'layout' AS strategy, o_orderkey % 7 <> 0 AS has_document, CASE WHEN o_orderkey % 7 <> 0 THEN 0.75 ELSE 0.0 END AS confidence,
CASE WHEN o_orderkey % 7 = 0 THEN 'layout conversion failed' END AS notes FROM orders"""


def element_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.page_counts(extraction.layout_model(layout_exports(spark, sf_dir))[0])


def vision_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    right = F.when(k % 11 == 0, "0").otherwise("3")
    json = F.concat(
        F.lit('{"text_blocks": [{"page": 2, "bbox": {"x0": 1, "y0": 2, "x1": '), right, F.lit(', "y1": 4}, "text": "  Order '), k.cast("string"), F.lit(' "}, {"text": "'), F.col("o_orderstatus"),
        F.lit('"}], "tables": [{"headers": ["a"], "rows": [["'), k.cast("string"), F.lit('", "2"], ["3"]], "caption": " c "}], "figures": [{"id": "F", "page": 3, "bbox": {"x1": 7}, "caption": ""}, {"page": 4}]}'),
    )
    fenced = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)
    return table(spark, sf_dir, "orders").select(k.alias("document_id"), F.when(k % 7 == 0, "sorry, no answer").otherwise(fenced).alias("response"))


def vision_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements_of(readers.vision_elements(vision_responses(spark, sf_dir)))


def vision_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.vision_model(vision_responses(spark, sf_dir))[1]


VISION = """WITH o AS (SELECT o_orderkey AS k, * FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0)
SELECT k AS document_id, 'text_block' AS ref_type, 'block_2_0' AS id, 2 AS page_number, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, 3.0::DOUBLE AS x1, 4.0::DOUBLE AS y1, 'Order ' || k AS content, 0 AS "order" FROM o
UNION ALL SELECT k, 'text_block', 'block_1_1', 1, 0, 0, 100, 20, o_orderstatus, 1 FROM o
UNION ALL SELECT k, 'table', 'table_1_0', 1, 0, 0, 100, 50, 'a,/' || k || ',2;3,/c', 2 FROM o
UNION ALL SELECT k, 'figure', 'F', 3, 0, 0, 7, 80, '-', 3 FROM o
UNION ALL SELECT k, 'figure', 'figure_4_1', 4, 0, 0, 100, 80, '-', 4 FROM o"""
VISION_ATTEMPTS = """SELECT o_orderkey AS document_id, 'vision' AS strategy, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS has_document, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 0.8 ELSE 0.0 END AS confidence,
CASE WHEN o_orderkey % 7 = 0 THEN 'vision_api_call_failed' WHEN o_orderkey % 11 = 0 THEN 'vision_response_invalid' END AS notes FROM orders"""


def routed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = derived.cost_rules(spark, sf_dir)
    extractors = {name: (lambda ids, s=s: ids.select("document_id", *derived.attempted(F.col("document_id"), s))) for s, name in enumerate(rules.STRATEGIES, 1)}
    out = extraction.routed(profiles, extractors, refused=profiles.filter(F.col("document_id") % 11 == 0).select("document_id"))
    return out.select("document_id", "strategy_used", "confidence", F.array_join("escalation_chain", ">").alias("chain"), "notes")


ROUTED = f"{with_(SIGNALS, ORIGIN, COST, CASCADE)} SELECT document_id, strategy_used, confidence, chain, notes FROM results"


def extractors_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over the three strategies themselves, each run on what has come to it: words, layout exports and vision answers."""
    profiles = derived.cost_rules(spark, sf_dir)
    given = {"layout": layout_exports(spark, sf_dir), "vision": vision_responses(spark, sf_dir)}
    extractors = {
        "fast_text": lambda ids: plain_text(spark, sf_dir, ids)[1], "layout": lambda ids: extraction.layout_model(given["layout"].join(ids, "document_id", "left_semi"))[1],
        "vision": lambda ids: extraction.vision_model(given["vision"].join(ids, "document_id", "left_semi"))[1],
    }
    out = extraction.routed(profiles, extractors)
    return out.select("document_id", "strategy_used", F.round("confidence", 6).alias("confidence"), F.array_join("escalation_chain", ">").alias("chain"), "notes")


EXTRACTORS = CASCADE.split("tries AS (")[0] + f"""attempts AS (SELECT * FROM ({FAST_ATTEMPTS}) UNION ALL SELECT * FROM ({LAYOUT_ATTEMPTS}) UNION ALL SELECT * FROM ({VISION_ATTEMPTS})),
tries AS (SELECT s.*, coalesce(has_document, false) AS given, coalesce(confidence, 0)::DOUBLE AS confidence, notes AS own_note, false AS refused FROM scored s LEFT JOIN attempts USING (document_id, strategy)),
gated AS (""" + CASCADE.split("gated AS (")[1]
EXTRACTORS = f"{with_(SIGNALS, ORIGIN, COST, EXTRACTORS)} SELECT document_id, strategy_used, round(confidence, 6) AS confidence, chain, notes FROM results"


def budgeted_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade with a budget that runs out midway: vision runs in rounds of 200 documents, and what they cost is added up between them."""
    profiles = derived.cost_rules(spark, sf_dir)
    tokens = F.when(F.col("document_id") % 3 != 0, F.lit(100).cast("long")).alias("token_usage_prompt")
    extractors = {name: (lambda ids, s=s: ids.select("document_id", *derived.attempted(F.col("document_id"), s))) for s, name in enumerate(rules.STRATEGIES[:2], 1)}
    extractors["vision"] = lambda ids: ids.select("document_id", *derived.attempted(F.col("document_id"), 3), tokens, F.lit(None).cast("long").alias("token_usage_completion"), F.lit(0.25).alias("cost_estimate_usd"))
    out = extraction.routed(profiles, extractors, budget=extraction.Budget(limit_usd=300.0, at_once=200))
    return out.select("document_id", "strategy_used", "confidence", F.array_join("escalation_chain", ">").alias("chain"), "notes")


BUDGETED = CASCADE.replace("tries AS (", """free AS (SELECT *, (document_id + s) % 4 <> 0 AS given, CAST((document_id * 7 + s * 3) % 10 AS DOUBLE) / 10 AS confidence FROM scored),
came AS (SELECT *, coalesce(max(CAST(given AND confidence >= CASE WHEN strategy = 'vision' THEN 0.0 ELSE 0.5 END AS INT)) OVER (PARTITION BY document_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM free),
seeing AS (SELECT *, (row_number() OVER (PARTITION BY step ORDER BY document_id) - 1) // 200 AS round FROM came WHERE strategy = 'vision' AND over = 0),
rounds AS (SELECT step, round, sum(CASE WHEN given AND document_id % 3 <> 0 THEN 0.25 ELSE 0 END) AS cost FROM seeing GROUP BY 1, 2),
sums AS (SELECT step, round, coalesce(sum(cost) OVER (ORDER BY step, round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM rounds),
barred AS (SELECT document_id FROM seeing JOIN sums USING (step, round) WHERE spent >= 300),
tries AS (""").replace("document_id % 11 = 0 AS refused", "document_id IN (SELECT document_id FROM barred) AS refused")
BUDGETED = f"{with_(SIGNALS, ORIGIN, COST, BUDGETED)} SELECT document_id, strategy_used, confidence, chain, notes FROM results"


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), (F.col("o_custkey") % 50).cast("string")).alias("document_id"), F.when(F.col("o_orderkey") % 3 == 0, "vision").otherwise("layout").alias("strategy_used"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 100).alias("token_usage_prompt"), F.lit(None).cast("long").alias("token_usage_completion"), F.lit(0.25).alias("cost_estimate_usd"),
    )
    return extraction.over_budget(extraction.usage(ledger), 10.0)


BUDGET = """SELECT document_id FROM (SELECT 'd' || o_custkey % 50 AS document_id, count(*) * 0.25 AS spent FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 100 > 0 GROUP BY 1) WHERE spent >= 10"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_partkey") % 6 == 0, "Revenue and Profit ").otherwise(""), F.col("l_returnflag"), F.lit(" "), F.col("l_linestatus"))
    return triage.sample_text(lines(spark, sf_dir).select("document_id", F.col("l_linenumber").alias("page"), text.alias("text")))


def sample_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir)


SAMPLES = """samples AS (SELECT l_orderkey AS document_id, lower(string_agg(t, ' ' ORDER BY l_linenumber, t)) AS text FROM (SELECT *, CASE WHEN l_partkey % 6 = 0 THEN 'Revenue and Profit ' ELSE '' END || l_returnflag || ' ' || l_linestatus AS t FROM lineitem) WHERE l_linenumber <= 5 GROUP BY 1)"""
PROFILE = """domains AS (SELECT document_id, CASE WHEN contains(text, 'revenue') THEN 0.5::DOUBLE ELSE 0 END AS score FROM samples),
profiles AS (SELECT o.document_id, o.pages AS page_count, o.origin, l.layout, CASE WHEN d.score >= 0.3 THEN 'financial' ELSE 'general' END AS domain, c.estimated_cost,
  least(o.origin_confidence, l.layout_confidence, CASE WHEN d.score >= 0.3 THEN 0.55 ELSE 0.5 END) AS confidence FROM origin_rows o JOIN layout_rows l USING (document_id) JOIN cost_rows c USING (document_id) LEFT JOIN domains d USING (document_id))"""


def profile_columns(found: DataFrame) -> DataFrame:
    return found.select("document_id", F.col("page_count").cast("long").alias("page_count"), "origin", "layout", "domain", "estimated_cost", F.round("confidence", 6).alias("confidence"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_columns(triage.profiles(derived.signal_pages(spark, sf_dir), samples(spark, sf_dir)))


PROFILES = f"{with_(SIGNALS, ORIGIN, COST, SAMPLES, PROFILE)} SELECT document_id, CAST(page_count AS BIGINT) AS page_count, origin, layout, domain, estimated_cost, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM profiles"


def hooked_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = derived.signal_pages(spark, sf_dir)
    ids = signals.select("document_id").distinct()
    origin = ids.select("document_id", F.when(F.col("document_id") % 2 == 0, "scanned_image").otherwise("form_fillable").alias("origin"))
    domain = ids.select("document_id", F.lit("legal").alias("domain"), F.lit(0.7).alias("domain_confidence"))
    counts = ids.select("document_id", (F.col("document_id") % 9).alias("page_count"))
    return profile_columns(triage.profiles(signals, samples(spark, sf_dir), origin_of=origin, domain_of=domain, page_counts=counts))


HOOKED = f"""{with_(SIGNALS, ORIGIN)} SELECT document_id, CAST(greatest(document_id % 9, 1) AS BIGINT) AS page_count, CASE WHEN document_id % 2 = 0 THEN 'scanned_image' ELSE 'form_fillable' END AS origin, layout, 'legal' AS domain,
CASE WHEN document_id % 2 = 0 THEN 'needs_vision_model' ELSE 'needs_layout_model' END AS estimated_cost, CAST(least(0.8, layout_confidence, 0.7) AS DOUBLE) AS confidence FROM layout_rows"""


def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = (F.col("l_suppkey") % 50).cast("double"), (F.col("l_partkey") % 40).cast("double")
    boxes = lines(spark, sf_dir).select("document_id", F.col("l_linenumber").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + F.col("l_partkey") % 16).alias("y1"))
    return triage.box_statistics(boxes)


BOXES = f"""SELECT l_orderkey AS document_id, l_linenumber AS page, count(*) AS boxes,
{", ".join(f"round_even({of}({side}), 2) AS {name}_{what}" for what, side in (("width", "w"), ("height", "h")) for name, of in (("min", "min"), ("max", "max"), ("mean", "avg")))}
FROM (SELECT *, (l_suppkey % 50 + l_quantity) - l_suppkey % 50 AS w, (l_partkey % 40 + l_partkey % 16) - l_partkey % 40 AS h FROM lineitem) GROUP BY 1, 2"""


def profile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.cost_rules(spark, sf_dir)
    wrong = F.get(F.array(*[F.lit(c) for c in rules.COSTS]), (F.col("document_id") % 3).cast("int"))
    rows = rows.withColumn("estimated_cost", wrong).withColumn("page_count", F.col("document_id") % 4)
    return validation.profile_errors(rows)


PROFILE_RULES = f"""{with_(SIGNALS, ORIGIN, COST)}, p AS (SELECT document_id, origin, layout, ['fast_text_sufficient', 'needs_layout_model', 'needs_vision_model'][CAST(document_id % 3 AS INT) + 1] AS cost FROM cost_rows)
SELECT document_id, 'scanned_needs_vision' AS rule FROM p WHERE origin = 'scanned_image' AND cost <> 'needs_vision_model'
UNION ALL SELECT document_id, 'complex_layout_not_fast' FROM p WHERE layout IN ('table_heavy', 'multi_column', 'mixed', 'figure_heavy') AND cost = 'fast_text_sufficient'
UNION ALL SELECT document_id, 'fast_needs_plain_native' FROM p WHERE cost = 'fast_text_sufficient' AND NOT (origin = 'native_digital' AND layout = 'single_column')
UNION ALL SELECT document_id, 'page_count' FROM p WHERE document_id % 4 < 1"""


def ledger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    used = F.get(F.array(*[F.lit(s) for s in (*rules.STRATEGIES, "escalation_failed", "magic")]), (k % 5).cast("int"))
    chain = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("fast_text"), used)).otherwise(F.array(used, F.lit("layout")))
    start = F.col("o_orderdate")
    ledger = table(spark, sf_dir, "orders").select(k.alias("document_id"), used.alias("strategy_used"), start.alias("start_time"), F.when(k % 6 == 0, F.date_sub(start, 1)).otherwise(start).cast("timestamp").alias("end_time"), chain.alias("escalation_chain"))
    return validation.ledger_errors(ledger)


LEDGER_RULES = """WITH l AS (SELECT o_orderkey AS k, ['fast_text', 'layout', 'vision', 'escalation_failed', 'magic'][CAST(o_orderkey % 5 AS INT) + 1] AS used FROM orders)
SELECT k AS document_id, 'strategy' AS rule FROM l WHERE used = 'magic' UNION ALL SELECT k, 'time_order' FROM l WHERE k % 6 = 0
UNION ALL SELECT k, 'chain_tail' FROM l WHERE used <> 'escalation_failed' AND (k % 4 = 0 OR (k % 4 > 1 AND used <> 'layout'))"""


def element_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references, pages out of range, bad boxes, ragged tables, and bad pages, spans and languages."""
    rows = lines(spark, sf_dir)
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    blocks = rows.select("document_id", F.concat(F.lit("b"), n.cast("string")).alias("id"), n.alias("page_number"), F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (k % 3).cast("double").alias("x1"), F.lit(1.0).alias("y1")).alias("bbox"))
    none = blocks.limit(0)
    order = rows.select("document_id", F.concat(F.lit("b"), (n + k % 2 * 10).cast("string")).alias("ref_id"))
    counts = rows.select("document_id").distinct().withColumn("page_count", F.lit(5))
    cells = rows.select("document_id", F.lit("t").alias("table_id"), F.lit("body").alias("section"), n.alias("row_index"), (1 + k % 2).alias("colspan"))
    pages = rows.select(F.when(k % 7 > 0, F.col("document_id").cast("string")).alias("document_id"), (n - 1).alias("page_number"))
    spans = rows.select(F.col("document_id").cast("string").alias("document_id"), n.alias("page_start"), (n + k % 3 - 1).cast("int").alias("page_end"))
    languages = rows.select("document_id", F.when(k % 4 == 0, " EN ").when(k % 4 == 1, "x").when(k % 4 == 2, "d3").otherwise("deu").alias("language"))
    found = {
        "dangling": validation.dangling_references(order, blocks, none, none), "page_range": validation.page_range_errors(blocks, counts), "box": validation.box_errors(blocks),
        "ragged": validation.ragged_tables(cells), "page": validation.page_errors(pages), "span": validation.span_errors(spans), "language": validation.language_errors(languages),
    }
    parts = [df.groupBy().agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("document_id").alias("documents")).select(F.lit(kind).alias("rule"), "errors", "documents") for kind, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ELEMENT_RULES = """WITH li AS (SELECT *, l_orderkey AS d, l_partkey AS k, l_linenumber AS n FROM lineitem),
dangling AS (SELECT d FROM li a WHERE NOT EXISTS (SELECT 1 FROM li b WHERE b.d = a.d AND b.n = a.n + a.k % 2 * 10)),
widths AS (SELECT d, n, sum(1 + k % 2) AS w FROM li GROUP BY 1, 2), ragged AS (SELECT d FROM widths GROUP BY 1 HAVING count(DISTINCT w) > 1),
pages AS (SELECT CASE WHEN k % 7 > 0 THEN d END AS d FROM li WHERE k % 7 = 0 UNION ALL SELECT CASE WHEN k % 7 > 0 THEN d END FROM li WHERE n - 1 < 1),
spans AS (SELECT d FROM li WHERE n + k % 3 - 1 < greatest(n, 1)),
languages AS (SELECT d FROM li WHERE k % 4 IN (1, 2))
SELECT 'dangling' AS rule, count(*) AS errors, count(DISTINCT d) AS documents FROM dangling UNION ALL SELECT 'page_range', count(*), count(DISTINCT d) FROM li WHERE n > 5 UNION ALL SELECT 'box', count(*), count(DISTINCT d) FROM li WHERE k % 3 = 0
UNION ALL SELECT 'ragged', count(*), count(DISTINCT d) FROM ragged UNION ALL SELECT 'page', count(*), count(DISTINCT d) FROM pages UNION ALL SELECT 'span', count(*), count(DISTINCT d) FROM spans UNION ALL SELECT 'language', count(*), count(DISTINCT d) FROM languages"""


def chain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified chains without items, indexes with crossed pages or without one root, and trees with orphans, cycles and foreign sections.

    In the trees each order of a customer hangs under the one before; some under one that isn't there, or under themselves.
    """
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    items = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    chains = validation.provenance_errors(orders.select(F.col("k").alias("document_id"), (F.col("k") % 2 == 0).alias("verified"), items.alias("items")))
    index = orders.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("document_id"), F.when(F.col("k") % 4 == 0, "root").otherwise(F.concat(F.lit("sec_"), F.col("k").cast("string"))).alias("section_id"),
        (F.col("k") % 5).alias("page_start"), (F.col("k") % 7).alias("page_end"),
    )
    out = chains.select(F.col("document_id").cast("string").alias("document_id"), F.lit("chain").alias("section_id"), F.lit("verified_without_items").alias("rule"))
    out = out.unionByName(validation.section_errors(index))
    name = lambda k: F.concat(F.lit("sec_"), k.cast("string"))
    tree = F.concat(F.lit("d"), F.col("o_custkey").cast("string"))
    before = F.lag("k").over(Window.partitionBy("o_custkey").orderBy("k"))
    parent = F.when(F.col("k") % 11 == 0, "gone").when(F.col("k") % 13 == 0, name(F.col("k"))).otherwise(F.coalesce(name(before), F.lit("root")))
    hung = orders.select(tree.alias("tree_id"), name(F.col("k")).alias("section_id"), parent.alias("parent_id"), F.when(F.col("k") % 17 == 0, "other").otherwise(tree).alias("owner"))
    roots = hung.select("tree_id").distinct().select("tree_id", F.lit("root").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.col("tree_id").alias("owner"))
    return out.unionByName(trees.tree_errors(hung.unionByName(roots)).select(F.col("tree_id").alias("document_id"), "section_id", "rule"))


CHAIN_RULES = """WITH i AS (SELECT 'd' || o_custkey AS document_id, CASE WHEN o_orderkey % 4 = 0 THEN 'root' ELSE 'sec_' || o_orderkey END AS section_id, o_orderkey % 5 AS a, o_orderkey % 7 AS b FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'chain' AS section_id, 'verified_without_items' AS rule FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0
UNION ALL SELECT document_id, section_id, 'page_order' FROM i WHERE a > b UNION ALL SELECT document_id, 'root', 'one_root' FROM i GROUP BY 1 HAVING count(*) FILTER (section_id = 'root') <> 1
UNION ALL SELECT * FROM (SELECT 'd' || o_custkey AS document_id, 'sec_' || o_orderkey AS section_id,
  coalesce(last_value(CASE WHEN o_orderkey % 11 = 0 THEN 'orphan' WHEN o_orderkey % 13 = 0 THEN 'cycle' END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  CASE WHEN o_orderkey % 17 = 0 THEN 'foreign' END) AS rule FROM orders) WHERE rule IS NOT NULL"""


def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for split tables, bare figures and captions, cut lists and missing references, on units made to break them."""
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey"))
    m = F.col("k") % 8
    kind = F.get(F.array(*[F.lit(x) for x in ("table", "table", "figure", "caption", "list", "list", "paragraph", "table")]), m.cast("int"))
    empty_rows, cells = F.array().cast("array<array<string>>"), F.array(F.array(F.lit("1")))
    header = F.when(m.isin(0, 7), F.array(F.lit("a")))
    body = F.when(m == 0, empty_rows).when(m.isin(1, 7), cells)
    nothing = F.lit(None).cast("string")
    payload = F.struct(header.alias("header"), body.alias("rows"), nothing.alias("caption"), F.when(m == 4, False).alias("list_complete"))
    text = F.get(F.array(*[F.lit(x) for x in ("a", "b", " ", "Fig", "1. x.", "- a\n3. cut", "p", "12 | 3")]), m.cast("int"))
    # the units of a document follow each other by order key; each customer is a document
    by = Window.partitionBy("o_custkey").orderBy("k")
    seq = F.row_number().over(by).cast("int")
    units = rows.select(
        F.col("o_custkey").cast("string").alias("document_id"), seq.alias("seq"), F.concat(F.lit("ldu_"), seq.cast("string")).alias("ldu_id"), kind.alias("content_type"), text.alias("text"), payload.alias("raw_payload"),
        F.when(F.col("k") % 9 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("page_refs"),
        F.when(F.col("k") % 10 > 0, F.array(F.lit(1))).alias("bounding_boxes"), F.when(F.col("k") % 13 > 0, "h").otherwise("  ").alias("content_hash"), nothing.alias("parent_section_id"),
    )
    return validation.chunk_errors(units, need_parent=False).select("document_id", "code", "seq", F.array_join("ldu_ids", ",").alias("ldu_ids"))


UNIT_RULES = """WITH u AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, o_orderkey AS k, o_orderkey % 8 AS m, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS seq, lead(o_orderkey % 8) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nm FROM orders),
e AS (SELECT document_id, 'PAGE_REFS_EMPTY' AS code, seq, 'ldu_' || seq AS ldu_ids FROM u WHERE k % 9 = 0 UNION ALL SELECT document_id, 'BOUNDING_BOXES_INVALID', seq, 'ldu_' || seq FROM u WHERE k % 10 = 0
UNION ALL SELECT document_id, 'CONTENT_HASH_MISSING', seq, 'ldu_' || seq FROM u WHERE k % 13 = 0
UNION ALL SELECT document_id, 'TABLE_HEADER_CELLS_SPLIT', seq, 'ldu_' || seq || ',ldu_' || (seq + 1) FROM u WHERE m = 0 AND nm = 1
UNION ALL SELECT document_id, 'TABLE_HEADER_CELLS_SPLIT', seq, 'ldu_' || seq FROM u WHERE m = 7
UNION ALL SELECT document_id, 'FIGURE_CAPTION_NOT_UNIFIED', seq, 'ldu_' || seq FROM u WHERE m IN (2, 3)
UNION ALL SELECT document_id, 'LIST_MID_ITEM_SPLIT', seq, 'ldu_' || seq FROM u WHERE m = 4 UNION ALL SELECT document_id, 'LIST_MID_ITEM_SPLIT', seq, 'ldu_' || seq FROM u WHERE m = 5) SELECT * FROM e"""


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of made pages whose text is known."""
    k = F.col("o_orderkey").cast("string")
    html = F.concat(F.lit("<html><head><title>x</title></head><body><h1>Order "), k, F.lit(" &amp; more</h1><script>var a='<p>';</script><p>by <b>"), F.col("o_orderstatus"), F.lit("</b></p><!-- no --><ul><li>one</li></ul></body></html>"))
    found = readers.html_blocks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return found.select("document_id", "id", "text", "reading_order_index")


HTML = """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'b' || n AS id, [ 'Order ' || o_orderkey || ' & more', 'by ' || o_orderstatus, 'one'][CAST(n AS INT) + 1] AS text, CAST(n AS INT) AS reading_order_index FROM orders, range(3) r(n)"""

def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text blocks of the given web pages, scripts, comments, unclosed tags and entities and all: each page's number of blocks, characters, and a digest."""
    found = readers.html_blocks(table(spark, sf_dir, "pages"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(" ", "id", "text")), 1, 8), 16, 10).cast("long")
    return found.groupBy("document_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"), F.sum(digest).alias("digest"), F.min_by("text", "reading_order_index").alias("first"))


SPACES = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}"
PAGE_BLOCKS = rf"""WITH bare AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->', ' ', 'g') AS h FROM pages),
cut AS (SELECT page_id, regexp_split_to_array(h, '(?i)</?(?:p|div|li|ul|ol|h[1-6]|table|tr|section|article|br|body|html|main|nav|footer|header)\b[^>]*>') AS parts FROM bare),
texts AS (SELECT page_id, list_filter(list_transform(parts, lambda t: regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '[{SPACES}]+', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '^[{SPACES}]+|[{SPACES}]+$', '', 'g')), lambda t: t <> '') AS kept FROM cut),
blocks AS (SELECT CAST(page_id AS VARCHAR) AS document_id, unnest(range(len(kept))) AS n, unnest(kept) AS text FROM texts)
SELECT document_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST('0x' || md5('b' || n || ' ' || text)[1:8] AS BIGINT)) AS BIGINT) AS digest, arg_min(text, n) AS first FROM blocks GROUP BY 1"""

def vision_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vision model is asked: once a document, with the images of its first pages, up to the limit; a call that fails gives null."""
    image = F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string")).cast("binary")
    pages = lines(spark, sf_dir).select(F.col("document_id").cast("string").alias("document_id"), F.col("l_linenumber").alias("page"), image.alias("image"))
    config = Rules(router=replace(Rules().router, vision_pages=4))

    def call(document_id: str, images: list[bytes]) -> str:
        if document_id.endswith("7"):
            raise ConnectionError("no answer")
        return f"{len(images)} pages, {sum(map(len, images))} bytes"

    return extraction.answered(extraction.vision_pages(pages, config), call)


VISION_CALLS = """SELECT CAST(l_orderkey AS VARCHAR) AS document_id, CASE WHEN l_orderkey % 10 <> 7 THEN count(*) || ' pages, ' || sum(length(l_returnflag || ' ' || l_partkey)) || ' bytes' END AS response
FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_orderkey"""


ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "page_signals": (page_signals, PAGE_SIGNALS),
    "line_grouping": (line_grouping, f"WITH RECURSIVE {WORDS.strip()} SELECT * FROM text_lines"),
    "fast_text_extraction": (fast_text_extraction, FAST_TEXT),
    "fast_text_attempts": (fast_text_attempts, FAST_ATTEMPTS),
    "span_blocks": (span_blocks, SPANS),
    "layout_extraction": (layout_extraction, LAYOUT),
    "layout_attempts": (layout_attempts, LAYOUT_ATTEMPTS),
    "element_pages": (element_pages, "SELECT o_orderkey AS document_id, 3 AS page_count FROM orders WHERE o_orderkey % 7 <> 0"),
    "vision_extraction": (vision_extraction, VISION),
    "vision_attempts": (vision_attempts, VISION_ATTEMPTS),
    "routed_extraction": (routed_extraction, ROUTED),
    "extractors_run": (extractors_run, EXTRACTORS),
    "page_blocks": (page_blocks, PAGE_BLOCKS),
    "vision_calls": (vision_calls, VISION_CALLS),
    "budgeted_extraction": (budgeted_extraction, BUDGETED),
    "budget": (budget, BUDGET),
    "sample_text": (sample_text, f"WITH {SAMPLES} SELECT * FROM samples"),
    "profiles": (profiles, PROFILES),
    "hooked_profiles": (hooked_profiles, HOOKED),
    "box_statistics": (box_statistics, BOXES),
    "profile_rules": (profile_rules, PROFILE_RULES),
    "ledger_rules": (ledger_rules, LEDGER_RULES),
    "element_rules": (element_rules, ELEMENT_RULES),
    "chain_rules": (chain_rules, CHAIN_RULES),
    "unit_rules": (unit_rules, UNIT_RULES),
    "html_blocks": (html_blocks, HTML),
}
