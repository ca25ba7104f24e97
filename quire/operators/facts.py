"""Facts: entity, metric and value from tables, labelled lines and periods, and their search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import key_values, may_have_key_values, may_have_periods, periods, query_terms, strip, strip_column, visible_at
from quire.plans.storage import asked_of, kept, stored

TABLE_TYPES = ("table", "table_section")
REFERENCE = "struct<bbox:array<double>,content_hash:string,document_id:string,ldu_id:string,page:int>"
TEXT_TYPES = ("paragraph", "list")
#: Units of a document, or numbers of stored facts, of one block: what a search looks through in the end.
BLOCK = 4096
#: Documents that are named to a scan of facts, so that it reads only where they can be.
FEW_DOCUMENTS = 1000


def source_reference(ldus: DataFrame) -> Column:
    """Where a fact comes from, its fields in the order in which they are written as JSON."""
    box = F.get("bounding_boxes", F.lit(0))
    return F.struct(
        F.when(box.isNotNull(), F.array(*[box[s] for s in ("x0", "y0", "x1", "y1")])).alias("bbox"),
        F.col("content_hash"), F.col("document_id"), F.col("ldu_id"), F.coalesce(F.get("page_refs", F.lit(0)), F.lit(1)).alias("page"),
    )


def reference_json(reference: Column) -> Column:
    return F.to_json(reference)


def reference_read(json: Column) -> Column:
    """A source reference from its JSON; text that isn't JSON gives one without any value."""
    return F.from_json(json, REFERENCE)


def fact(entity: Column, metric: Column, value: Column, period: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [
        "document_id", "seq", "at", entity.alias("entity"), metric.alias("metric"), value.alias("value"), null.alias("unit"),
        (null if period is None else period).alias("period"), null.alias("category_path"), "source_reference", F.col("source_reference.page").alias("source_page"),
    ]


def table_facts(ldus: DataFrame) -> DataFrame:
    """One fact for each non-empty cell under a header, the first column included; without header or rows, from text lines."""
    units = ldus.filter(F.col("content_type").isin(*TABLE_TYPES)).withColumn("source_reference", source_reference(ldus))
    header, rows = F.col("raw_payload.header"), F.col("raw_payload.rows")
    structured = (F.coalesce(F.size(header), F.lit(0)) > 0) & (F.coalesce(F.size(rows), F.lit(0)) > 0)
    # what a unit's or a row's cells share is made once a unit or a row
    metrics = F.transform(header, lambda h, i: strip(F.coalesce(F.nullif(h, F.lit("")), F.concat(F.lit("col_"), i.cast("string")))))
    cells = units.filter(structured).select("document_id", "seq", metrics.alias("metrics"), "source_reference", F.posexplode(rows).alias("row", "cells"))
    cells = cells.select("document_id", "seq", "metrics", "source_reference", "row", "cells", strip(F.get("cells", F.lit(0))).alias("entity"))
    cells = cells.select("*", F.posexplode("cells").alias("col", "cell")).filter((F.col("col") < F.size("metrics")) & (visible_at(F.col("cell"), 1) | (strip(F.col("cell")) != "")))
    cells = cells.withColumn("at", F.struct(F.col("row").alias("a"), F.col("col").alias("b")))
    out = cells.select(*fact(F.col("entity"), F.get("metrics", "col"), strip_column(F.col("cell"))))
    parts = lambda line: F.filter(F.transform(F.split(F.replace(line, F.lit("\t"), F.lit("|")), r"\|"), strip), lambda p: p != "")
    lines = units.filter(~structured).withColumn("lines", F.split(strip(F.col("text")), "\n")).filter(F.size("lines") > 1)
    lines = lines.select("document_id", "seq", "source_reference", parts(F.get("lines", F.lit(0))).alias("header"), F.posexplode(F.slice("lines", F.lit(2), F.size("lines"))).alias("row", "line"))
    lines = lines.withColumn("cells", parts(F.col("line"))).select("*", F.posexplode("cells").alias("col", "cell")).filter(F.col("col") < F.size("header"))
    lines = lines.withColumn("at", F.struct(F.col("row").alias("a"), F.col("col").alias("b")))
    return out.unionByName(lines.select(*fact(F.get("cells", F.lit(0)), F.get("header", "col"), F.col("cell"))))


def text_facts(ldus: DataFrame) -> DataFrame:
    """Labelled values and periods of paragraphs and lists."""
    units = ldus.filter(F.col("content_type").isin(*TEXT_TYPES)).withColumn("source_reference", source_reference(ldus))
    whole = F.lit("Document")
    labelled = units.filter(may_have_key_values(F.col("text"))).select("document_id", "seq", "source_reference", F.posexplode(key_values(F.col("text"))).alias("n", "kv"))
    labelled = labelled.withColumn("at", F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).select(*fact(whole, F.col("kv.metric"), F.col("kv.value")))
    dated = units.filter(may_have_periods(F.col("text"))).select("document_id", "seq", "source_reference", F.posexplode(periods(F.col("text"))).alias("n", "period"))
    dated = dated.withColumn("at", F.struct(F.lit(1).alias("a"), F.col("n").alias("b")))
    return labelled.unionByName(dated.select(*fact(whole, F.lit("period"), F.col("period"), F.col("period"))))


def extract_facts(ldus: DataFrame, table_only: bool = False) -> DataFrame:
    """All facts; document_id, seq and at give their order."""
    found = table_facts(ldus)
    return found if table_only else found.unionByName(text_facts(ldus))


def searched_text() -> Column:
    """What the words of a question are looked for in: entity, metric, value and period in lower case."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("entity", "metric", "value", "period")]))


def order_of(facts: DataFrame) -> list[str]:
    """The columns that order facts: ids where they are stored, else documents, units and places."""
    return ["fact_id"] if "fact_id" in facts.columns else ["document_id", "seq", "at"]


def block_of(facts: DataFrame) -> list[Column]:
    """__doc and __chunk: the document of a fact (after a mark, so that a null one is another and first), and the run of units or of stored facts in which it is."""
    at = F.col("fact_id") if "fact_id" in facts.columns else F.coalesce("seq", F.lit(-1))
    return [F.coalesce(F.concat(F.lit("="), "document_id"), F.lit("")).alias("__doc"), F.floor(at / BLOCK).alias("__chunk")]


def asked_terms(queries: DataFrame) -> DataFrame:
    """The words of queries, stored: __asked (a number of each row), query_id, terms and only (the document that is asked, null for all)."""
    scope = F.col("document_id") if "document_id" in queries.columns else F.lit(None).cast("string")
    return stored(queries.select("query_id", F.transform(query_terms(F.col("query")), F.lower).alias("terms"), scope.alias("only")).withColumn("__asked", F.monotonically_increasing_id()))


def in_scope() -> Column:
    return F.col("only").isNull() | (F.col("only") == F.col("document_id"))


def first_hits(facts: DataFrame, asked: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """The first facts with any of the words asked for, from blocks (__asked, __doc, __chunk) that have one each.

    As each block has a hit, the first `limit` hits are in the first `limit` blocks: only these blocks' facts are looked
    through, however many there are with hits, and whole rows of facts are put in order only there.
    """
    by = Window.partitionBy("__asked").orderBy(*(["__chunk"] if "fact_id" in facts.columns else ["__doc", "__chunk"]))
    first = stored(blocks.distinct().withColumn("__n", F.dense_rank().over(by)).filter(F.col("__n") <= limit).drop("__n"))
    names = [r["__doc"] for r in first.select("__doc").distinct().limit(FEW_DOCUMENTS + 1).collect()]
    rows = facts
    if len(names) <= FEW_DOCUMENTS:
        here = F.col("document_id").isin([name[1:] for name in names if name])
        rows = rows.filter(here | F.col("document_id").isNull() if "" in names else here)
    rows = kept(rows.select("*", *block_of(facts)), first, first.count(), "inner", ["__doc", "__chunk"])
    rows = kept(rows, asked, asked.count(), "inner", ["__asked"]).withColumn("hay", searched_text())
    rows = rows.filter(F.exists("terms", lambda t: F.contains(F.col("hay"), t)) & in_scope())
    by = Window.partitionBy("query_id").orderBy(*order_of(facts))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).select(*facts.columns, "query_id", "rank")


def search_facts(facts: DataFrame, queries: DataFrame, limit: int = 20, document_ids: Sequence[str] | None = None) -> DataFrame:
    """The first facts that have any of a query's first ten words, for each row of queries (query_id, query).

    Stored facts come in the order of their ids, others in that of documents, units and places. No ids given means all
    documents, an empty list means none; a query with a document_id (a column of that name, null for all) asks that
    document alone. Words match within words, in any case. Each question meets each fact here, but only the first blocks
    with hits are kept, whose facts are read again; where facts are stored, fact_index.search gives the same from an index.
    """
    if document_ids is not None:
        facts = facts.filter(F.col("document_id").isin(*document_ids)) if document_ids else facts.filter(F.lit(False))
    asked = asked_terms(queries)
    hit = F.exists("terms", lambda t: F.contains(F.col("hay"), t)) & in_scope()
    found = asked_of(facts.select("document_id", *block_of(facts), searched_text().alias("hay")), asked.drop("query_id"), hit)
    return first_hits(facts, asked, found.select("__asked", "__doc", "__chunk"), limit)
