"""Readers: files to page, block and index tables. What parses a file is a function that runs on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.geometry import bbox, is_valid
from quire.functions.text import strip, without_code_fence
from quire.operators.triage import document_key
from quire.plans import schemas
from quire.plans.storage import stored
from quire.sources import batches

INDEX = (
    "document_id string, section_id string, parent_id string, n int, title string, level int, page_start int, page_end int, key_entities array<string>, "
    "summary string, data_types_present array<string>, ldu_ids array<string>"
)
#: What a vision model's answer may hold.
VISION_BOX = "bbox:struct<x0:double,y0:double,x1:double,y1:double>"
VISION = (
    f"text_blocks array<struct<id:string,page:int,{VISION_BOX},text:string>>, "
    f"tables array<struct<id:string,page:int,{VISION_BOX},headers:array<string>,rows:array<array<string>>,caption:string>>, "
    f"figures array<struct<id:string,page:int,{VISION_BOX},caption:string>>"
)
# The box of an element without one, by kind its height.
DEFAULT_WIDTH, DEFAULT_HEIGHT = 100.0, {"text_blocks": 20.0, "tables": 50.0, "figures": 80.0}


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """document_id, path and content of files, each read by the task that parses it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(document_key(F.col("path")).alias("document_id"), "path", "content")


def parsed(found: DataFrame, parse: Callable[[str, bytes], Iterable[dict[str, Any]]], schema: str) -> DataFrame:
    """Rows that `parse` makes of each file, one file at a time; a file that it fails on gives none, see failures().

    parse takes the document's id and content, and yields dicts of the schema's fields.
    """
    rows = attempted(found, parse, schema).filter("error is null")
    return rows.drop("error", "failed_id")


def failures(found: DataFrame, parse: Callable[[str, bytes], Iterable[dict[str, Any]]], schema: str) -> DataFrame:
    """document_id and error of the files that `parse` fails on."""
    return attempted(found, parse, schema).filter("error is not null").select(F.col("failed_id").alias("document_id"), "error")


def attempted(found: DataFrame, parse: Callable[[str, bytes], Iterable[dict[str, Any]]], schema: str) -> DataFrame:
    """As parsed(), and a row with failed_id and error, all else null, for each file that `parse` fails on."""
    names = T._parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document_id, content in zip(batch["document_id"], batch["content"], strict=True):
                try:
                    rows = list(parse(document_id, bytes(content)))
                except Exception as error:  # noqa: BLE001  a broken file must not end the job
                    rows = [{"failed_id": document_id, "error": f"error: {error}"}]
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=[*names, "failed_id", "error"]).astype(object).replace({float("nan"): None})

    return found.select("document_id", "content").mapInPandas(run, f"{schema}, failed_id string, error string")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Text blocks of raw web pages (page_id, html): what stands between block tags, without markup."""
    bare = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    cut = F.split(F.regexp_replace(bare, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|table|tr|section|article|br|body|html|main|nav|footer|header)\b[^>]*>", "\x01"), "\x01")
    text = F.transform(cut, lambda t: F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"(?U)\s+", " "))
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.transform(text, replacing(entity, sign))
    kept = F.filter(F.transform(text, strip), lambda t: t != "")
    rows = pages.select(F.col("page_id").cast("string").alias("document_id"), F.posexplode(kept).alias("n", "text"))
    box = F.struct(F.lit(0.0).alias("x0"), F.col("n").cast("double").alias("y0"), F.lit(1.0).alias("x1"), (F.col("n") + 1).cast("double").alias("y1"))
    return rows.select(
        "document_id", F.concat(F.lit("b"), F.col("n").cast("string")).alias("id"), F.lit(1).alias("page_number"), box.alias("bbox"), "text", F.col("n").alias("reading_order_index")
    )


def replacing(old: str, new: str):
    return lambda t: F.replace(t, F.lit(old), F.lit(new))


def json_or_null(text: Column, schema: str) -> Column:
    """A JSON object of this schema; null for what is none."""
    return F.when(F.startswith(F.get_json_object(text, "$"), F.lit("{")), F.from_json(text, schema))


def read_answers(answers: DataFrame) -> DataFrame:
    """document_id, v (the answer as VISION, null if it isn't JSON) and valid, from answers (document_id, response).

    A fenced answer counts without its fence. An answer with a box whose sides don't span anything is not valid.
    """
    read = answers.select("document_id", json_or_null(without_code_fence(F.col("response")), VISION).alias("v"))
    none = F.array().cast("array<boolean>")

    def sound(name: str) -> Column:
        high = DEFAULT_HEIGHT[name]
        boxes = F.transform(f"v.{name}", lambda e: vision_box(e, high))
        return F.forall(F.coalesce(F.transform(boxes, is_valid), none), lambda ok: ok)

    return read.withColumn("valid", F.col("v").isNotNull() & sound("text_blocks") & sound("tables") & sound("figures"))


def vision_box(e: Column, height: float) -> Column:
    side = lambda n, default: F.coalesce(e["bbox"][n], F.lit(default))
    return bbox(side("x0", 0.0), side("y0", 0.0), side("x1", DEFAULT_WIDTH), side("y1", height))


def vision_elements(answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, tables, figures and reading order from a vision model's JSON, from answers (document_id, response).

    Answers that are no JSON, or not valid (see read_answers), give nothing. Missing ids are made of the kind, the page
    and the place among elements of the kind; missing pages are 1. Headers and rows of a table are filled up to the
    longest of them. Texts come before tables before figures in reading order. Answers are read once and stored: each
    kind of element, and the order of each, come from what is stored.
    """
    return elements_of_answers(stored(read_answers(answers)))


def elements_of_answers(read: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, tables, figures and reading order from the table that read_answers gives."""
    read = read.filter("valid")
    sizes = {n: F.greatest(F.coalesce(F.size(f"v.{n}"), F.lit(0)), F.lit(0)) for n in DEFAULT_HEIGHT}
    before = {"text_blocks": F.lit(0), "tables": sizes["text_blocks"], "figures": sizes["text_blocks"] + sizes["tables"]}

    def elements(name: str, kind: str) -> DataFrame:
        rows = read.select("document_id", before[name].alias("before"), F.posexplode(f"v.{name}").alias("n", "e"))
        page = F.coalesce("e.page", F.lit(1))
        made = F.concat(F.lit(f"{kind}_"), page.cast("string"), F.lit("_"), F.col("n").cast("string"))
        ident = F.coalesce(F.nullif(F.col("e.id"), F.lit("")), made)
        return rows.select("document_id", (F.col("before") + F.col("n")).alias("order"), "e", ident.alias("id"), page.alias("page_number"), vision_box(F.col("e"), DEFAULT_HEIGHT[name]).alias("bbox"))

    texts, tabs, figs = elements("text_blocks", "block"), elements("tables", "table"), elements("figures", "figure")
    caption = F.nullif(strip(F.col("e.caption")), F.lit("")).alias("caption")
    blocks = texts.select("document_id", "id", "page_number", "bbox", strip(F.col("e.text")).alias("text"), F.col("order").alias("reading_order_index"))
    rows, header = F.coalesce("e.rows", F.array().cast("array<array<string>>")), F.coalesce("e.headers", F.array().cast("array<string>"))
    width = F.greatest(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)), F.size(header), F.lit(1))
    filled = lambda cells: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    title = F.lit(None).cast("string").alias("title")
    tables = tabs.select("document_id", "id", "page_number", "bbox", title, caption, filled(header).alias("header"), F.transform(rows, filled).alias("rows"))
    none = F.lit(None).cast("string")
    figures = figs.select("document_id", "id", "page_number", "bbox", caption, none.alias("alt_text"), none.alias("type"))
    kinds = (("text_block", texts), ("table", tabs), ("figure", figs))
    order = [df.select("document_id", F.lit(kind).alias("ref_type"), F.col("id").alias("ref_id"), "order") for kind, df in kinds]
    return blocks, tables, figures, reduce(DataFrame.unionByName, order)


def rows_or_none(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one of this schema where there is none yet."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def section_index(spark: SparkSession, path: str) -> DataFrame:
    """The flat section index that sinks.write_index has written."""
    return rows_or_none(spark, path, INDEX, "json").orderBy("document_id", "n")


def document_names(spark: SparkSession, path: str) -> DataFrame:
    """document_id and document_name from a JSON file that maps one to the other."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("document_id", "document_name"))


def facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts that sinks.write_facts has stored, of each document those since it was last replaced."""
    rows = batches.read(spark, path, schemas.FACTS)
    return rows.withColumn("fact_id", F.col("fact_id") + F.col("rows_before") + 1).drop("batch", "listed_at", "rows_before")


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors that sinks.upsert_vectors has stored, of each unit the last one."""
    return batches.read(spark, path, schemas.VECTORS, ("document_id", "ldu_id")).drop("batch", "listed_at", "rows_before")


def table(spark: SparkSession, path: str) -> DataFrame:
    """A table that grows by batches, or any other one of Parquet files."""
    schema = batches.schema_of(spark, path)
    return spark.read.parquet(path) if schema is None else batches.read(spark, path, schema).drop("batch", "listed_at", "rows_before")


def inspect(table: DataFrame, samples: int = 5) -> dict[str, Any]:
    """How many rows and documents a table has, and a few of its rows."""
    counts = table.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("document_id").alias("documents")).first()
    return {"rows": counts["rows"], "documents": counts["documents"], "samples": [r.asDict(True) for r in table.limit(samples).collect()]}
