"""Extracted documents made from order tables: the inputs on which queries show the operators.

Each customer is a document. Each of its orders is a numbered section with a sub-section, labelled values, periods, a
short list, a table of its lines, a sentence that mentions table and figure, and for some a figure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.geometry import bbox
from quire.operators import chunking, triage
from quire.plans.storage import stored, stored_once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(by))
    return rows.withColumn("document_id", F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))).withColumn("page", F.floor(F.col("k") / 2).cast("int") + 1)


def box_at(order: Column) -> Column:
    return bbox(F.lit(10.0), order, F.lit(110.0), order + 8)


def text_entries() -> Column:
    k, year = F.col("k").cast("string"), F.year("o_orderdate").cast("string")
    second = F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 5 == 0, "1. numbered item").otherwise("- clerk check")
    texts = {
        0: F.concat(k, F.lit(". Order "), F.col("o_orderkey").cast("string")),
        1: F.concat(k, F.lit(".1 Status and totals")),
        2: F.concat(F.lit("Order status: "), "o_orderstatus"),
        3: F.concat(F.lit("Placed in Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), year, F.lit(" and FY "), year),
        4: F.concat(F.lit("- priority "), "o_orderpriority"),
        5: second,
        7: F.concat(F.lit("See Table "), k, F.lit(" and Figure 1.")),
    }
    return F.array(*[F.struct(F.lit(e).alias("e"), t.alias("text")) for e, t in texts.items()])


def extracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, tables, figures and reading order of all customers' documents; all are made from one stored table."""
    orders = stored(numbered_orders(spark, sf_dir).select("document_id", "page", "k", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    name = lambda kind: F.concat(F.lit(kind), F.col("k").cast("string"))
    place = lambda e: (F.col("k") * 10 + e).cast("int")
    blocks = orders.select("document_id", "page", "k", F.explode(text_entries()).alias("t")).select(
        "document_id", F.concat(name("b"), F.lit("_"), F.col("t.e").cast("string")).alias("id"), F.col("page").alias("page_number"),
        box_at(place(F.col("t.e"))).alias("bbox"), F.col("t.text").alias("text"), place(F.col("t.e")).alias("reading_order_index"),
    )
    cell = F.array(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string"))
    # lines are dealt out as they are, into parts that are no larger where there are more of them
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    lines = lines.repartition(chunking.parts_of(lines.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))), "l_orderkey")
    cells = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("cells")))).alias("lines"))
    rows = F.coalesce(F.transform("lines", lambda x: x["cells"]), F.array().cast("array<array<string>>"))
    tables = orders.join(cells, orders["o_orderkey"] == cells["l_orderkey"], "left").select(
        "document_id", name("t").alias("id"), F.col("page").alias("page_number"), box_at(place(6)).alias("bbox"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("Lines of order "), F.col("o_orderkey").cast("string")).alias("caption"), F.array(F.lit("Line"), F.lit("Quantity"), F.lit("Price")).alias("header"), rows.alias("rows"),
    )
    figures = orders.filter(F.col("o_orderkey") % 2 == 0).select(
        "document_id", name("f").alias("id"), F.col("page").alias("page_number"), box_at(place(8)).alias("bbox"), F.when(F.col("k") % 2 == 0, "Totals by line").alias("caption"),
        F.lit(None).cast("string").alias("alt_text"), F.lit("chart").alias("type"),
    )
    order = blocks.select("document_id", F.lit("text_block").alias("ref_type"), F.col("id").alias("ref_id"), F.col("reading_order_index").alias("order"))
    order = order.unionByName(orders.select("document_id", F.lit("table").alias("ref_type"), name("t").alias("ref_id"), place(6).alias("order")))
    with_figure = orders.filter(F.col("o_orderkey") % 2 == 0)
    order = order.unionByName(with_figure.select("document_id", F.lit("figure").alias("ref_type"), name("f").alias("ref_id"), place(8).alias("order")))
    return blocks, tables, figures, order


def ldus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical units of all customers' documents, chunked the first time that an application asks for them."""
    sources = [table(spark, sf_dir, name) for name in ("orders", "lineitem")]
    return stored_once("ldus", sources, lambda: chunking.chunked(*extracted(spark, sf_dir)))


def page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and page_count of the customers' documents."""
    return numbered_orders(spark, sf_dir).groupBy("document_id").agg(F.max("page").alias("page_count"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, n (from 0) and text of the lines of documents."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return rows


def signal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page signals with an order as document and its lines as pages; ratios are sixty-fourths, so that sums are exact."""
    share = lambda c, by: (F.col(c) % by).cast("double") / 64
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(F.col("l_quantity").cast("int") * 20).alias("chars"),
        share("l_partkey", 65).alias("image_ratio"), share("l_suppkey", 33).alias("table_ratio"), (F.col("l_linenumber") % 3).alias("table_regions"), (1 + F.col("l_partkey") % 2).alias("columns"),
    )


def cost_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, origin, layout and estimated cost from the page signals."""
    signals = signal_pages(spark, sf_dir)
    rows = triage.origins(signals).join(triage.layouts(signals), "document_id")
    return rows.select("document_id", "origin", "layout", rules.estimated_cost(F.col("origin"), F.col("layout")).alias("estimated_cost"))


def attempted(document_id: Column, s: int) -> list[Column]:
    """What the strategy of number s comes to for a document: made up, but the same in SQL."""
    note = F.when((document_id + s) % 5 == 0, F.lit(f"n{s}")).otherwise("")
    return [((document_id + s) % 4 != 0).alias("has_document"), (((document_id * 7 + s * 3) % 10).cast("double") / 10).alias("confidence"), note.alias("notes")]


def measured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page measures with an order as document and its lines as pages."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page"), (F.col("l_quantity").cast("int") * 3).alias("char_count"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"),
        (F.col("l_quantity").cast("int") * 3000).cast("double").alias("text_area"), ((F.col("l_suppkey") % 8) * 60000).cast("double").alias("image_area"), (F.col("l_partkey") % 4 != 0).alias("has_font"),
    )
