import random

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
BLOCK = f"document_id string, id string, page_number int, bbox {BOX}, text string, reading_order_index int"
TABLE = f"document_id string, id string, page_number int, bbox {BOX}, title string, caption string, header array<string>, rows array<array<string>>"
FIGURE = f"document_id string, id string, page_number int, bbox {BOX}, caption string, alt_text string, type string"
ORDER = "document_id string, ref_type string, ref_id string, order int"
TEXTS = ["1. Title words", "2.1 Deeper part", "- item", "* other item", "1) counted", "3. both heading and item", "plain paragraph of words", "", "   ", "ALL CAPITALS", "see Table 2 and Figure 1", "a) lettered"]


def elements(documents, seed=3):
    """Documents of (name, entries, given order?, favourite texts)."""
    rnd, blocks, tables, figures, order = random.Random(seed), [], [], [], []
    for name, size, given, texts in documents:
        for k in range(size):
            box = (float(k), 1.0, float(k + 2), 5.0) if k % 5 else None
            page, kind = k // 7 + 1, rnd.choice(["text_block"] * 8 + ["table", "figure"])
            ref = f"{kind[0]}{k}"
            if kind == "text_block" or not given:
                blocks.append((name, ref, page, box, rnd.choice(texts), k))
            elif kind == "table":
                tables.append((name, ref, page, box, None, f"caption {k}", ["a", "b"], [["1", "2"]]))
            else:
                figures.append((name, ref, page, box, rnd.choice([None, "a figure"]), None, "chart"))
            if given:
                order.append((name, kind, ref if rnd.random() > 0.03 else "missing", k))
    return blocks, tables, figures, order


def frames(spark, documents, seed=3):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(elements(documents, seed), (BLOCK, TABLE, FIGURE, ORDER), strict=True)]


def units(df):
    return sorted((str(r) for r in df.select("document_id", "seq", *[c for c in df.columns if c not in ("document_id", "seq")]).collect()))


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


LISTS, RUNS = ["- item", "* other item", "3. both heading and item"], ["3. both heading and item", "2. also both"]
DOCUMENTS = [("a", 400, True, TEXTS), ("b", 300, True, LISTS), ("c", 250, False, TEXTS), ("d", 3, True, TEXTS), ("e", 200, True, RUNS), ("f", 150, True, ["- item"]), ("g", 1, False, TEXTS), ("h", 120, True, ["x", ""])]


@pytest.mark.parametrize("seed", [3, 4])
def test_parts_give_the_units_that_whole_documents_give(many_parts, seed):
    """Long documents by parts are as all documents at once; lists, runs, numbers and headings go on beyond a part's end."""
    found = frames(many_parts, DOCUMENTS, seed)
    whole = units(chunking.chunk(*found))
    assert units(chunking.chunk(*found, long=100)) == whole
    assert units(chunking.chunk(*found, long=0)) == whole


def test_a_long_document_is_the_work_of_many_tasks(many_parts):
    """One document of 200,000 blocks: its parts are even, whatever else there is."""
    many_parts.conf.set("spark.sql.shuffle.partitions", "40")
    blocks = many_parts.range(200_000).select(
        F.lit("long").alias("document_id"), F.concat(F.lit("b"), "id").alias("id"), (F.col("id") / 50).cast("int").alias("page_number"), F.lit(None).cast(BOX).alias("bbox"),
        F.when(F.col("id") % 9 == 0, "1. Heading").when(F.col("id") % 9 < 4, "- item").otherwise("words").alias("text"), F.col("id").cast("int").alias("reading_order_index"),
    )
    nothing = [many_parts.createDataFrame([], schema) for schema in (TABLE, FIGURE, ORDER)]
    found = chunking.looked_up(chunking.given_order(blocks, nothing[2]), chunking.referenced(blocks, nothing[0], nothing[1]).withColumn("found", F.lit(True)))
    sizes = [r["count"] for r in chunking.in_parts(found).groupBy("part").count().collect()]
    assert len(sizes) > 32 and max(sizes) < 2 * 200_000 / len(sizes)
    made = chunking.chunk(blocks, *nothing)
    counts = {r["content_type"]: r["count"] for r in made.groupBy("content_type").count().collect()}
    # a list is broken where a page ends
    assert counts["heading"] == 22223 and counts["paragraph"] == sum(i % 9 >= 4 for i in range(200_000))
    assert counts["list"] == sum(i % 9 in (1, 2, 3) and (i % 9 == 1 or i // 50 != (i - 1) // 50) for i in range(200_000))


def test_index_order_is_for_documents_without_a_given_one(spark):
    blocks, tables, figures, order = frames(spark, [("a", 30, True, TEXTS), ("b", 30, False, TEXTS)])
    got = {r["document_id"]: r["n"] for r in chunking.given_order(blocks, order).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"a": 30, "b": 30}
