"""Tests of the findings of round 3."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions.vectors import squared_distance
from quire.operators import chunking, extraction, fact_index, facts, retrieval, sections, trees, vector_index
from quire.plans import derived
from quire.plans.storage import dealt_by, stored, written
from quire.sources import readers, sinks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vision_calls_stream_through_a_task(spark):
    pages = spark.range(20_000).select((F.col("id") % 5000).cast("string").alias("document_id"), (9 - F.col("id") / 5000).cast("int").alias("page"), F.col("id").cast("string").cast("binary").alias("image"))
    found = extraction.answered(pages, lambda document_id, images: b" ".join(images).decode())
    assert "FlatMapGroupsInPandas" not in plan(found)
    got = dict(found.collect())
    assert len(got) == 5000 and got["7"] == "15007 10007 5007 7"


def test_answers_and_exports_are_read_once(spark):
    answers = spark.createDataFrame([("a", '{"text_blocks": [{"text": "x"}], "tables": [{"headers": ["h"]}], "figures": [{}]}'), ("b", "no")], "document_id string, response string")
    for element in readers.vision_elements(answers):
        assert "from_json" not in plan(element)
    assert [e.count() for e in readers.vision_elements(answers)] == [1, 1, 1, 3]
    exports = spark.createDataFrame([("a", '{"texts": [{"text": "x"}], "pictures": [{}]}'), ("b", "no")], "document_id string, export string")
    elements, attempts = extraction.layout_model(exports)
    assert not any("from_json" in plan(e) for e in (elements[0], elements[1], elements[2], elements[3], attempts))


def test_units_are_stored_compressed(spark, tmp_path):
    units = spark.createDataFrame([("a", 1, "text " * 200)], "document_id string, seq int, text string")
    sinks.write_ldus(units, str(tmp_path / "units"))
    files = [p for p in (tmp_path / "units").rglob("part-*") if not p.name.endswith(".crc")]
    assert files and all(p.stat().st_size < 500 for p in files)
    assert spark.read.json(str(tmp_path / "units")).first()["text"] == "text " * 200


def test_a_payload_is_written_as_json_once(spark):
    kinds = "header array<string>, rows array<array<string>>, title string, caption string, label string, alt_text string, type string, list_complete boolean"
    units = spark.createDataFrame([("", (["h"], [["é"]], None, "c", "Table 1", None, None, None)), (" \n", (None,) * 8)], f"text string, raw_payload struct<{kinds.replace(' ', ':').replace(',:', ',')}>")
    found = units.select(retrieval.searchable(units).alias("content"))
    assert [r["content"] for r in found.collect()] == ['{"caption": "c", "header": ["h"], "label": "Table 1", "rows": [["\\u00e9"]]}', " "]
    assert plan(found).count('"label": ') == 1


def test_near_vectors_are_found_without_meeting_all(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(900)] + [(900, None), (901, [1.0]), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 1.0]), (904, [float("inf"), 0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = vectors.filter("vec_id % 50 = 0 or vec_id > 898").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    pairs = vectors.crossJoin(asked).withColumn("distance", squared_distance(F.col("embedding"), F.col("query_vector")))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("rank <= 7")
    told = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert told(retrieval.nearest(vectors, asked, 7, keys=("vec_id",))) == told(want)
    apart = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("embedding")).coalesce(1)
    few = apart.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert retrieval.close_pairs(apart, few, 5).count() < 60 * 3000 / 10


def test_an_index_of_vectors_stores_them_once(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(vector_index, "stored", lambda df: kept.append(df.columns) or stored(df))
    vectors = spark.range(300).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 17).cast("double"), (F.col("id") % 5).cast("double")).alias("embedding"))
    vector_index.write(vectors, str(tmp_path / "cells"), cells=4)
    assert vector_index.read_vectors(spark, str(tmp_path / "cells")).count() == 300
    assert not any("embedding" in columns for columns in kept)


def test_units_lie_in_buckets_of_documents(spark, small):
    units = derived.ldus(spark, small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with dealt_by(spark):
            pairs = units.join(units.select("document_id", "seq", F.lit(1).alias("one")), ["document_id", "seq"])
            assert "Exchange hashpartitioning" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert pairs.count() == units.count() > 0


def test_an_index_folds_headings_and_gathers_members_once(spark, monkeypatch):
    calls = []
    inner = sections.innermost
    monkeypatch.setattr(sections, "innermost", lambda *args: calls.append(1) or inner(*args))
    rows = [("d", 1, "u1", "heading", "1. One", [1]), ("d", 2, "u2", "paragraph", " first ", [1]), ("d", 3, "u3", "paragraph", None, [1]), ("d", 4, "u4", "heading", "2. Two", [1])]
    units = spark.createDataFrame(rows, "document_id string, seq int, ldu_id string, content_type string, text string, page_refs array<int>")
    counts = spark.createDataFrame([("d", 1)], "document_id string, page_count int")
    index = sections.build_index(units, counts, lambda title, content, section_id, document_id: F.concat(title, F.lit("|"), content))
    assert {r["section_id"]: r["summary"] for r in index.collect()} == {"root": None, "sec_0": "1. One|1. One first ", "sec_1": "2. Two|2. Two"}
    assert calls == [1] and "folded" not in plan(index)


FACT = "document_id string, seq int, at struct<a:int,b:int>, entity string, metric string, value string, period string"


def test_a_word_is_posted_once_for_a_block_of_facts(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}", i, (0, 0), "total", "of", f"v{i}", None) for i in range(900)], FACT)
    fact_index.write(rows, str(tmp_path))
    postings = spark.read.parquet(f"{tmp_path}/postings")
    assert postings.filter("word = 'total'").count() == 3 and postings.filter("word = 'v7'").count() == 1
    found = fact_index.search(spark, str(tmp_path), spark.createDataFrame([("q", "TOTAL")], "query_id string, query string"), limit=5)
    assert sorted((r["rank"], r["document_id"], r["seq"]) for r in found.collect()) == [(n + 1, "d0", 3 * n) for n in range(5)]


def test_a_search_puts_only_first_blocks_in_order(spark):
    rows = [(f"d{i % 40:02}", 10_000 - i, (0, i % 2), "total", "of", f"v{i}", None) for i in range(4000)] + [(None, None, (0, 0), "total", "", "none", None), ("", None, (0, 0), "total", "", "blank", None), (None, 9, (0, 0), "total", "", "last", None)]
    facts_ = spark.createDataFrame(rows, FACT)
    asked = spark.createDataFrame([("q", "total", None), ("q2", "v39", "d39"), (None, "none", None)], "query_id string, query string, document_id string")
    found = facts.search_facts(facts_, asked, limit=3)
    assert sorted((r["query_id"] or "", r["rank"], r["value"]) for r in found.collect()) == [("", 1, "none"), ("q", 1, "none"), ("q", 2, "last"), ("q", 3, "blank"), ("q2", 1, "v3999"), ("q2", 2, "v3959"), ("q2", 3, "v3919")]
    # what is put in order are facts of blocks with first hits, which a broadcast names
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "__chunk" in plan and "NestedLoop" not in plan


def test_facts_are_cut_once_and_looked_for_where_they_can_be(spark):
    none = (None,) * 3
    rows = [
        ("d", 1, "u1", "table", "x", (["Name", None, " ", " é "], [[" a　", "", None, " \t ", "beyond"], [" b", "1", " 2", "3 "]]), [1], "h", None),
        ("d", 2, "u2", "paragraph", "Net total - 5\nGross: 7 \nq3 2020 and Fy2021", (None, None), [2], "h", None), ("d", 3, "u3", "paragraph", "plain text 2020", (None, None), [2], "h", None), ("d", 4, "u4", "list", *none[:1], (None, None), [2], "h", None),
    ]
    units = spark.createDataFrame(rows, "document_id string, seq int, ldu_id string, content_type string, text string, raw_payload struct<header:array<string>,rows:array<array<string>>>, page_refs array<int>, content_hash string, bounding_boxes array<struct<x0:double,y0:double,x1:double,y1:double>>")
    found = facts.extract_facts(units)
    cells = [("a", "Name", "a"), ("b", "Name", "b"), ("b", "col_1", "1"), ("b", "", "2"), ("b", "é", "3")]
    texts = [("Document", "Net total", "5"), ("Document", "Gross", "7"), ("Document", "period", "q3 2020"), ("Document", "period", "Fy2021")]
    assert sorted((r["entity"], r["metric"], r["value"]) for r in found.collect()) == sorted(cells + texts)
    assert re.search(r"Contains\(text#\d+, :\)", plan(found)) and "metrics#" in plan(found)


def test_facts_are_numbered_by_blocks(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr("quire.plans.storage.written", lambda df, whole=written: kept.append(df.columns) or whole(df))
    keys = [(d, n, (a, 0)) for d in (None, "", "a", "b10", "b9", "é") for n in (None, -1, 5, 4095, 4096, 50_000) for a in (1, 0, None)]
    random.Random(1).shuffle(keys)
    rows = [(*key, "e", "m", f"{i}", None) for i, key in enumerate(keys)]
    assert sinks.write_facts(spark.createDataFrame(rows, FACT), f"{tmp_path}/facts") == len(rows)
    back = spark.read.parquet(f"{tmp_path}/facts/rows").orderBy("fact_id").collect()
    want = spark.createDataFrame(rows, FACT).orderBy("document_id", "seq", "at").collect()
    assert [r["fact_id"] for r in back] == list(range(len(rows)))
    assert [r["value"] for r in back] == [r["value"] for r in want]
    assert kept and not any("value" in columns for columns in kept)


def test_parts_of_entries_grow_in_number_not_in_size(spark):
    assert [chunking.parts_of(n, 12) for n in (0, 99_999, 600_000, 2_000_000)] == [1, 1, 6, 12]
    for total in (7_650_000, 76_500_000, 459_000_000):
        assert total / chunking.parts_of(total, 12) <= 200_000 and total / chunking.parts_of(total, 12) > 100_000


def test_topics_are_compared_with_sections_as_they_are_read(spark, monkeypatch):
    rows = [(f"d{d}", f"sec_{n}", n, f"Order {n}", None, [], ["tables"], [f"u{n}"]) for d in range(5) for n in range(4)] + [("e", "sec_0", 0, None, None, None, [], []), ("e", "sec_1", 1, "é order", "say", ["Two words"], [], [])]
    index = spark.createDataFrame(rows, "document_id string, section_id string, n int, title string, summary string, key_entities array<string>, data_types_present array<string>, ldu_ids array<string>")
    topics = spark.createDataFrame([("t1", "order 3", None), ("t2", "É", "e"), ("t3", " ", None), ("t4", None, None), ("t5", "tables", "none"), ("t6", "wo wor", None)], "topic_id string, topic string, only string")
    told = lambda df: sorted(map(str, df.select("topic_id", "document_id", "n", "score", "rank", "ldu_ids").collect()))
    by_words = told(sections.navigate(index, topics, 3, False, few=0))
    assert by_words
    monkeypatch.setattr(sections, "hit_sections", None)
    assert told(sections.navigate(index, topics, 3, False)) == by_words
    found = sections.navigate(index, topics.filter("topic_id = 't1'"), 1)
    assert sorted((r["document_id"], r["n"], r["score"]) for r in found.collect()) == [*[(f"d{d}", 3, 13.0) for d in range(5)], ("e", 1, 3.0)]


def test_headings_in_buckets_are_not_dealt_out_again(spark, small):
    ranges = sections.section_ranges(derived.ldus(spark, small), derived.page_counts(spark, small))
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" not in plan and plan.count("MapInArrow") == 1
    units = spark.createDataFrame([(d, n, "heading", t, [n]) for d in ("b", "a") for n, t in enumerate(("1. One", "1.1 In", "2. Two"), 1)], "document_id string, seq int, content_type string, text string, page_refs array<int>")
    found = sections.section_ranges(units.repartition(4), spark.createDataFrame([("a", 9), ("b", 9)], "document_id string, page_count int"))
    rows = [(0, [0], 3), (1, [0, 1], 3), (2, [2], None)]
    assert sorted((r["document_id"], r["n"], r["path"], r["end_seq"]) for r in found.collect()) == [(d, *r) for d in ("a", "b") for r in rows]


def test_a_section_of_a_tree_is_taken_apart_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(trees, "stored", lambda df: kept.append((df.columns, plan(df))) or stored(df))
    inner = '{"id": "a", "level": 1, "child_sections": [{"id": "b", "title": "B", "ldu_ids": ["u"]}, 7, null, [], "x", {"title": "bare"}]}'
    rows = spark.createDataFrame([(f'{{"document_id": "d", "root": {{"id": "root", "document_id": "d", "child_sections": [{inner}, {{"id": "c", "child_sections": {{}}}}]}}}}',), ('{"root": 5}',), ("no",), ('{"root": null}',)], "tree string")
    found = [(r["section_id"], r["parent_id"], r["n"], r["path"], r["title"], r["level"], r["owner"], r["ldu_ids"]) for r in trees.sections(rows).orderBy("n").collect()]
    none = ("", 0, None, [])
    assert found == [
        ("root", None, -1, [], "", 0, "d", []), ("a", "root", 0, [0], "", 1, None, []), ("b", "a", 1, [0, 0], "B", 0, None, ["u"]),
        (None, "a", 2, [0, 5], "bare", *none[1:]), ("c", "root", 3, [1], *none),
    ]
    assert len(kept) == 4 and not any("node" in columns or "schema_of_variant" in made for columns, made in kept)
