import json
import os

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.operators import extraction, facts, retrieval, sections
from quire.plans.config import environment
from quire.sources import batches, readers, sinks
from quire.streaming import ingest
from tests.test_documents import ldus


def test_files_are_parsed_where_they_are_read(spark, tmp_path):
    for name, body in (("a.pdf", b"one\ntwo"), ("b.pdf", b"broken"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(body)

    def parse(document_id, content):
        if content == b"broken":
            raise ValueError
        return [{"document_id": document_id, "page": n, "text": t.decode()} for n, t in enumerate(content.split(b"\n"), 1)]

    files, schema = readers.files(spark, str(tmp_path)), "document_id string, page int, text string"
    found = readers.parsed(files, parse, schema).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in found] == [(1, "one"), (2, "two")] and len(found[0]["document_id"]) == 32
    bad = readers.failures(files, parse, schema).collect()
    assert [len(r["document_id"]) for r in bad] == [32] and bad[0]["error"].startswith("error:") and bad[0]["document_id"] != found[0]["document_id"]


def test_html_blocks(spark):
    html = "<html><head><title>x</title></head><body><h1>A &amp; B</h1><script>var a = '<p>';</script><p>one <b>two</b></p><!-- c --><ul><li>i</li></ul></body></html>"
    found = readers.html_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")).orderBy("reading_order_index").collect()
    assert [r["text"] for r in found] == ["A & B", "one two", "i"]


def test_vision_answers(spark):
    box = {"x0": 1, "y0": 2, "x1": 3, "y1": 4}
    answer = {
        "text_blocks": [{"page": 3, "text": " hi ", "bbox": box}, {"id": "own", "text": None}],
        "tables": [{"id": "T", "caption": " ", "headers": ["a", "b"], "rows": [["1"], ["1", "2", "3"]]}, {"page": 2}],
        "figures": [{"caption": "c", "bbox": {"x1": 9}}],
    }
    bad = {"text_blocks": [{"bbox": {"x0": 5, "x1": 5}}]}
    rows = [("d", "```json\n" + json.dumps(answer) + "\n```"), ("e", "no json"), ("f", json.dumps(bad)), ("g", None), ("h", "{}")]
    asked = spark.createDataFrame(rows, "document_id string, response string")
    blocks, tables, figures, order = readers.vision_elements(asked)
    assert [(r["id"], r["page_number"], tuple(r["bbox"]), r["text"]) for r in blocks.orderBy("reading_order_index").collect()] == [("block_3_0", 3, (1, 2, 3, 4), "hi"), ("own", 1, (0, 0, 100, 20), "")]
    got = [(r["id"], r["page_number"], r["caption"], r["header"], r["rows"], tuple(r["bbox"])) for r in tables.orderBy("id").collect()]
    assert got == [("T", 1, None, ["a", "b", ""], [["1", "", ""], ["1", "2", "3"]], (0, 0, 100, 50)), ("table_2_1", 2, None, [""], [], (0, 0, 100, 50))]
    assert [(r["id"], r["caption"], tuple(r["bbox"])) for r in figures.collect()] == [("figure_1_0", "c", (0, 0, 9, 80))]
    assert [r["ref_id"] for r in order.orderBy("order").collect()] == ["block_3_0", "own", "T", "table_2_1", "figure_1_0"]
    attempts = {r["document_id"]: (r["has_document"], r["confidence"], r["notes"]) for r in extraction.vision_model(asked)[1].collect()}
    failed = (False, 0.0, "vision_api_call_failed")
    assert attempts == {"d": (True, 0.8, None), "e": failed, "f": (False, 0.0, "vision_response_invalid"), "g": failed, "h": (True, 0.8, None)}


def test_stores(spark, tmp_path):
    """Facts written, replaced, read and searched; vectors upserted twice; no folder for each document."""
    one, two = ldus(spark, [("paragraph", "Total: 5", 1), ("paragraph", "Rest: 7", 1)], "a"), ldus(spark, [("paragraph", "Total: 6", 1)], "b")
    path = str(tmp_path / "facts")
    assert sinks.write_facts(facts.extract_facts(one.union(two)), path) == 3
    assert sinks.write_facts(facts.extract_facts(ldus(spark, [("paragraph", "Total: 9", 1)], "a")), path, replace_documents=True) == 1
    back = readers.facts(spark, path)
    assert sorted((r["document_id"], r["fact_id"], r["value"]) for r in back.collect()) == [("a", 4, "9"), ("b", 3, "6")]
    asked = spark.createDataFrame([("q", "total", None), ("r", "total", "a")], "query_id string, query string, document_id string")
    assert [(r["query_id"], r["rank"], r["value"]) for r in facts.search_facts(back, asked).orderBy("query_id", "rank").collect()] == [("q", 1, "6"), ("q", 2, "9"), ("r", 1, "9")]
    where = str(tmp_path / "vectors")
    assert sinks.upsert_vectors(retrieval.embedded(one), where) == 2 and sinks.upsert_vectors(retrieval.embedded(two), where) == 1
    changed = ldus(spark, [("paragraph", "Total: 50", 1)], "a")
    assert sinks.upsert_vectors(retrieval.embedded(changed), where) == 1
    kept = readers.vectors(spark, where)
    assert sorted((r["document_id"], r["ldu_id"], r["content"]) for r in kept.collect()) == [("a", "ldu_0001", "Total: 50"), ("a", "ldu_0002", "Rest: 7"), ("b", "ldu_0001", "Total: 6")]
    assert readers.vectors(spark, str(tmp_path / "none")).count() == 0
    sinks.write_ldus(one.union(two), str(tmp_path / "units"))
    assert not [p for p in (tmp_path / "units").iterdir() if p.name.startswith("document")]


def test_index_trees(spark):
    units = ldus(spark, [("heading", "1. A", 1), ("paragraph", "x", 1), ("heading", "1.1 B", 2)])
    index = sections.build_index(units, spark.createDataFrame([("d1", 2), ("d2", 1)], "document_id string, page_count int"))
    trees = {r["document_id"]: json.loads(r["tree"]) for r in sinks.index_trees(index).collect()}
    root = trees["d1"]["root"]
    assert [c["id"] for c in root["child_sections"]] == ["sec_0", "sec_1"] and root["summary"] is None and root["page_end"] == 2 == trees["d1"]["page_count"]
    assert root["child_sections"][0]["ldu_ids"] == ["ldu_0001", "ldu_0002", "ldu_0003"] and trees["d2"]["root"]["child_sections"] == [] and trees["d1"]["built_at"]


def test_summaries_of_sections_with_content(spark):
    units = ldus(spark, [("heading", "1. A", 1), ("paragraph", "one  ", 1), ("heading", " ", 2)])
    counts = spark.createDataFrame([("d1", 2)], "document_id string, page_count int")
    say = lambda title, content, section, document: F.concat(title, F.lit("|"), content)
    said = {r["section_id"]: r["summary"] for r in sections.build_index(units, counts, say).collect()}
    assert said == {"root": None, "sec_0": "1. A|1. A one", "sec_1": None}


def test_round_trips(spark, tmp_path):
    units = ldus(spark, [("heading", "1. A", 1), ("paragraph", "Total: 5", 1)])
    index = sections.build_index(units, spark.createDataFrame([("d1", 2)], "document_id string, page_count int"))
    sinks.write_index(index, str(tmp_path / "index"))
    back = readers.section_index(spark, str(tmp_path / "index"))
    assert [tuple(r) for r in back.select(*index.columns).collect()] == [tuple(r) for r in index.orderBy("n").collect()]
    assert readers.section_index(spark, str(tmp_path / "nothing")).count() == 0
    found = facts.extract_facts(units)
    path = str(tmp_path / "facts")
    assert sinks.write_facts(found, path) == 1 and sinks.write_facts(found, path) == 1
    assert readers.facts(spark, path).count() == 2
    assert sinks.write_facts(found, path, replace_documents=True) == 1
    assert sinks.upsert_vectors(retrieval.embedded(units), str(tmp_path / "vectors")) == 2
    sinks.write_ldus(units, str(tmp_path / "ldus"))
    sinks.write_markdown(units, str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()["value"] == "## 1. A\n\nTotal: 5\n"
    (tmp_path / "names.json").write_text('{"d1": "annual.pdf"}')
    assert [tuple(r) for r in readers.document_names(spark, str(tmp_path / "names.json")).collect()] == [("d1", "annual.pdf")]
    assert readers.inspect(readers.facts(spark, path))["documents"] == 1 and sinks.preview(units).count() == 2


def test_incremental_ingestion(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def element(document, n, text):
        return {"document_id": document, "ref_type": "text_block", "id": f"b{n}", "page_number": 1, "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "order": n, "text": text}

    def arrive(name, rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows))
        ingest.ingest(spark, str(source), str(target), str(tmp_path / "state")).awaitTermination()

    arrive("1.json", [element("a", 0, "1. First"), element("a", 1, "Total: 5"), element("b", 0, "plain")])
    arrive("2.json", [element("a", 0, "1. Second")])
    units = ingest.latest(spark, str(target), "ldus")
    assert sorted((r["document_id"], r["text"]) for r in units.collect()) == [("a", "1. Second"), ("b", "plain")]
    assert spark.read.parquet(f"{target}/facts").count() == 1


def test_a_document_that_comes_again_without_facts_has_none(spark, tmp_path):
    """What counts is that a document came, not that it has rows: in the stream and in the store."""
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def arrive(name, rows):
        elements = [{"document_id": d, "ref_type": "text_block", "id": f"b{n}", "page_number": 1, "bbox": {"x0": 0, "y0": 0, "x1": 1, "y1": 1}, "order": n, "text": text} for d, n, text in rows]
        (source / name).write_text("\n".join(json.dumps(r) for r in elements))
        ingest.ingest(spark, str(source), str(target), str(tmp_path / "state")).awaitTermination()

    values = lambda: sorted((r["document_id"], r["value"]) for r in ingest.latest(spark, str(target), "facts").collect())
    arrive("1.json", [("a", 0, "Total: 5"), ("b", 0, "Total: 6")])
    assert values() == [("a", "5"), ("b", "6")]
    arrive("2.json", [("a", 0, "Nothing to see here")])
    assert values() == [("b", "6")]
    assert sorted(r["text"] for r in ingest.latest(spark, str(target), "ldus").collect()) == ["Nothing to see here", "Total: 6"]
    path, both = str(tmp_path / "facts"), ldus(spark, [("paragraph", "Total: 5", 1)], "a").union(ldus(spark, [("paragraph", "Total: 6", 1)], "b"))
    sinks.write_facts(facts.extract_facts(both), path)
    again = ldus(spark, [("paragraph", "Nothing to see here", 1)], "a")
    assert sinks.write_facts(facts.extract_facts(again), path, replace_documents=True, documents=again) == 0
    assert [(r["document_id"], r["fact_id"]) for r in readers.facts(spark, path).collect()] == [("b", 2)]


def test_writers_beside_each_other(spark, tmp_path, monkeypatch):
    """Batches of two writers stand side by side, one that fails is not seen, one compacted meanwhile loses nothing."""
    path, keys = str(tmp_path / "table"), ("document_id", "n")
    schema = "document_id string, n int, v string"
    rows = lambda *found: spark.createDataFrame(list(found), schema)
    read = lambda keys=(): sorted(tuple(r) for r in batches.read(spark, path, schema, keys).select("document_id", "n", "v").collect())
    assert read() == [] and batches.compact(spark, path, schema) == 0
    first = batches.laid_down(rows(("a", 1, "first"), ("b", 2, "first")), path, None, False)
    assert batches.put(rows(("b", 1, "second")), path) == 1  # another writer, before the first one has listed its batch
    assert read() == [("b", 1, "second")]
    batches.enter(spark, path, *first, False)
    assert read() == [("a", 1, "first"), ("b", 1, "second"), ("b", 2, "first")]
    with pytest.raises(Exception):  # noqa: B017, PT011  a job that ends in an error
        batches.put(rows(("c", 1, "x")).withColumn("v", F.raise_error(F.lit("broken"))), path)
    spark.createDataFrame([("c", 1, "never listed")], schema).write.parquet(f"{path}/rows/batch=bdead")
    assert len(read()) == 3
    batches.put(rows(("a", 1, "third")), path, replaces=True)
    assert read() == [("a", 1, "third"), ("b", 1, "second"), ("b", 2, "first")]
    usual = batches.put

    def after_another(*a, **b):
        monkeypatch.setattr(batches, "put", usual)
        usual(rows(("b", 7, "meanwhile")), path, replaces=True)
        return usual(*a, **b)

    monkeypatch.setattr(batches, "put", after_another)
    before = len(batches.listed(spark, path))
    batches.compact(spark, path, schema)
    assert read() == [("a", 1, "third"), ("b", 7, "meanwhile")] and len(batches.listed(spark, path)) == 2 < before
    batches.put(rows(("a", 1, "last")), path)
    assert read(keys) == [("a", 1, "last"), ("b", 7, "meanwhile")] and len(read()) == 3
    batches.compact(spark, path, schema, keys)
    assert read() == [("a", 1, "last"), ("b", 7, "meanwhile")] and len(batches.listed(spark, path)) == 1


def test_ledger_counts_of_a_stream(spark, tmp_path):
    (tmp_path / "l").mkdir()
    rows = [("2024-01-01T00:00:00", "layout", 0.5), ("2024-01-01T00:01:00", "layout", 1.0), ("2024-01-01T01:00:00", "vision", 0.2)]
    (tmp_path / "l" / "1.json").write_text("\n".join(json.dumps({"start_time": t, "strategy_used": s, "confidence_score": c}) for t, s, c in rows))
    stream = spark.readStream.schema("start_time timestamp, strategy_used string, confidence_score double").json(str(tmp_path / "l"))
    query = ingest.ledger_counts(stream).writeStream.outputMode("complete").format("memory").queryName("ledger").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["strategy_used"], r["runs"], r["confidence"]) for r in spark.table("ledger").collect()) == [("layout", 2, 0.75), ("vision", 1, 0.2)]


def test_command_line(spark, tmp_path, capsys):
    units = ldus(spark, [("heading", "1. Results", 1), ("paragraph", "Revenue: 4.2B", 1)])
    store = tmp_path / "store"
    sinks.write_index(sections.build_index(units, spark.createDataFrame([("d1", 1)], "document_id string, page_count int")), str(store / "index"))
    sinks.write_facts(facts.extract_facts(units), str(store / "facts"))
    sinks.upsert_vectors(retrieval.embedded(units), str(store / "vectors"))
    (store / "names.json").write_text('{"d1": "annual.pdf"}')
    assert cli.main(["ask", "results revenue", "--store", str(store)]) == 0
    said = capsys.readouterr().out
    assert "Document — Revenue: 4.2B" in said and "annual.pdf p.1" in said and "verified: True" in said
    assert cli.main(["ask", "results", "--store", str(store), "--document", "other"]) == 0 and "(no citations)" in capsys.readouterr().out
    assert cli.main(["audit", "the report says it", "--store", str(store)]) == 1
    assert cli.main(["audit", "revenue of 4.2B", "--store", str(store)]) == 0 and "Verified: True" in capsys.readouterr().out
    assert cli.main(["inspect", str(store / "facts")]) == 0 and '"rows": 1' in capsys.readouterr().out


def test_environment_file(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text('# c\nQUIRE_A="one"\nQUIRE_B=two\nnothing\n')
    monkeypatch.setenv("QUIRE_B", "kept")
    monkeypatch.delenv("QUIRE_A", raising=False)
    assert environment((tmp_path / "none", tmp_path)) == {"QUIRE_A": "one", "QUIRE_B": "two"}
    assert (os.environ["QUIRE_A"], os.environ["QUIRE_B"]) == ("one", "kept")
    monkeypatch.delenv("QUIRE_A")
