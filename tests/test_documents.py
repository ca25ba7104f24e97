import json

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, facts, retrieval, sections, validation
from quire.plans import schemas

BOX = (0.0, 0.0, 100.0, 20.0)


def extracted(spark, lines, tables=(), figures=(), order=None, document="d1"):
    """lines: (id, page, text); tables: (id, page, title, caption, header, rows); order: (type, id)."""
    blocks = [(document, i, p, BOX, t, n) for n, (i, p, t) in enumerate(lines)]
    tabs = [(document, i, p, BOX, title, caption, header, rows) for i, p, title, caption, header, rows in tables]
    figs = [(document, i, p, BOX, caption, alt, kind) for i, p, caption, alt, kind in figures]
    entries = [(document, kind, ref, n) for n, (kind, ref) in enumerate(order or [])]
    return (
        spark.createDataFrame(blocks, schemas.TEXT_BLOCKS), spark.createDataFrame(tabs, schemas.TABLES), spark.createDataFrame(figs, schemas.FIGURES),
        spark.createDataFrame(entries, schemas.READING_ORDER),
    )


@pytest.fixture(scope="module")
def report(spark):
    lines = [("b1", 1, "1. HARBOUR DUES"), ("b2", 1, "1) Tonnage bands"), ("b3", 1, "2) Night pilots"), ("b4", 1, "The figures stand in Table 1.")]
    tables = [("t1", 1, None, None, ["Metric", "Value"], [["Revenue", "4.2B"]])]
    figures = [("f1", 1, "Figure 1: Ships by quarter", None, None), ("f2", 1, None, "", None)]
    order = [("text_block", "b1"), ("text_block", "b2"), ("text_block", "b3"), ("table", "t1"), ("text_block", "b4"), ("figure", "f1"), ("figure", "f2"), ("text_block", "gone")]
    return chunking.chunk(*extracted(spark, lines, tables, figures, order)).cache()


def rows(df):
    return {r["ldu_id"]: r for r in df.collect()}


def test_a_report_is_chunked_in_reading_order(report):
    units = rows(report)
    kinds = [r["content_type"] for r in sorted(units.values(), key=lambda r: r["seq"])]
    assert kinds == ["heading", "list", "table", "paragraph", "figure", "other"]
    assert units["ldu_0002"]["text"] == r"1) Tonnage bands\n2) Night pilots"
    assert all(u["parent_section_id"] == "ldu_0001" for k, u in units.items() if k != "ldu_0001")
    assert units["ldu_0004"]["relationships"] == {"references_table": ["ldu_0003"]}
    assert units["ldu_0003"]["raw_payload"]["header"] == ["Metric", "Value"] and units["ldu_0003"]["text"] == r"| Metric | Value |\n| --- | --- |\n| Revenue | 4.2B |"
    assert units["ldu_0006"]["text"] == "Figure 2"


def test_payload_json_is_canonical(spark):
    header, body = ['a "q"', "é"], [["1", "b\\"], ["", "\t"]]
    df = chunking.chunk(*extracted(spark, [], [("t1", 1, "T", "C", header, body)], order=[("table", "t1")]))
    got = df.select(chunking.payload_json(F.col("raw_payload")).alias("j")).first()["j"]
    assert got == json.dumps({"header": header, "rows": body, "title": "T", "caption": "C", "label": "Table 1"}, sort_keys=True, ensure_ascii=False)


#: Lines, and by hand whether each may be a heading (h) and whether it has a list mark (l).
LINES = {"1. item": "hl", "- a": "l", "(b) c": "l", "2) d": "l", "plain": "", "CAPS": "h", "": "", "3.1 deep": "h", "* x " + "y" * 90: "l"}


def machine(entries):
    """The units of one document by a plain walk: entries are (page, text), None for a missing block. What LINES says decides."""
    heading, listed = (lambda t: "h" in LINES[t]), (lambda t: "l" in LINES[t.strip()])
    out, i = [], 0
    while i < len(entries):
        page, t = entries[i]
        t = (t or "").strip()
        if not t:
            i += 1
        elif heading(t):
            out.append(("heading", t))
            i += 1
        elif listed(t):
            j = i + 1
            while j < len(entries) and entries[j][0] == page and (entries[j][1] or "").strip() and listed(entries[j][1]):
                j += 1
            out.append(("list", r"\n".join(e[1].strip() for e in entries[i:j])))
            i = j
        else:
            out.append(("paragraph", t))
            i += 1
    return out


def test_runs_of_list_items_are_those_of_a_walk(spark):
    import random

    rnd = random.Random(5)
    texts = list(LINES)
    made, expected = None, {}
    for d in range(25):
        lines = [(f"b{n}", 1 + n // rnd.choice([3, 5]), rnd.choice(texts)) for n in range(30)]
        parts = extracted(spark, lines, document=f"d{d}")
        made = parts if made is None else tuple(a.union(b) for a, b in zip(made, parts, strict=True))
        expected[f"d{d}"] = machine([(p, t) for _, p, t in lines])
    found = chunking.chunk(*made).collect()
    for d, units in expected.items():
        assert [(r["content_type"], r["text"]) for r in sorted((r for r in found if r["document_id"] == d), key=lambda r: r["seq"])] == units


def ldus(spark, units, document="d1"):
    """units: (type, text, page)."""
    made = [
        (document, f"ldu_{n:04d}", n, kind, text, None, [page] if page else [], [BOX], None, len(text.split()), f"h{n}", {}) for n, (kind, text, page) in enumerate(units, 1)
    ]
    return spark.createDataFrame(made, schemas.LDUS)


def test_sections_with_levels_pages_and_what_precedes_them(spark):
    units = ldus(spark, [("paragraph", "before", 1), ("heading", "1. A", 1), ("paragraph", "a", 1), ("heading", "1.1 B", 2), ("paragraph", "b", 3), ("heading", "2. C", 3), ("table", "c", 5), ("paragraph", "z", 9)])
    counts = spark.createDataFrame([("d1", 9), ("d2", 4)], "document_id string, page_count int")
    index = {r["section_id"]: r for r in sections.build_index(units, counts).filter("document_id = 'd1'").collect()}
    assert [(index[f"sec_{i}"]["page_start"], index[f"sec_{i}"]["page_end"]) for i in range(3)] == [(1, 2), (2, 2), (3, 9)]
    assert index["sec_0"]["ldu_ids"] == ["ldu_0002", "ldu_0003", "ldu_0004"]  # the unit on page 3 is beyond the section's end
    assert index["sec_1"]["ldu_ids"] == ["ldu_0004"] and index["sec_2"]["data_types_present"] == ["paragraphs", "tables"]
    assert len(index["root"]["ldu_ids"]) == 8 and index["sec_1"]["level"] == 1
    empty = sections.build_index(units, counts).filter("document_id = 'd2'").collect()
    assert [(r["section_id"], r["page_end"], r["ldu_ids"]) for r in empty] == [("root", 4, [])]


def test_topics(spark):
    units = ldus(spark, [("heading", "1. Intro", 1), ("paragraph", "x", 1), ("heading", "2. Harbour dues", 2), ("table", "t", 2), ("heading", "3. Other", 3)])
    index = sections.build_index(units, spark.createDataFrame([("d1", 3)], "document_id string, page_count int"))
    topics = spark.createDataFrame([("t", "harbour dues"), ("u", "zzz"), ("v", "")], "topic_id string, topic string")
    found = sections.navigate(index, topics, 2).orderBy("topic_id", "rank").collect()
    assert [(r["topic_id"], r["section_id"], r["score"]) for r in found] == [("t", "sec_1", 16.0), ("t", "sec_0", 0.0), ("u", "sec_0", 0.0), ("u", "sec_1", 0.0), ("v", "sec_1", 12.0), ("v", "sec_0", 11.0)]


def table_unit(spark, header, rows_, text=""):
    payload = (header, rows_, None, None, "Table 1", None, None, None)
    return spark.createDataFrame([("d1", "ldu_0001", 1, "table", text, payload, [7], [BOX], None, 0, "hash", {})], schemas.LDUS)


def test_table_facts(spark):
    found = facts.table_facts(table_unit(spark, ["Metric", "Q1", ""], [["Revenue", "100", " 200 "], ["Cost", "", "75", "extra"]])).orderBy("at").collect()
    assert [(r["entity"], r["metric"], r["value"]) for r in found] == [("Revenue", "Metric", "Revenue"), ("Revenue", "Q1", "100"), ("Revenue", "col_2", "200"), ("Cost", "Metric", "Cost"), ("Cost", "col_2", "75")]
    assert {r["source_page"] for r in found} == {7} and found[0]["source_reference"]["content_hash"] == "hash"
    lines = facts.table_facts(table_unit(spark, [], [], "Name|Value\nA|1\n\nB\t2|3")).orderBy("at").collect()
    assert [(r["entity"], r["metric"], r["value"]) for r in lines] == [("A", "Name", "A"), ("A", "Value", "1"), ("B", "Name", "B"), ("B", "Value", "2")]
    assert facts.table_facts(table_unit(spark, [], [], "one line")).count() == 0


def test_text_facts_and_their_search(spark):
    units = ldus(spark, [("paragraph", "Net-income - 120M", 1), ("paragraph", "Reported Q3 2024 and FY 2024 and Q3 2024", 2), ("heading", "Label: no", 2), ("list", "Total: 5", 3)])
    found = facts.extract_facts(units)
    assert sorted((r["metric"], r["value"], r["period"]) for r in found.collect()) == [("Net", "income - 120M", None), ("Total", "5", None), ("period", "FY 2024", "FY 2024"), ("period", "Q3 2024", "Q3 2024")]
    asked = spark.createDataFrame([("a", "what NET zz"), ("b", "  "), ("c", "1 2 3 4 5 6 7 8 9 10 total")], "query_id string, query string")
    got = facts.search_facts(found, asked, limit=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["metric"]) for r in got] == [("a", "Net"), ("c", "Net"), ("c", "period")]
    assert facts.search_facts(found, asked, document_ids=[]).count() == 0 and facts.search_facts(found, asked, document_ids=["d1"]).count() > 0


def test_vectors_by_document_and_unit(spark):
    a, b = ldus(spark, [("paragraph", "Revenue for Q3 was high.", 1)], "a"), ldus(spark, [("paragraph", "Risk of loss.", 1)], "b")
    stored = retrieval.upserted(retrieval.embedded(a), retrieval.embedded(b))
    assert stored.count() == 2
    again = retrieval.upserted(stored, retrieval.embedded(a))
    assert again.count() == 2
    asked = retrieval.embedded_questions(spark.createDataFrame([("q", "Risk of loss.")], "query_id string, query string"))
    best = retrieval.nearest(stored, asked, 1).first()
    assert best["document_id"] == "b" and best["distance"] < 1e-20
    assert retrieval.nearest(stored, asked, 5, document_ids=["a"]).count() == 1 and retrieval.nearest(stored, asked, 5, document_ids=[]).count() == 2


def test_answers_and_audits(spark):
    units = ldus(spark, [("heading", "1. Results", 1), ("paragraph", "Revenue: 4.2B", 1)])
    index = sections.build_index(units, spark.createDataFrame([("d1", 1)], "document_id string, page_count int"))
    vectors, found = retrieval.embedded(units), facts.extract_facts(units)
    asked = spark.createDataFrame([("q1", "results revenue"), ("q2", "the report says it")], "query_id string, query string")
    names = spark.createDataFrame([("d1", "annual.pdf")], "document_id string, document_name string")
    got = {r["query_id"]: r for r in retrieval.answers(asked, index, vectors, found, names).collect()}
    assert got["q1"]["verified"] and got["q1"]["answer"].startswith(retrieval.FALLBACK) and "Document — Revenue: 4.2B" in got["q1"]["answer"]
    assert {i["document_name"] for i in got["q1"]["items"]} == {"annual.pdf"}
    hits = retrieval.nearest(vectors, retrieval.embedded_questions(asked), 10)
    cited = retrieval.evidence(asked, hits, facts.search_facts(found, asked), names)
    status = {r["query_id"]: (r["status"], r["response"]) for r in retrieval.audits(asked, cited).collect()}
    assert status["q1"][0] == "verified" and status["q1"][1].startswith(retrieval.VERIFIED)
    assert status["q2"] == ("unverifiable", retrieval.UNVERIFIABLE)


def test_chunk_errors(spark):
    def payload(header=None, rows_=None, complete=None, caption=None):
        return (header, rows_, None, caption, None, None, None, complete)

    cases = [
        ("a", "table", "x", payload(["A"], [])), ("a", "table", "y", payload(None, [["1"]])), ("b", "table", "100\t200\n300\t400", payload()), ("c", "figure", "", payload()),
        ("d", "caption", "Figure 1", payload()), ("e", "list", "x", payload(complete=False)), ("f", "list", "1. One.\n2. Two.\n3. Unfinished li", payload(complete=True)),
        ("g", "list", "1. First.\n2. Second.\n3. Third.", payload(complete=True)), ("h", "section_intro", "s", payload()), ("h", "paragraph", "orphan", payload()),
    ]
    made = [(d, f"ldu_{n}", n, kind, text, p, [1], [BOX], None, 1, "h", {}) for n, (d, kind, text, p) in enumerate(cases)]
    made += [("i", "ldu_99", 99, "paragraph", "t", payload(), [], [], None, 1, " ", {})]
    units = spark.createDataFrame(made, schemas.LDUS)
    got = sorted((r["document_id"], r["code"]) for r in validation.chunk_errors(units).collect())
    split, figure, item = "TABLE_HEADER_CELLS_SPLIT", "FIGURE_CAPTION_NOT_UNIFIED", "LIST_MID_ITEM_SPLIT"
    assert got == [("a", split), ("b", split), ("c", figure), ("d", figure), ("e", item), ("f", item), ("h", "PARENT_SECTION_MISSING"), ("i", "BOUNDING_BOXES_INVALID"), ("i", "CONTENT_HASH_MISSING"), ("i", "PAGE_REFS_EMPTY")]
    assert {r["document_id"] for r in validation.accepted(units).collect()} == {"g"}
    with pytest.raises(validation.ChunkValidationError):
        validation.accepted(units, strict=True)


def test_an_audit_cites_the_nearest_units_beside_facts(spark, small):
    import hashlib

    import numpy as np

    from quire import queries
    from quire.plans.oracle import CLAIMS

    def embedding(text):
        o = np.frombuffer(hashlib.sha256(text.encode()).digest(), np.uint8)
        v = np.tile((o ^ np.roll(o, -1)) / 255.0 - 0.5, 12)
        return v / np.linalg.norm(v)

    units = queries.ldus(spark, small)
    vectors = sorted(retrieval.embedded(units).select("document_id", "ldu_id", "content").collect())
    table = np.stack([embedding(r["content"]) for r in vectors])
    hits = retrieval.nearest(retrieval.embedded(units), retrieval.embedded_questions(queries.claims(spark)), 10)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["document_id"], r["ldu_id"]))
    for claim, text in CLAIMS:
        distance = ((table - embedding(text)) ** 2).sum(axis=1).round(12)
        assert got[claim] == [tuple(vectors[i][:2]) for i in np.argsort(distance, kind="stable")[:10]], claim
    found = {r["query_id"]: r["count"] for r in queries.fact_search(spark, small).groupBy("query_id").count().collect()}
    audit = {r["query_id"]: (r["n_items"], r["status"]) for r in queries.claim_audit(spark, small).collect()}
    # c2 has no word of substance, and c4 no fact
    assert audit == {c: (0, "unverifiable") if c == "c2" else (10 + found.get(c, 0), "verified") for c, _ in CLAIMS} and "c4" not in found


def test_every_one_of_many_questions_has_its_nearest_vectors(spark):
    vectors = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<double>")
    asked = spark.range(100_500).select(F.col("id").alias("query_id"), F.array((F.col("id") % 2).cast("double"), F.lit(0.25)).alias("query_vector"))
    found = retrieval.nearest(vectors, asked, 2, keys=("vec_id",))
    right = F.when(F.col("rank") == 1, F.col("query_id") % 2).otherwise(1 - F.col("query_id") % 2) == F.col("vec_id")
    assert found.agg(F.count(F.lit(1)), F.count_distinct("query_id"), F.count_if(right)).first()[:] == (201_000, 100_500, 201_000)


def test_every_one_of_many_questions_has_its_facts_and_sections(spark):
    units = ldus(spark, [("heading", "1. Results", 1), ("paragraph", "Revenue: 4.2B", 1)])
    asked = spark.range(10_500).select(F.col("id").alias("query_id"), F.lit("revenue").alias("query"))
    got = facts.search_facts(facts.extract_facts(units), asked)
    assert got.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()[:] == (10_500, 10_500)
    index = sections.build_index(units, spark.createDataFrame([("d1", 1)], "document_id string, page_count int"))
    found = sections.navigate(index, asked.select(F.col("query_id").alias("topic_id"), F.col("query").alias("topic")))
    assert found.agg(F.count(F.lit(1)), F.count_distinct("topic_id")).first()[:] == (10_500, 10_500)
