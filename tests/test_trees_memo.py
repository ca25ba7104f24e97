import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import extraction, memo, retrieval, trees
from quire.plans.schemas import ATTEMPTS


def nested(depth, name="s"):
    return {"id": f"{name}", "document_id": "d", "page_start": 1, "page_end": 2, "child_sections": [nested(depth - 1, f"{name}.{i}") for i in range(2)] if depth else []}


def walk(node, parent=None):
    yield node["id"], parent
    for child in node.get("child_sections") or []:
        yield from walk(child, node["id"])


def test_nested_trees_come_out_in_order(spark):
    docs = {f"d{i}": nested(i) for i in range(5)} | {"bare": {"id": "root", "title": "T", "ldu_ids": ["a", "b"], "summary": "s", "level": 3}}
    rows = [(json.dumps({"document_id": d, "page_count": 1, "root": root}),) for d, root in docs.items()] + [("no json",), (None,), ("{}",), ('{"document_id": "x", "root": null}',)]
    found = trees.sections(spark.createDataFrame(rows, "tree string")).orderBy("document_id", "n").collect()
    got = {d: [(r["section_id"], r["parent_id"]) for r in found if r["document_id"] == d] for d in docs}
    assert got == {d: list(walk(root)) for d, root in docs.items()} and len(found) == sum(map(len, got.values()))
    assert [r["n"] for r in found if r["document_id"] == "d3"] == list(range(-1, 14))
    bare = next(r for r in found if r["document_id"] == "bare")
    assert (bare["title"], bare["level"], bare["ldu_ids"], bare["summary"], bare["key_entities"], bare["owner"]) == ("T", 3, ["a", "b"], "s", [], None)
    assert trees.sections(spark.createDataFrame([], "tree string")).count() == 0


def test_rules_of_trees(spark):
    rnd, rows = random.Random(1), []
    for t in range(6):
        names = [f"s{i}" for i in range(40)]
        rows += [(f"t{t}", "root", None, f"t{t}")] * (t != 4)
        rows += [(f"t{t}", n, rnd.choice(["root", "gone", *names]), rnd.choice([f"t{t}"] * 8 + ["other", None])) for n in names]
    rows += [("deep", f"s{i}", f"s{i - 1}" if i else None, "deep" if i != 700 else "x") for i in range(900)]
    parent = {(t, s): p for t, s, p, _ in rows}

    def plain(t, s, owner):
        seen, at = set(), s
        while True:
            if (t, at) not in parent:
                return "orphan"
            if at in seen:
                return "cycle"
            if parent[t, at] is None:
                return "foreign" if owner != t else None
            seen.add(at)
            at = parent[t, at]

    got = {(r["tree_id"], r["section_id"]): r["rule"] for r in trees.tree_errors(spark.createDataFrame(rows, "tree_id string, section_id string, parent_id string, owner string")).collect()}
    assert got == {(t, s): rule for t, s, _, o in rows if (rule := plain(t, s, o))}
    assert set(got.values()) == {"orphan", "cycle", "foreign"}
    assert trees.tree_errors(spark.createDataFrame([], "tree_id string, section_id string, parent_id string, owner string")).count() == 0


def counting(folder, fails=()):
    """A model that leaves a file for each content that it is asked."""

    def load():
        import pathlib
        import uuid

        def say(rows):
            if any(r["content"] in fails for r in rows):
                if len(rows) == 1:
                    pathlib.Path(folder, f"{rows[0]['content']}-{uuid.uuid4().hex}").touch()
                raise ValueError("cannot say")
            for r in rows:
                pathlib.Path(folder, f"{r['content']}-{uuid.uuid4().hex}").touch()
            return [r["content"].upper() for r in rows]

        return say

    return load


def test_each_content_is_asked_once(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "memo")
    calls.mkdir()
    asked = lambda: sorted(p.name.split("-")[0] for p in calls.iterdir())
    rows = lambda *contents: spark.createDataFrame([("d", f"s{i}", "t", c) for i, c in enumerate(contents)], "document_id string, section_id string, title string, content string")
    first = memo.summarizer(path, counting(str(calls), ("bad",)))(rows("a", "b", "a", "bad", "bad"))
    assert sorted(tuple(r) for r in first.collect()) == [("d", "s0", "A"), ("d", "s1", "B"), ("d", "s2", "A"), ("d", "s3", None), ("d", "s4", None)]
    assert asked() == ["a", "b", "bad"]
    reasons = spark.read.parquet(f"{path}/rows").filter("reason is not null").collect()
    assert [r["reason"] for r in reasons] == ["ValueError: cannot say"]
    # only what is new and what failed is asked, and then it goes well
    again = memo.summarizer(path, counting(str(calls)))(rows("a", "c", "bad"))
    assert sorted(tuple(r) for r in again.collect()) == [("d", "s0", "A"), ("d", "s1", "C"), ("d", "s2", "BAD")]
    assert asked() == ["a", "b", "bad", "bad", "c"]
    assert memo.summarizer(path, counting(str(calls)))(rows()).count() == 0


def test_texts_are_embedded_once_for_all_citations(spark, tmp_path):
    path = str(tmp_path / "vectors")
    load = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    claims = spark.createDataFrame([("q1", "revenue growth"), ("q2", "revenue growth"), ("q3", "the is")], "query_id string, query string")
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    hit = f"query_id string, rank int, document_id string, ldu_id string, content string, content_hash string, page_number int, bbox {box}"
    texts = ["fourteen chars", "x", "fourteen chars", " "]
    hits = spark.createDataFrame([(q, i + 1, "d", f"u{i}", t, f"h{i}", 1, (0.0, 0.0, 1.0, 1.0)) for q in ("q1", "q2") for i, t in enumerate(texts)], hit)
    found = spark.createDataFrame([], "query_id string, rank int, document_id string, entity string, metric string, value string, source_reference struct<bbox:array<double>,content_hash:string,document_id:string,ldu_id:string,page:int>")
    cited = retrieval.evidence(claims, hits, found, least=0.9, vectors_of=lambda t: memo.embeddings(t, path, load)).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["place"], r["ldu_id"]) for r in cited] == [("q1", 1, "u0"), ("q1", 2, "u2"), ("q2", 1, "u0"), ("q2", 2, "u2")]
    assert spark.read.parquet(f"{path}/rows").count() == 3
    plain = retrieval.evidence(claims, hits, found, least=0.9, embed=lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))).orderBy("query_id", "place").collect()
    assert [tuple(r) for r in plain] == [tuple(r[c] for c in plain[0].__fields__) for r in cited]


@pytest.mark.parametrize("at_once,limit,ran", [(10, 1.0, 10), (1, 1.0, 4), (3, 1.0, 6), (10, 0.0, 0), (4, 100.0, 30)])
def test_what_is_spent_refuses_those_that_wait(spark, at_once, limit, ran):
    """Vision runs cost 0.25 each; once the limit is reached no other is run, and those that wait are refused."""
    profiles = spark.createDataFrame([(f"d{i:02d}", "scanned_image", "single_column", "needs_vision_model") for i in range(30)], "document_id string, origin string, layout string, estimated_cost string")
    seen = []

    def vision(ids):
        seen.extend(r["document_id"] for r in ids.collect())
        return ids.select("document_id", F.lit(True).alias("has_document"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("notes"), F.lit(5).cast("long").alias("token_usage_prompt"), F.lit(0.25).alias("cost_estimate_usd"))

    budget = extraction.Budget(limit, at_once=at_once)
    out = extraction.routed(profiles, {"vision": vision}, budget=budget).collect()
    assert sorted(seen) == [f"d{i:02d}" for i in range(ran)] and budget.spent_usd == 0.25 * ran
    assert sorted(r["document_id"] for r in out if r["notes"] == "budget_exceeded") == [f"d{i:02d}" for i in range(ran, 30)]
    assert {r["strategy_used"] for r in out if r["document_id"] < f"d{ran:02d}"} <= {"vision"}
    assert ATTEMPTS.startswith("document_id")
