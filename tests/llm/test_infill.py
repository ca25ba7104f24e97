import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import infill
from tests.llm.cases import documents, empty, odd_documents, prose, row

UNITS = {"char": r"(?s).", "word": r"\s*\S+|\s+", "line": r"[^\n]*\n|[^\n]+"}


def plain_version(doc_id, text, unit="char", seed=1, plain=10, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = [m[0] for m in re.finditer(UNITS[unit], text, re.ASCII)]
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return (n, "plain", None, None, text)
    if h[3] % 100 < spm:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def rows():
    marks = ["<", "<P", "<S", "<M", "P>", ">", "<<", "a<P b", "< P>", "x<S>y", "<M>", "<P>", "M><"]
    many = [row(1000 + i, prose(i, 40 + 37 * i)) for i in range(40)]
    exact = [row(2000 + i, "é" * (infill.RUN * i + j)) for i in range(3) for j in (-1, 0, 1) if infill.RUN * i + j >= 0]
    return odd_documents() + many + exact + [row(3000 + 7 * i + k, m * (k + 1)) for i, m in enumerate(marks) for k in range(7)] + [row(99, "a \r\n\x85 b\n\n")] * 50


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_equals_the_plain_version_and_comes_back(spark, unit):
    docs = rows()
    made = infill.infilled(documents(spark, docs), unit).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    found = made.collect()
    assert all(r["back"] == r["text"] for r in found)
    got = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=str)
    assert got == sorted(((r[0], r[1] or "", *plain_version(r[0], r[1], unit)) for r in docs), key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


def test_shares_and_seed(spark):
    docs = documents(spark, [row(i, "some text of a document") for i in range(3000)])
    forms = {r["form"]: r["count"] for r in infill.infilled(docs, seed=7, plain=50, suffix_first=50).groupBy("form").count().collect()}
    assert 1350 < forms["plain"] < 1650 and 600 < forms["psm"] < 900 and 600 < forms["spm"] < 900
    assert infill.infilled(docs).select("prefix_chars").exceptAll(infill.infilled(docs, seed=2).select("prefix_chars")).count() > 0


def test_empty_table_and_columns(spark):
    found = infill.digests(empty(spark))
    assert found.collect() == []
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def test_a_text_is_a_few_rows(spark):
    """The relation of units has a row for each run, and repeated rows are merged in it."""
    docs = documents(spark, [row(1, "x" * 1_000_000)] + [row(2, "y" * 600)] * 500)
    runs = infill.placed_runs(docs, "char")
    assert runs.count() == -(-1_000_000 // infill.RUN) + 2
    assert {(r["doc_id"], r["n"]) for r in runs.select("doc_id", "n").distinct().collect()} == {(1, 1_000_000), (2, 600)}
