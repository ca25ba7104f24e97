import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry, text, vectors

TEXTS = [
    "", " ", "1. Intro", "1.2.3 Deep section", "2018 134.01", "RISK FACTORS", "Ünïcode CAPS", "ÄÖÜ 12", "1) Market", "(a) item", "- bullet", "• dot", "plain words here", "x" * 90,
    "A. NBSP item", "1. " + "long " * 30, "Net-income - 120M", "Revenue: 4.2B\nDate: Q3 2024", "Label A\nLabel B: value", "12: 5", "FY 2024 and q1 2023, FY 2024", "\tTabbed\tline ",
]


def column(spark, rows, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", make(F.col("t")).alias("v"))
    return [r["v"] for r in sorted(df.collect(), key=lambda r: r["i"])]


#: Worked out by hand: which of TEXTS are headings, which start with a list mark, and what labelled values they hold.
HEADINGS = {2, 3, 4, 5, 7}
LISTED = {2, 8, 9, 10, 11, 14, 15}
VALUES = {16: [("Net", "income - 120M")], 17: [("Revenue", "4.2B"), ("Date", "Q3 2024")], 18: [("Label A\nLabel B", "value")]}
PLAIN = {
    "canonical": (text.canonical_text, lambda t: re.sub(r"\s+", " ", t.strip())),
    "tokens": (text.token_count, lambda t: len(t.split())),
    "hash": (lambda c: text.content_hash(F.lit("paragraph"), c), lambda t: hashlib.sha256(f"paragraph|{re.sub(chr(92) + 's+', ' ', t.strip())}".encode()).hexdigest()[:16]),
    "json": (text.json_string, lambda t: json.dumps(t, ensure_ascii=False)),
    "ascii": (lambda c: text.json_ascii(text.json_string(F.concat(c, F.lit("é😀")))), lambda t: json.dumps(t + "é😀")),
}


@pytest.mark.parametrize("name", PLAIN)
def test_text_functions_are_those_of_plain_python(spark, name):
    make, plain = PLAIN[name]
    assert column(spark, TEXTS, make) == [plain(t) for t in TEXTS]


def test_line_tests(spark):
    assert [i for i, v in enumerate(column(spark, TEXTS, text.looks_like_heading)) if v] == sorted(HEADINGS)
    assert [i for i, v in enumerate(column(spark, TEXTS, text.is_list_item)) if v] == sorted(LISTED)
    assert {i: [tuple(x) for x in v] for i, v in enumerate(column(spark, TEXTS, text.key_values)) if v} == VALUES
    long = ["1. " + "x" * 77, "1. " + "x" * 78, "A" * 60, "A" * 61, "A" * 51 + ": v", "A" * 50 + ": v", "B: " + "v" * 201, "ab"]
    assert column(spark, long, text.looks_like_heading) == [True, False, True, False, False, False, False, False]
    assert [len(v) for v in column(spark, long, text.key_values)] == [0, 0, 0, 0, 0, 1, 0, 0]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from(list("aB1.-): \n\t•(xÄ")), max_size=20), min_size=20, max_size=40))
def test_line_tests_on_random_texts(spark, rows):
    for name in ("canonical", "tokens", "ascii"):
        make, plain = PLAIN[name]
        got = column(spark, rows, make)
        assert got == [plain(t) for t in rows]


def test_hash_ignores_layout_and_keeps_types_apart(spark):
    a, b = column(spark, ["  Hello   world\n\n  again  ", "Hello world again"], lambda c: text.content_hash(F.lit("heading"), c))
    (c,) = column(spark, ["Hello world again"], lambda c: text.content_hash(F.lit("paragraph"), c))
    assert a == b != c and re.fullmatch("[0-9a-f]{16}", a)


def test_levels_periods_terms(spark):
    assert column(spark, ["1. a", "1.2 b", "1.2.3. c", "none", ""], text.heading_level) == [1, 2, 3, 1, 1]
    assert column(spark, ["FY 2024, Q3 2024 and FY 2024, fy2023"], text.periods) == [["FY 2024", "Q3 2024", "fy2023"]]
    assert column(spark, ["The report says it should not be verified", "Revenue was 4 B"], text.substantive_terms) == [[], ["revenue"]]
    assert column(spark, ["Risk-factors a of Q3"], text.topic_tokens) == [["risk", "factors", "of", "q3"]]
    assert column(spark, [" ".join("abcdefghijklm")], text.query_terms) == [list("abcdefghij")]
    assert column(spark, ['```json\n{"a": 1}\n```', ' {"a": 1} '], text.without_code_fence) == ['{"a": 1}', '{"a": 1}']
    assert column(spark, [" EN ", "x", "english1"], text.language_code) == ["en", None, None]


def test_boxes(spark):
    df = spark.range(1).select(
        geometry.flipped(*[F.lit(float(v)) for v in (5, 10, 50, 20, 100)]).alias("f"), geometry.from_top_left(*[F.lit(float(v)) for v in (9, 30, 4, 30)]).alias("t"),
        geometry.union(geometry.bbox(*[F.lit(v) for v in (0, 0, 2, 2)]), geometry.bbox(*[F.lit(v) for v in (1, -1, 5, 1)])).alias("u"),
        geometry.is_valid(geometry.bbox(*[F.lit(v) for v in (0, 0, 0, 1)])).alias("v"), geometry.column_bucket(F.lit(500.0), F.lit(100.0)).alias("c"),
    )
    r = df.first()
    assert tuple(r["f"]) == (5, 80, 50, 90) and tuple(r["t"]) == (4, 812, 9, 813) and tuple(r["u"]) == (0, -1, 5, 2) and r["v"] is False and r["c"] == 4


def test_deterministic_embedding(spark):
    def plain(t):
        h = hashlib.sha256((t or " ").encode()).digest()
        v = [(h[i % 32] ^ h[(i + 1) % 32]) / 255.0 - 0.5 for i in range(384)]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]

    for t, got in zip(["", "abc", "Überblick"], column(spark, ["", "abc", "Überblick"], vectors.deterministic_embedding), strict=True):
        assert max(abs(a - b) for a, b in zip(got, plain(t), strict=True)) < 1e-15
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vectors.similarity(df["a"], df["b"]).alias("s"), vectors.squared_distance(df["a"], df["b"]).alias("d")).collect()
    assert [round(r["s"], 9) if r["s"] is not None else None for r in rows][:2] == [0.5, 1.0] and [r["d"] for r in rows] == [5.0, 2.0, 2.0]
