import pytest
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import extraction, triage, validation
from quire.plans import config, schemas
from quire.plans.config import LayoutRules, OriginRules, Rules


def signals(spark, cases):
    """cases: document → list of (chars, image, table, regions, columns)."""
    rows = [(d, n, *p) for d, pages in cases.items() for n, p in enumerate(pages, 1)]
    return spark.createDataFrame([(d, n, c, float(i), float(t), r, k) for d, n, c, i, t, r, k in rows], schemas.PAGE_SIGNALS)


def test_origins(spark):
    pages = lambda chars, image=(0,) * 9: [(c, i, 0, 0, 1) for c, i in zip(chars, image, strict=False)]
    found = triage.origins(
        signals(spark, {"zero": pages([0, 0, 0]), "digital": pages([500, 600, 400], [0.05, 0.1, 0]), "mixed": pages([500, 0, 0, 600, 0]), "images": pages([500, 500], [0.9, 0.8]), "few": pages([500] + [0] * 8 + [0] * 2, [0] * 11)})
    )
    got = {r["document_id"]: (r["origin"], r["origin_confidence"], r["origin_reason"]) for r in found.collect()}
    assert got["zero"] == ("scanned_image", 0.9, "all_pages_below_min_chars")
    assert got["digital"] == ("native_digital", 0.95, "all_digital_low_image")
    assert got["mixed"] == ("mixed", 0.85, "fraction_pages_digital_in_range")
    assert got["images"] == ("native_digital", 0.75, "all_digital_high_image")
    low = signals(spark, {"d": pages([40, 40])})
    assert triage.origins(low).first()["origin"] == "scanned_image"
    assert triage.origins(low, Rules(origin=OriginRules(min_chars_per_page=30))).first()["origin"] == "native_digital"
    none = spark.range(1).select(rules.origin_rule(F.lit(0), F.lit(0), F.lit(None).cast("double"), OriginRules()).alias("o")).first()["o"]
    assert tuple(none) == ("scanned_image", 0.0, "zero_pages")


def test_layouts(spark):
    cases = {
        "single": [(9, 0.05, 0.05, 0, 1), (9, 0.1, 0.02, 0, 1)], "multi": [(9, 0.1, 0.05, 0, 2)], "area": [(9, 0.1, 0.35, 1, 1), (9, 0.1, 0.3, 2, 1)],
        "count": [(9, 0.1, 0.1, 3, 1)], "figure": [(9, 0.5, 0.05, 0, 1)], "both": [(9, 0.5, 0.35, 2, 1)],
    }
    got = {r["document_id"]: (r["layout"], r["layout_confidence"]) for r in triage.layouts(signals(spark, cases)).collect()}
    assert got == {"single": ("single_column", 0.95), "multi": ("multi_column", 0.85), "area": ("table_heavy", 0.9), "count": ("table_heavy", 0.9), "figure": ("figure_heavy", 0.9), "both": ("mixed", 0.85)}
    strict = triage.layouts(signals(spark, {"d": [(9, 0, 0.3, 0, 1), (9, 0, 0.3, 0, 1)]}), Rules(layout=LayoutRules(table_area_ratio=0.35)))
    assert strict.first()["layout"] == "single_column"


def test_domains(spark):
    texts = [("f", "Our fiscal office closed the balance sheet once all revenue was booked."), ("l", "WHEREAS the plaintiff and the court"), ("g", "nothing here"), ("e", ""), ("n", None)]
    got = {r["document_id"]: r for r in triage.domains(spark.createDataFrame(texts, "document_id string, text string")).collect()}
    assert got["f"]["domain"] == "financial" and {"revenue", "balance sheet", "fiscal"} <= set(got["f"]["matched"])
    assert got["f"]["domain_confidence"] == pytest.approx(0.3 + 0.5 * 0.75)
    assert got["l"]["domain"] == "legal" and [got[k]["domain"] for k in "gen"] == ["general"] * 3


def test_costs_and_profiles(spark):
    pairs = [("scanned_image", "single_column"), ("scanned_image", "table_heavy"), ("native_digital", "table_heavy"), ("native_digital", "single_column"), ("mixed", "single_column")]
    df = spark.createDataFrame(pairs, "origin string, layout string")
    assert [r["c"] for r in df.select(rules.estimated_cost(F.col("origin"), F.col("layout")).alias("c")).collect()] == [rules.COSTS[i] for i in (2, 2, 1, 0, 1)]
    made = triage.profiles(signals(spark, {"d": [(500, 0, 0, 0, 1)]}), spark.createDataFrame([("d", "court clause agreement whereas")], "document_id string, text string"))
    r = made.first()
    assert (r["origin"], r["layout"], r["domain"], r["estimated_cost"]) == ("native_digital", "single_column", "legal", "fast_text_sufficient") and r["confidence"] == pytest.approx(0.8)
    assert validation.profile_errors(made).count() == 0
    assert [r["rule"] for r in validation.profile_errors(made.withColumn("origin", F.lit("scanned_image"))).orderBy("rule").collect()] == ["fast_needs_plain_native", "scanned_needs_vision"]


def test_fast_text_scores(spark):
    rows = [("good", 1, 600, 72.0, 72.0, 1000.0, 0.0, True), ("bad", 1, 10, 72.0, 72.0, 100.0, 0.7 * 72 * 72, False)]
    df = spark.createDataFrame(rows, "document_id string, page int, char_count int, width double, height double, text_area double, image_area double, has_font boolean")
    got = {r["document_id"]: r for r in triage.fast_text_scores(df).collect()}
    assert got["good"]["score"] >= 0.5 and not got["good"]["missing_text"]
    assert got["bad"]["score"] < 0.5 and got["bad"]["missing_text"] and got["bad"]["low_pages"] == 1 and got["bad"]["image_area_ratio"] == pytest.approx(0.7)


def test_cascade(spark):
    """Chains as a router walks them: what is refused is part of the chain, and the last attempt's confidence counts."""
    plain, scan = ("native_digital", "single_column", "fast_text_sufficient"), ("scanned_image", "mixed", "needs_vision_model")
    cases = {
        # profile, attempts by strategy (document, confidence, notes), refused; then strategy, confidence, chain, notes
        "first": (plain, [("fast_text", True, 0.5, "clean")], False, ("fast_text", 0.5, ["fast_text"], "clean")),
        "second": (plain, [("fast_text", True, 0.3, "n1"), ("layout", True, 0.85, None)], False, ("layout", 0.85, ["fast_text", "layout"], "confidence_below_threshold")),
        "fail": (plain, [("fast_text", False, 0.0, "error: x"), ("layout", False, 0.0, None), ("vision", False, 0.1, "no pages")], False, ("escalation_failed", 0.1, ["fast_text", "layout", "vision"], "error: x; no pages")),
        "barred": (plain, [("fast_text", True, 0.3, "n1"), ("layout", False, 0.2, ""), ("vision", True, 0.9, "v")], True, ("escalation_failed", 0.2, ["fast_text", "layout", "vision"], "confidence_below_threshold; budget_exceeded")),
        "scan": (scan, [("vision", True, 0.9, ""), ("layout", True, 0.9, "")], True, ("escalation_failed", 0.0, ["vision"], "budget_exceeded")),
        "quiet": (scan, [("vision", False, 0.0, ""), ("layout", True, 0.6, "")], False, ("layout", 0.6, ["vision", "layout"], None)),
    }
    profiles = spark.createDataFrame([(d, *c[0]) for d, c in cases.items()], "document_id string, origin string, layout string, estimated_cost string")
    attempts = spark.createDataFrame([(d, *a) for d, c in cases.items() for a in c[1]], "document_id string, strategy string, has_document boolean, confidence double, notes string")
    refused = spark.createDataFrame([(d,) for d, c in cases.items() if c[2]], "document_id string")
    got = {r["document_id"]: (r["strategy_used"], r["confidence"], r["escalation_chain"], r["notes"]) for r in triage.cascade(profiles, attempts, refused=refused).collect()}
    assert got == {d: c[3] for d, c in cases.items()}
    # run step by step, each strategy sees only what has come to it
    seen = {}

    def extractor(name):
        def run(ids):
            seen.setdefault(name, []).extend(r[0] for r in ids.collect())
            return ids.join(attempts.filter(F.col("strategy") == name).drop("strategy"), "document_id")

        return run

    ran = extraction.routed(profiles, {name: extractor(name) for name in rules.STRATEGIES}, refused=refused)
    assert {r["document_id"]: (r["strategy_used"], r["confidence"], r["escalation_chain"], r["notes"]) for r in ran.collect()} == got
    assert {k: sorted(v) for k, v in seen.items()} == {"fast_text": ["barred", "fail", "first", "second"], "layout": ["barred", "fail", "quiet", "second"], "vision": ["fail", "quiet"]}


def test_usage_of_the_last_attempt(spark):
    profiles = spark.createDataFrame([(d, "scanned_image", "mixed", "needs_vision_model") for d in "ab"], "document_id string, origin string, layout string, estimated_cost string")
    attempts = spark.createDataFrame([("a", "vision", True, 0.9, "", 0.5, 100, 7), ("b", "vision", True, 0.9, "", 0.5, 100, 7)], "document_id string, strategy string, has_document boolean, confidence double, notes string, cost_estimate_usd double, token_usage_prompt long, token_usage_completion long")
    out = triage.cascade(profiles, attempts, refused=spark.createDataFrame([("b",)], "document_id string"))
    assert [tuple(r) for r in out.orderBy("document_id").select("cost_estimate_usd", "token_usage_prompt").collect()] == [(0.5, 100), (0.0, None)]
    used = extraction.usage(out)
    assert [tuple(r) for r in used.collect()] == [("a", 100, 7, 0.5)]
    assert extraction.over_budget(used, 0.5).collect()[0][0] == "a" and extraction.over_budget(used, 0.6).count() == 0


def test_pages_that_a_model_sees_and_answers(spark):
    pages = spark.createDataFrame([("a", n, bytes([n])) for n in range(1, 61)] + [("b", 1, b"x")], "document_id string, page int, image binary")
    shown = extraction.vision_pages(pages)
    assert shown.count() == 51

    def call(document_id, images):
        if document_id == "b":
            raise ValueError
        return f"{len(images)} {images[0][0]} {images[-1][0]}"

    assert sorted(tuple(r) for r in extraction.answered(shown, call).collect()) == [("a", "50 1 50"), ("b", None)]


def test_lines_of_words_measure_from_the_first_word(spark):
    words = [("d", 1, float(x), float(top), x + 5.0, top + 8.0, t) for x, top, t in [(0, 10, "a"), (10, 14, "b"), (20, 15.5, "c"), (0, 30, "d")]]
    df = spark.createDataFrame(words, "document_id string, page int, x0 double, top double, x1 double, bottom double, text string")
    assert [(r["text"], r["top"], r["bottom"]) for r in triage.lines_of_words(df).orderBy("line").collect()] == [("a b", 10.0, 22.0), ("c", 15.5, 23.5), ("d", 30.0, 38.0)]


def test_page_signals(spark):
    pages = spark.createDataFrame([("d", 1, 100.0, 100.0), ("d", 2, 100.0, 100.0)], "document_id string, page int, width double, height double")
    chars = spark.createDataFrame([("d", 1, x) for x in (0.0, 19.0, 21.0, 250.0)], "document_id string, page int, x0 double")
    images = spark.createDataFrame([("d", 1, 100.0, 80.0), ("d", 1, 100.0, 80.0)], "document_id string, page int, width double, height double")
    tables = spark.createDataFrame([("d", 1, 0.0, 0.0, 50.0, 50.0)], "document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(r) for r in triage.page_signals(pages, chars, images, tables).orderBy("page").collect()]
    assert got == [("d", 1, 4, 1.0, 0.25, 1, 3), ("d", 2, 0, 0.0, 0.0, 0, 1)]


def test_rules_of_a_file(tmp_path):
    assert config.load_rules(tmp_path / "none.yaml") == Rules()
    made = config.rules_from({"origin_type": {"min_chars_per_page_digital": 30}, "domain_hint": {"keywords": {"x": ["A b"]}}, "layout_complexity": None})
    assert made.origin.min_chars_per_page == 30 and made.domain.keywords == {"x": ("a b",)} and made.layout == LayoutRules()


def test_ledger_and_other_constraints(spark):
    ledger = "document_id string, strategy_used string, start_time timestamp, end_time timestamp, escalation_chain array<string>"
    rows = [("a", "layout", "2024-01-01", "2024-01-02", ["fast_text", "layout"]), ("b", "layout", "2024-01-02", "2024-01-01", ["layout", "vision"]), ("c", "escalation_failed", "2024-01-01", "2024-01-01", []), ("d", "magic", "2024-01-01", "2024-01-01", ["magic"])]
    df = spark.createDataFrame(rows, ledger.replace("timestamp", "string")).withColumn("start_time", F.to_timestamp("start_time")).withColumn("end_time", F.to_timestamp("end_time"))
    assert sorted((r["document_id"], r["rule"]) for r in validation.ledger_errors(df).collect()) == [("b", "chain_tail"), ("b", "time_order"), ("d", "strategy")]
    cells = spark.createDataFrame([("d", "t", "body", 0, 1), ("d", "t", "body", 0, 1), ("d", "t", "body", 1, 2), ("d", "u", "header", 0, 1), ("d", "u", "body", 0, 2)], "document_id string, table_id string, section string, row_index int, colspan int")
    assert [r["table_id"] for r in validation.ragged_tables(cells).collect()] == ["u"]
