"""Constraints: violations are rows, and a document with one is set aside, not the whole batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import is_valid
from quire.functions.rules import COSTS, STRATEGIES
from quire.functions.text import language_code, strip
from quire.operators.sections import HEADING_TYPES

TABLE_TYPES = ("table", "table_section")


def blank(text: Column) -> Column:
    return strip(text) == ""


def ends_mid_item(text: Column) -> Column:
    """Whether a list's last line looks like a numbered item that was cut off."""
    last = strip(F.element_at(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+$", ""), "\n"), -1))
    rest = strip(F.regexp_replace(last, r"(?s)^[^.]*\.", ""))
    numbered = F.rlike(last, F.lit(r"(?U)^\d")) & F.contains(F.substring(last, 1, 4), F.lit("."))
    return numbered & ((F.length(rest) < 2) | ~F.rlike(rest, F.lit(r"[.!?]$")))


def chunk_errors(ldus: DataFrame, need_parent: bool = True) -> DataFrame:
    """document_id, code, seq and ldu_ids: one row for each violation of the rules for units.

    All rules look at one pass over the units, which one partitioning by document serves; each row then gives as many
    errors as it has.
    """
    by = Window.partitionBy("document_id").orderBy("seq")
    rp, rows = F.col("raw_payload"), F.col("raw_payload.rows")
    no_rows, no_header = F.coalesce(F.size(rows), F.lit(0)) <= 0, F.coalesce(F.size(rp["header"]), F.lit(0)) <= 0
    is_table = F.col("content_type").isin(*TABLE_TYPES)
    units = ldus.withColumn("header_only", is_table & rp["header"].isNotNull() & no_rows).withColumn("body_only", is_table & ~no_rows & no_header)
    units = units.withColumn("next_id", F.lead("ldu_id").over(by)).withColumn("next_body", F.coalesce(F.lead("body_only").over(by), F.lit(False)))
    is_heading = F.col("content_type").isin(*HEADING_TYPES)
    seen = F.coalesce(F.max(is_heading.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    units = units.withColumn("seen", seen)
    first_line = strip(F.get(F.split(strip(F.col("text")), "\n"), F.lit(0)))
    figure_bare = (F.col("content_type") == "figure") & blank(F.col("text")) & (F.coalesce(rp["caption"], F.lit("")) == "")
    is_list = F.col("content_type") == "list"
    own, pair = F.array("ldu_id"), F.array("ldu_id", "next_id")
    checks = [
        ("PAGE_REFS_EMPTY", F.coalesce(F.size("page_refs"), F.lit(0)) <= 0, own),
        ("BOUNDING_BOXES_INVALID", F.coalesce(F.size("bounding_boxes"), F.lit(0)) <= 0, own),
        ("CONTENT_HASH_MISSING", blank(F.col("content_hash")), own),
        ("TABLE_HEADER_CELLS_SPLIT", F.col("header_only") & F.col("next_body"), pair),
        ("TABLE_HEADER_CELLS_SPLIT", is_table & (first_line != "") & ~F.rlike(first_line, F.lit(r"\p{L}")), own),
        ("FIGURE_CAPTION_NOT_UNIFIED", (F.col("content_type") == "caption") | figure_bare, own),
        ("LIST_MID_ITEM_SPLIT", is_list & ~F.coalesce(rp["list_complete"], F.lit(True)), own),
        ("LIST_MID_ITEM_SPLIT", is_list & ends_mid_item(F.col("text")), own),
    ]
    if need_parent:
        checks.append(("PARENT_SECTION_MISSING", F.col("seen") & ~is_heading & (F.coalesce("parent_section_id", F.lit("")) == ""), own))
    none = F.lit(None).cast("struct<code:string,ldu_ids:array<string>>")
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), ids.alias("ldu_ids"))).otherwise(none) for code, c, ids in checks])
    errors = units.select("document_id", "seq", F.explode(F.filter(found, lambda e: e.isNotNull())).alias("e"))
    return errors.select("document_id", "e.code", "seq", "e.ldu_ids")


class ChunkValidationError(ValueError):
    """Raised in strict mode when any document breaks a rule."""


def accepted(ldus: DataFrame, need_parent: bool = True, strict: bool = False) -> DataFrame:
    """The units of documents without an error; in strict mode any error raises."""
    errors = chunk_errors(ldus, need_parent)
    if strict and (some := errors.limit(5).collect()):
        raise ChunkValidationError("; ".join(f"{r['document_id']}: {r['code']} {r['ldu_ids']}" for r in some))
    return ldus.join(errors.select("document_id").distinct(), "document_id", "left_anti")


def violations(df: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """The key columns and `rule` for each row and rule that fails; a check that is null fails too."""
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in checks.items()])
    return df.select(*key, F.explode(F.filter(found, lambda r: r.isNotNull())).alias("rule"))


def profile_errors(profiles: DataFrame) -> DataFrame:
    """Where a profile's cost contradicts its origin and layout."""
    origin, layout, cost = F.col("origin"), F.col("layout"), F.col("estimated_cost")
    return violations(
        profiles, ["document_id"],
        {
            "scanned_needs_vision": (origin != "scanned_image") | (cost == COSTS[2]),
            "complex_layout_not_fast": ~layout.isin("table_heavy", "multi_column", "mixed", "figure_heavy") | (cost != COSTS[0]),
            "fast_needs_plain_native": (cost != COSTS[0]) | ((origin == "native_digital") & (layout == "single_column")),
            "page_count": F.col("page_count") >= 1,
        },
    )


def dangling_references(reading_order: DataFrame, blocks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Entries of the reading order that name nothing."""
    known = reduce(DataFrame.union, [d.select("document_id", F.col("id").alias("ref_id")) for d in (blocks, tables, figures)])
    return reading_order.join(known, ["document_id", "ref_id"], "left_anti")


def page_range_errors(elements: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Elements on a page that their document doesn't have."""
    return elements.join(page_counts.select("document_id", "page_count"), "document_id").filter(~F.col("page_number").between(F.lit(1), F.col("page_count")))


def ragged_tables(cells: DataFrame) -> DataFrame:
    """Tables whose rows, header rows included, don't span the same number of columns; cells has a colspan each."""
    per_row = cells.groupBy("document_id", "table_id", "section", "row_index").agg(F.sum("colspan").alias("columns"))
    return per_row.groupBy("document_id", "table_id").agg(F.count_distinct("columns").alias("widths")).filter("widths > 1")


def page_errors(rows: DataFrame) -> DataFrame:
    """Rows of (document_id, page_number) that name no document or a page before the first."""
    return violations(rows, ["document_id", "page_number"], {"document_id": F.coalesce("document_id", F.lit("")) != "", "page_number": F.col("page_number") >= 1})


def span_errors(spans: DataFrame) -> DataFrame:
    """Rows of (document_id, page_start, page_end) that aren't ranges of pages."""
    return violations(
        spans, ["document_id", "page_start", "page_end"],
        {"document_id": F.coalesce("document_id", F.lit("")) != "", "page_start": F.col("page_start") >= 1, "page_end": F.col("page_end") >= F.greatest("page_start", F.lit(1))},
    )


def language_errors(rows: DataFrame) -> DataFrame:
    """Rows of (document_id, language) whose language is no code of two to five ASCII letters."""
    return violations(rows, ["document_id", "language"], {"language": language_code(F.col("language")).isNotNull()})


def box_errors(elements: DataFrame) -> DataFrame:
    return elements.filter(~is_valid(F.col("bbox")))


def ledger_errors(ledger: DataFrame) -> DataFrame:
    """Entries with an unknown strategy, an end before the start, or a chain that doesn't end with the strategy used."""
    used = F.col("strategy_used")
    return violations(
        ledger, ["document_id"],
        {
            "strategy": used.isin(*STRATEGIES, "escalation_failed"),
            "time_order": F.col("end_time") >= F.col("start_time"),
            "chain_tail": (used == "escalation_failed") | (F.try_element_at("escalation_chain", F.lit(-1)) == used),
        },
    )


def provenance_errors(chains: DataFrame) -> DataFrame:
    """Verified chains without a citation."""
    return chains.filter(F.col("verified") & (F.coalesce(F.size("items"), F.lit(0)) <= 0))


def section_errors(index: DataFrame) -> DataFrame:
    """Sections that end before they start, and documents with another number of roots than one."""
    order = index.filter(F.col("page_start") > F.col("page_end")).select("document_id", "section_id", F.lit("page_order").alias("rule"))
    roots = index.groupBy("document_id").agg(F.count_if(F.col("section_id") == "root").alias("n")).filter("n <> 1")
    return order.unionByName(roots.select("document_id", F.lit("root").alias("section_id"), F.lit("one_root").alias("rule")))
