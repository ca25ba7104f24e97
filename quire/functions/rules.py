"""Decision rules as Column expressions over aggregated signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.plans.config import FastTextRules, LayoutRules, OriginRules

# The domains of the columns.
ORIGINS = ("native_digital", "scanned_image", "mixed", "form_fillable")
LAYOUTS = ("single_column", "multi_column", "table_heavy", "figure_heavy", "mixed")
COSTS = ("fast_text_sufficient", "needs_layout_model", "needs_vision_model")
STRATEGIES = ("fast_text", "layout", "vision")


def origin_rule(pages: Column, digital: Column, image_ratio: Column, rules: OriginRules) -> Column:
    """origin, confidence and reason of a document from its pages, its digital pages and the mean share of images."""
    share = digital / F.nullif(pages, F.lit(0))
    plain = image_ratio <= rules.max_image_area_ratio

    def out(origin: str, confidence: Column | float, reason: Column | str) -> Column:
        value = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(F.lit(origin).alias("origin"), value(confidence).cast("double").alias("confidence"), value(reason).alias("reason"))

    return (
        F.when(F.coalesce(pages, F.lit(0)) == 0, out("scanned_image", 0.0, "zero_pages"))
        .when(digital == 0, out("scanned_image", 0.9, "all_pages_below_min_chars"))
        .when((share > rules.fraction_min) & (share < rules.fraction_max), out("mixed", F.when(plain, 0.85).otherwise(0.6), "fraction_pages_digital_in_range"))
        .when(
            share >= rules.fraction_max,
            out("native_digital", F.when(plain, 0.95).otherwise(0.75), F.when(plain, "all_digital_low_image").otherwise("all_digital_high_image")),
        )
        .otherwise(out("mixed", 0.6, "few_pages_digital"))
    )


def layout_rule(table_ratio: Column, figure_ratio: Column, table_regions: Column, columns: Column, rules: LayoutRules) -> Column:
    """layout and confidence from mean shares of tables and figures, mean table regions a page and the most columns."""
    tables = (table_ratio >= rules.table_area_ratio) | (table_regions >= rules.table_regions)
    figures = figure_ratio >= rules.figure_area_ratio
    out = lambda layout, confidence: F.struct(F.lit(layout).alias("layout"), F.lit(confidence).alias("confidence"))
    return (
        F.when(tables & figures, out("mixed", 0.85))
        .when(tables, out("table_heavy", 0.9))
        .when(figures, out("figure_heavy", 0.9))
        .when(columns >= 2, out("multi_column", 0.85))
        .otherwise(out("single_column", 0.95))
    )


def fast_text_confidence(chars: Column, area: Column, text_area: Column, image_area: Column, low: Column, fonts: Column, pages: Column, rules: FastTextRules) -> Column:
    """score, missing_text and the ratios it comes from, of sums over a document's pages."""
    some = F.nullif(area, F.lit(0.0))
    density, image = chars / (some / 10_000.0), image_area / some
    white = F.greatest(F.lit(0.0), 1.0 - text_area / some - image)
    low_share = low / F.nullif(pages, F.lit(0))
    missing = (low_share > 0.5) | (chars < rules.min_chars_per_page)
    factor = lambda when, value: F.when(when, value).otherwise(F.lit(1.0))
    score = factor(density < rules.min_density, F.greatest(F.lit(0.0), density / rules.min_density))
    score = score * factor(image > rules.max_image_area_ratio, F.greatest(F.lit(0.0), 1.0 - (image - rules.max_image_area_ratio) / (1.0 - rules.max_image_area_ratio)))
    score = score * factor(low_share > 0, 1.0 - low_share * 0.5) * factor((fonts == 0) & (chars > 0), F.lit(0.8))
    score = score * factor(missing, F.lit(0.7)) * factor(white > 0.8, F.lit(0.9))
    none = (F.coalesce(pages, F.lit(0)) == 0) | (F.coalesce(area, F.lit(0.0)) <= 0)
    return F.struct(
        F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"),
        F.when(none, True).otherwise(missing).alias("missing_text"),
        F.when(none, 0.0).otherwise(density).alias("char_density"),
        F.when(none, 0.0).otherwise(image).alias("image_area_ratio"),
        F.when(none, 1.0).otherwise(white).alias("whitespace_ratio"),
    )


def estimated_cost(origin: Column, layout: Column) -> Column:
    return (
        F.when(origin == "scanned_image", COSTS[2])
        .when(layout.isin("table_heavy", "multi_column", "mixed", "figure_heavy"), COSTS[1])
        .when((origin == "native_digital") & (layout == "single_column"), COSTS[0])
        .otherwise(COSTS[1])
    )


def strategy_chain(origin: Column, layout: Column, cost: Column) -> Column:
    """The extraction strategies to try, in order."""
    chain = lambda *names: F.array(*[F.lit(n) for n in names])
    return (
        F.when((origin == "scanned_image") | (cost == COSTS[2]), chain("vision", "layout"))
        .when((origin == "native_digital") & (layout == "single_column"), chain("fast_text", "layout", "vision"))
        .otherwise(chain("layout", "vision"))
    )
