"""Triage and routing: page signals become profiles, profiles strategies, and attempts a gated cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry, rules
from quire.plans.config import DomainRules, Rules


def document_key(path: Column) -> Column:
    """The id of a document: 32 hex digits of its path's SHA-256."""
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 32)


def page_signals(pages: DataFrame, chars: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """One row per page (plans.schemas.PAGE_SIGNALS) from pages (document_id, page, width, height) and what is on them.

    chars has x0 of each character; images and tables have width and height, and x0 to y1. Shares of the page's area
    stop at 1. columns is the number of fifths of the page in which a character starts, 1 without characters.
    """
    keys = ["document_id", "page"]
    bucket = geometry.column_bucket(F.col("x0"), F.col("width"))
    typed = chars.join(pages.select(*keys, "width"), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("chars"), F.count_distinct(bucket).alias("columns"))
    drawn = images.groupBy(*keys).agg(F.sum(F.col("width") * F.col("height")).alias("image_area"))
    ruled = tables.groupBy(*keys).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("table_area"), F.count(F.lit(1)).alias("table_regions"))
    rows = pages.join(typed, keys, "left").join(drawn, keys, "left").join(ruled, keys, "left")
    share = lambda area: F.coalesce(F.least(F.coalesce(area, F.lit(0.0)) / F.nullif(F.col("width") * F.col("height"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return rows.select(
        *keys, F.coalesce("chars", F.lit(0)).cast("int").alias("chars"), share(F.col("image_area")).alias("image_ratio"), share(F.col("table_area")).alias("table_ratio"),
        F.coalesce("table_regions", F.lit(0)).cast("int").alias("table_regions"), F.coalesce("columns", F.lit(1)).cast("int").alias("columns"),
    )


def lines_of_words(words: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """document_id, page, line, text and bbox from words (document_id, page, x0, top, x1, bottom, text).

    Words go by top, then x0; a new line starts where a word's top is more than `tolerance` off that of the line's first
    word. That depends on the order, so it is a fold over each page's sorted words, in the JVM.
    """
    word = F.struct("top", "x0", "x1", "bottom", "text")
    pages = words.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(word)).alias("words"))
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("top"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, w: Column) -> Column:
        new = state["top"].isNull() | (F.abs(state["top"] - w["top"]) > tolerance)
        n = state["n"] + 1
        starts = F.when(new, F.concat(state["starts"], F.array(n))).otherwise(state["starts"])
        return F.struct(n.alias("n"), F.when(new, w["top"].cast("double")).otherwise(state["top"]).alias("top"), starts.alias("starts"))

    # a page's words are neighbours by line, so lines are slices of them
    placed = pages.withColumn("starts", F.aggregate("words", start, step)["starts"])
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("words") + 1))
    each = placed.select("document_id", "page", "words", F.posexplode(F.arrays_zip(F.col("starts").alias("a"), ends.alias("b"))).alias("line", "at"))
    each = each.select("document_id", "page", "line", F.expr("slice(words, at.a, at.b - at.a)").alias("words"))
    least, most = (lambda n: F.array_min(F.transform("words", lambda w: w[n])).alias(n)), (lambda n: F.array_max(F.transform("words", lambda w: w[n])).alias(n))
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text")
    return each.select("document_id", "page", "line", text, least("x0"), least("top"), most("x1"), most("bottom"))


def sample_text(pages: DataFrame, rules_: DomainRules | None = None) -> DataFrame:
    """document_id and text: the first pages' text in lower case, from pages (document_id, page, text)."""
    most = (rules_ or DomainRules()).sample_pages
    some = pages.filter(F.col("page") <= most).groupBy("document_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    return some.agg(F.lower(F.array_join(listed, " ")).alias("text"))


def origins(signals: DataFrame, config: Rules | None = None) -> DataFrame:
    """document_id, pages, origin, origin_confidence and origin_reason."""
    own = (config or Rules()).origin
    summed = signals.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("chars") >= own.min_chars_per_page).alias("digital"), F.avg("image_ratio").alias("image_ratio")
    )
    out = summed.withColumn("o", rules.origin_rule(F.col("pages"), F.col("digital"), F.col("image_ratio"), own))
    return out.select("document_id", "pages", F.col("o.origin").alias("origin"), F.col("o.confidence").alias("origin_confidence"), F.col("o.reason").alias("origin_reason"))


def layouts(signals: DataFrame, config: Rules | None = None) -> DataFrame:
    """document_id, layout and layout_confidence."""
    summed = signals.groupBy("document_id").agg(
        F.avg("table_ratio").alias("tables"), F.avg("image_ratio").alias("figures"), F.avg("table_regions").alias("regions"), F.max("columns").alias("columns")
    )
    out = summed.withColumn("l", rules.layout_rule(F.col("tables"), F.col("figures"), F.col("regions"), F.col("columns"), (config or Rules()).layout))
    return out.select("document_id", F.col("l.layout").alias("layout"), F.col("l.confidence").alias("layout_confidence"))


def domains(samples: DataFrame, config: Rules | None = None) -> DataFrame:
    """document_id, domain, domain_confidence and matched, from samples (document_id, text).

    A domain scores its hits by half of its keywords, 1 at most; the best wins, the first of equal ones, if it reaches the
    cutoff. The keywords are constants of the expression: no join, and no shuffle.
    """
    own = (config or Rules()).domain
    if not own.keywords:
        return samples.select("document_id", F.lit("general").alias("domain"), F.lit(0.0).alias("domain_confidence"), F.array().cast("array<string>").alias("matched"))
    text = F.lower(F.coalesce("text", F.lit("")))
    scores = []
    for place, (domain, terms) in enumerate(own.keywords.items()):
        hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))
        score = F.least(F.lit(1.0), F.size(hits) / F.lit(float(max(1, len(terms) // 2))))
        scores.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(domain).alias("domain"), hits.alias("hits")))
    best = samples.withColumn("best", F.array_max(F.array(*scores)))
    wins = (F.col("best.score") >= own.cutoff) & (F.size("best.hits") > 0)
    return best.select(
        "document_id", F.when(wins, F.col("best.domain")).otherwise("general").alias("domain"),
        F.when(wins, F.least(F.lit(0.95), own.cutoff + 0.5 * F.col("best.score"))).otherwise(0.5).alias("domain_confidence"),
        F.when(wins, F.col("best.hits")).otherwise(F.array().cast("array<string>")).alias("matched"),
    )


#: How sure a judgement is that a hook gives without a confidence.
HOOK_CONFIDENCE = 0.8


def judged(found: DataFrame, name: str) -> DataFrame:
    """What a hook gives for each document, with the confidence that it leaves out."""
    sure = f"{name}_confidence"
    return found.select("document_id", name, (F.col(sure) if sure in found.columns else F.lit(HOOK_CONFIDENCE)).alias(sure))


def profiles(
    signals: DataFrame, samples: DataFrame, config: Rules | None = None, origin_of: DataFrame | None = None, layout_of: DataFrame | None = None, domain_of: DataFrame | None = None,
    page_counts: DataFrame | None = None,
) -> DataFrame:
    """One row per document: origin, layout, domain, estimated cost and the least of the three confidences.

    origin_of, layout_of and domain_of (document_id, the judgement, and its confidence if they have one) and page_counts
    (document_id, page_count) take the place of what the rules find, for all documents.
    """
    rows = origins(signals, config)
    if origin_of is not None:
        rows = rows.select("document_id", "pages").join(judged(origin_of, "origin"), "document_id").withColumn("origin_reason", F.lit(None).cast("string"))
    if page_counts is not None:
        rows = rows.drop("pages").join(page_counts.select("document_id", F.col("page_count").alias("pages")), "document_id")
    rows = rows.join(layouts(signals, config) if layout_of is None else judged(layout_of, "layout"), "document_id")
    found = domains(samples, config) if domain_of is None else judged(domain_of, "domain").withColumn("matched", F.array().cast("array<string>"))
    rows = rows.join(found, "document_id", "left")
    rows = rows.withColumn("domain", F.coalesce("domain", F.lit("general"))).withColumn("domain_confidence", F.coalesce("domain_confidence", F.lit(0.5)))
    return rows.select(
        "document_id", F.greatest("pages", F.lit(1)).alias("page_count"), "origin", "layout", "domain", F.lit("en").alias("language"), F.lit(0.5).alias("language_confidence"),
        rules.estimated_cost(F.col("origin"), F.col("layout")).alias("estimated_cost"), F.least("origin_confidence", "layout_confidence", "domain_confidence").alias("confidence"),
        "origin_reason", "matched",
    )


def fast_text_scores(pages: DataFrame, config: Rules | None = None) -> DataFrame:
    """document_id, the sums over its pages, and the confidence of plain text extraction.

    pages: document_id, page, char_count, width, height, text_area, image_area, has_font.
    """
    own = (config or Rules()).fast_text
    summed = pages.groupBy("document_id").agg(
        F.sum("char_count").alias("chars"), F.sum(F.col("width") * F.col("height")).alias("area"), F.sum("text_area").alias("text_area"), F.sum("image_area").alias("image_area"),
        F.count_if(F.col("char_count") < own.min_chars_per_page).alias("low_pages"), F.count_if("has_font").alias("font_pages"), F.count(F.lit(1)).alias("pages"),
    )
    found = rules.fast_text_confidence(*[F.col(c) for c in ("chars", "area", "text_area", "image_area", "low_pages", "font_pages", "pages")], own)
    return summed.withColumn("c", found).select("document_id", "chars", "pages", "low_pages", "c.*")


#: What an attempt may tell of its cost; of a document's attempts the last one's counts.
USAGE = ("cost_estimate_usd", "token_usage_prompt", "token_usage_completion")


def chain_steps(profiles_: DataFrame) -> DataFrame:
    """document_id, origin, layout, step (from 0) and strategy: what would be tried for each document, in order."""
    chain = rules.strategy_chain(F.col("origin"), F.col("layout"), F.col("estimated_cost"))
    return profiles_.withColumn("chain", chain).select("document_id", "origin", "layout", F.posexplode("chain").alias("step", "strategy"))


def threshold(strategy: Column, config: Rules | None = None) -> Column:
    """The least confidence with which a strategy's document is accepted."""
    own = (config or Rules()).router
    limits = F.create_map(*[x for n, v in (("fast_text", own.fast_text), ("layout", own.layout), ("vision", own.vision)) for x in (F.lit(n), F.lit(float(v)))])
    return F.try_element_at(limits, strategy)


def cascade(profiles_: DataFrame, attempts: DataFrame, config: Rules | None = None, refused: DataFrame | None = None) -> DataFrame:
    """What each document's chain of strategies comes to: one row with the strategy used, the chain as far as it went, and notes.

    attempts: document_id, strategy, has_document, confidence, notes, and if it has them the columns of USAGE (one row for
    each strategy that was or could be run; without a row a strategy has failed). A strategy is accepted if it gave a
    document with its threshold's confidence, and then its notes count; a document below it is noted as such, whatever
    its own notes; a failure notes what it says. refused (document_id) are those whose budget forbids the vision
    strategy: it ends the chain, of which it is a part, and is noted. confidence is that of the last attempt, accepted
    or not; a refused one has that of the attempt before. notes is null if there are none.
    """
    rows = chain_steps(profiles_).join(attempts, ["document_id", "strategy"], "left")
    no = F.lit(False)
    if refused is not None:
        barred = refused.select("document_id").distinct().withColumn("barred", F.lit(True))
        rows = rows.join(barred, "document_id", "left")
        no = F.coalesce("barred", F.lit(False)) & (F.col("strategy") == "vision")
    given, sure = F.coalesce("has_document", F.lit(False)), F.coalesce("confidence", F.lit(0.0))
    rows = rows.withColumn("refused", no).withColumn("given", given & ~no).withColumn("confidence", sure)
    rows = rows.withColumn("accepted", F.col("given") & (F.col("confidence") >= threshold(F.col("strategy"), config)))
    by = Window.partitionBy("document_id").orderBy("step")
    ended = F.coalesce(F.max((F.col("accepted") | F.col("refused")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("ended", ended).filter("ended = 0")
    own = F.nullif(F.coalesce("notes", F.lit("")), F.lit(""))
    note = F.when(F.col("refused"), "budget_exceeded").when(F.col("accepted") | ~F.col("given"), own).otherwise("confidence_below_threshold")
    rows = rows.withColumn("note", note)
    listed = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), F.struct("step", name)))), lambda x: x[name])
    last = lambda name, when: F.max(F.when(when, F.struct("step", F.col(name).alias("value"))))["value"]
    told = [n for n in USAGE if n in attempts.columns]
    zero = {"cost_estimate_usd": F.lit(0.0)}
    usage = [F.max(F.struct("step", F.when(F.col("refused"), zero.get(n, F.lit(None))).otherwise(F.col(n)).alias("value")))["value"].alias(n) for n in told]
    out = rows.groupBy("document_id", "origin", "layout").agg(
        F.max(F.when(F.col("accepted"), F.col("strategy"))).alias("won"), F.coalesce(last("confidence", ~F.col("refused")), F.lit(0.0)).alias("confidence"),
        listed("strategy").alias("escalation_chain"), F.nullif(F.array_join(listed("note"), "; "), F.lit("")).alias("notes"), *usage,
    )
    return out.select("document_id", "origin", "layout", F.coalesce("won", F.lit("escalation_failed")).alias("strategy_used"), "confidence", "escalation_chain", "notes", *told)


def densities(pages: DataFrame, places: int = 4) -> DataFrame:
    """document_id, pages, chars and the area-weighted means of page ratios; rounded half to even."""
    area = F.col("width") * F.col("height")
    weighted = lambda c: F.bround(F.sum(F.col(c) * area) / F.nullif(F.sum(area), F.lit(0.0)), places)
    rows = pages.withColumn("text_ratio", F.col("text_area") / F.nullif(area, F.lit(0.0))).withColumn("image_ratio", F.col("image_area") / F.nullif(area, F.lit(0.0)))
    rows = rows.withColumn("density", F.col("char_count") / F.nullif(area, F.lit(0.0)))
    return rows.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("char_count").alias("chars"), weighted("text_ratio").alias("text_ratio"), weighted("image_ratio").alias("image_ratio"),
        F.bround(F.sum(F.col("density") * area) / F.nullif(F.sum(area), F.lit(0.0)), 6).alias("char_density"),
    )


def box_statistics(boxes: DataFrame) -> DataFrame:
    """document_id, page, and count, least, greatest and mean width and height of the boxes of each page."""
    sides = (("width", F.col("x1") - F.col("x0")), ("height", F.col("y1") - F.col("y0")))
    measures = (("min", F.min), ("max", F.max), ("mean", F.avg))
    found = [F.bround(of(side), 2).alias(f"{name}_{what}") for what, side in sides for name, of in measures]
    return boxes.groupBy("document_id", "page").agg(F.count(F.lit(1)).alias("boxes"), *found)
