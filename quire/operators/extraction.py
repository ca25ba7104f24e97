"""The three extraction strategies over what a PDF reader, a layout model and a vision model give, and the router that runs them.

Each strategy gives elements (blocks, tables, figures, reading order) and one attempt for each document: document_id,
strategy, has_document, confidence and notes, as triage.cascade judges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import strip
from quire.operators import triage
from quire.plans.config import Rules
from quire.plans.schemas import ATTEMPTS, FIGURES, TABLES
from quire.plans.storage import numbered, stored
from quire.sources.readers import elements_of_answers, json_or_null, read_answers

Elements = tuple[DataFrame, DataFrame, DataFrame, DataFrame]
# The boxes of layout elements without one, as right and lower side, by kind; all start at 0.
LAYOUT_BOX = {"texts": (100.0, 20.0), "tables": (100.0, 50.0), "pictures": (100.0, 80.0)}
LAYOUT_SIDES = ", ".join(f"{n} double" for n in ("l", "t", "r", "b", "x0", "y0", "x1", "y1"))
LAYOUT_RECT = f"struct<{LAYOUT_SIDES.replace(' double', ':double')}>"
#: Answers of a vision model that a worker gives on at once.
AT_ONCE = 1000
#: What a layout model's export may hold; header and rows are those of a table's data frame.
LAYOUT = (
    f"texts array<struct<text:string,page_no:int,page:int,bbox:{LAYOUT_RECT},rect:{LAYOUT_RECT},prov:array<struct<page_no:int,page:int,bbox:{LAYOUT_RECT},rect:{LAYOUT_RECT}>>>>, "
    f"tables array<struct<page_no:int,page:int,bbox:{LAYOUT_RECT},rect:{LAYOUT_RECT},header:array<string>,rows:array<array<string>>>>, "
    f"pictures array<struct<page_no:int,page:int,bbox:{LAYOUT_RECT},rect:{LAYOUT_RECT}>>"
)


def page_counts(elements: Elements) -> DataFrame:
    """document_id and page_count of extracted documents: the last page that has an element, 1 at least."""
    rows = reduce(DataFrame.unionByName, [e.select("document_id", "page_number") for e in elements[:3]])
    return rows.groupBy("document_id").agg(F.greatest(F.max("page_number"), F.lit(1)).alias("page_count"))


def nothing(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def text_lines(words: DataFrame) -> DataFrame:
    """document_id, page, at (order in the page), x0, top, x1, bottom and text of the lines of words: see triage.lines_of_words."""
    return triage.lines_of_words(words).withColumnRenamed("line", "at")


def span_blocks(spans: DataFrame) -> DataFrame:
    """document_id, page, at, x0, top, x1, bottom, text and typed (characters) of blocks, from rows of their spans.

    spans: document_id, page, block, line, span, text, and the block's x0, top, x1, bottom. A block's spans are joined by
    spaces; blocks without text are no blocks, though their characters count.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "span", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ")
    box = [F.first(n).alias(n) for n in ("x0", "top", "x1", "bottom")]
    blocks = spans.groupBy("document_id", "page", F.col("block").alias("at")).agg(*box, strip(text).alias("text"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("typed"))
    return blocks


def page_measures(lines: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """What the confidence of plain text comes from, by page: see triage.fast_text_scores.

    pages: document_id, page, width, height, has_font. images: document_id, page, x0, top, x1, bottom. lines may have the
    characters typed in them, else their texts' length counts.
    """
    keys = ["document_id", "page"]
    typed = F.col("typed") if "typed" in lines.columns else F.length("text")
    area = (F.col("x1") - F.col("x0")) * (F.col("bottom") - F.col("top"))
    text = lines.groupBy(*keys).agg(F.sum(typed).alias("char_count"), F.sum(F.when(F.col("text") != "", area).otherwise(0.0)).alias("text_area"))
    drawn = images.groupBy(*keys).agg(F.sum(area).alias("image_area"))
    rows = pages.join(text, keys, "left").join(drawn, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return rows.select(*keys, F.coalesce("char_count", F.lit(0)).alias("char_count"), "width", "height", zero("text_area"), zero("image_area"), "has_font")


def fast_text(lines: DataFrame, pages: DataFrame, images: DataFrame, config: Rules | None = None) -> tuple[Elements, DataFrame]:
    """Strategy A: text lines (or blocks) become blocks with boxes from the page's bottom; the attempt's confidence comes from their measures.

    Blocks are numbered through their document in the order of pages and lines, and named by page and number.
    """
    scores = triage.fast_text_scores(page_measures(lines, pages, images), config)
    enough = F.col("score") >= triage.threshold(F.lit("fast_text"), config)
    attempts = scores.select("document_id", F.lit("fast_text").alias("strategy"), enough.alias("has_document"), F.col("score").alias("confidence"), F.when(~enough, "confidence_below_threshold").alias("notes"))
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("page", "at")) - 1
    placed = lines.filter(F.col("text") != "").withColumn("n", n).join(pages.select("document_id", "page", "height"), ["document_id", "page"])
    name = F.concat(F.lit("block_"), F.col("page").cast("string"), F.lit("_"), F.col("n").cast("string"))
    box = geometry.flipped(*[F.col(c) for c in ("x0", "top", "x1", "bottom", "height")])
    blocks = placed.select("document_id", name.alias("id"), F.col("page").alias("page_number"), box.alias("bbox"), "text", F.col("n").alias("reading_order_index"))
    order = blocks.select("document_id", F.lit("text_block").alias("ref_type"), F.col("id").alias("ref_id"), F.col("reading_order_index").alias("order"))
    return (blocks, nothing(lines, TABLES), nothing(lines, FIGURES), order), attempts


def layout_box(e: Column, kind: str, boxes: tuple[Column, ...]) -> Column:
    """The first box that an element has, measured from the page's top, as one from its bottom."""
    right, low = LAYOUT_BOX[kind]
    rect = F.coalesce(*boxes)
    side = lambda a, b, default: F.coalesce(rect[a], rect[b] if kind == "texts" else F.lit(None).cast("double"), F.lit(default))
    return geometry.from_top_left(side("l", "x0", 0.0), side("t", "y0", 0.0), side("r", "x1", right), side("b", "y1", low))


def layout_model(exports: DataFrame, config: Rules | None = None) -> tuple[Elements, DataFrame]:
    """Strategy B: a layout model's export as JSON, from exports (document_id, export), becomes elements.

    Texts come before tables before pictures in reading order. A text's page and box are those of its first provenance,
    else its own; tables without a data frame have one empty header cell and no rows. No export, or one that isn't JSON,
    is a failed conversion.
    """
    # every kind of element, the order and the attempts come from it: JSON is read once
    read = stored(exports.select("document_id", json_or_null(F.col("export"), LAYOUT).alias("v")))
    good = read.filter("v is not null")
    size = lambda n: F.greatest(F.coalesce(F.size(f"v.{n}"), F.lit(0)), F.lit(0))
    before = {"texts": F.lit(0), "tables": size("texts"), "pictures": size("texts") + size("tables")}

    def elements(name: str, kind: str) -> DataFrame:
        rows = good.select("document_id", before[name].alias("before"), F.posexplode(f"v.{name}").alias("n", "e"))
        e, own = F.col("e"), (F.col("e.bbox"), F.col("e.rect"))
        if name == "texts":
            first = F.get("e.prov", F.lit(0))
            page = F.when(first.isNotNull(), F.coalesce(first["page_no"], first["page"], F.lit(1))).otherwise(F.lit(1))
            box = F.when(first.isNotNull(), layout_box(e, name, (first["bbox"], first["rect"]))).otherwise(layout_box(e, name, own))
        else:
            page, box = F.coalesce("e.page_no", "e.page", F.lit(1)), layout_box(e, name, own)
        ident = F.concat(F.lit(f"{kind}_"), page.cast("string"), F.lit("_"), F.col("n").cast("string"))
        return rows.select("document_id", (F.col("before") + F.col("n")).alias("order"), "e", ident.alias("id"), page.alias("page_number"), box.alias("bbox"))

    texts, tabs, pics = elements("texts", "block"), elements("tables", "table"), elements("pictures", "figure")
    blocks = texts.select("document_id", "id", "page_number", "bbox", F.coalesce("e.text", F.lit("")).alias("text"), F.col("order").alias("reading_order_index"))
    framed = F.coalesce(F.size("e.header"), F.lit(0)) > 0
    none = F.lit(None).cast("string")
    header = F.when(framed, F.col("e.header")).otherwise(F.array(F.lit(""))).alias("header")
    rows = F.when(framed, F.coalesce("e.rows", F.array().cast("array<array<string>>"))).otherwise(F.array().cast("array<array<string>>")).alias("rows")
    tables = tabs.select("document_id", "id", "page_number", "bbox", none.alias("title"), none.alias("caption"), header, rows)
    figures = pics.select("document_id", "id", "page_number", "bbox", none.alias("caption"), none.alias("alt_text"), none.alias("type"))
    kinds = (("text_block", texts), ("table", tabs), ("figure", pics))
    order = [df.select("document_id", F.lit(kind).alias("ref_type"), F.col("id").alias("ref_id"), "order") for kind, df in kinds]
    done = F.col("v").isNotNull()
    sure = F.when(done, (config or Rules()).router.layout_default).otherwise(0.0)
    attempts = read.select("document_id", F.lit("layout").alias("strategy"), done.alias("has_document"), sure.alias("confidence"), F.when(~done, "layout conversion failed").alias("notes"))
    return (blocks, tables, figures, reduce(DataFrame.unionByName, order)), attempts


def vision_pages(pages: DataFrame, config: Rules | None = None) -> DataFrame:
    """The pages that a vision model is shown: the first ones of each document, up to the limit."""
    return pages.filter(F.col("page") <= (config or Rules()).router.vision_pages)


def answered(pages: DataFrame, call: Callable[[str, list[bytes]], str | None]) -> DataFrame:
    """document_id and response from pages (document_id, page, image): `call` takes an id and its page images in order.

    The call runs on the executors, once a document; one that fails gives null.
    """

    def said(document_id: str | None, images: list[bytes | None]) -> str | None:
        try:
            return call(document_id, [bytes(b) for b in images])
        except Exception:  # noqa: BLE001  a failed call is an answer too
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document's pages follow each other, and may go on in the next batch
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        answers = ((document_id, said(document_id, [image for _, image in own])) for document_id, own in groupby(rows, lambda row: row[0]))
        while some := list(islice(answers, AT_ONCE)):
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*some, strict=True)], ["document_id", "response"])

    dealt = pages.select(F.col("document_id").cast("string").alias("document_id"), "image", "page").repartition("document_id")
    ordered = dealt.sortWithinPartitions("document_id", F.col("page").asc_nulls_last()).select("document_id", "image")
    return ordered.mapInArrow(run, "document_id string, response string")


def vision_model(answers: DataFrame, config: Rules | None = None) -> tuple[Elements, DataFrame]:
    """Strategy C: a vision model's answers as JSON, from answers (document_id, response), become elements."""
    read = stored(read_answers(answers))
    done = F.col("valid")
    note = F.when(F.col("v").isNull(), "vision_api_call_failed").when(~done, "vision_response_invalid")
    sure = F.when(done, (config or Rules()).router.vision_default).otherwise(0.0)
    attempts = read.select("document_id", F.lit("vision").alias("strategy"), done.alias("has_document"), sure.alias("confidence"), note.alias("notes"))
    return elements_of_answers(read), attempts


ATTEMPT = ("document_id", "strategy", "has_document", "confidence", "notes")


@dataclass
class Budget:
    """What vision runs may cost together, what has been spent, and how many documents are run before sums are taken again."""

    limit_usd: float
    spent_usd: float = 0.0
    at_once: int = 1000


def routed(
    profiles: DataFrame, extractors: dict[str, Callable[[DataFrame], DataFrame]], config: Rules | None = None, refused: DataFrame | None = None, budget: Budget | None = None
) -> DataFrame:
    """The ledger of a cascade that is really run: each strategy gets only the documents that have come to it.

    extractors: by strategy, a function from document_id to attempts (document_id, has_document, confidence, notes, and if
    it has them the columns of triage.USAGE; others are not read). A round for each place in the chains; what a round
    gives is stored, so no extractor runs twice. The result is that of triage.cascade over all attempts.

    refused (document_id) may not use the vision strategy. With a budget, documents come to it in rounds of so many, in
    the order of places in chains and of ids; between rounds what accepted runs with tokens have cost is added up, and
    once the limit is reached all that still wait are refused, without being run.
    """
    steps = triage.chain_steps(profiles)
    if refused is not None:
        barred = steps.filter("strategy = 'vision'").join(refused.select("document_id").distinct(), "document_id", "left_semi")
        first = barred.groupBy("document_id").agg(F.min("step").alias("barred_at"))
        steps = steps.join(first, "document_id", "left").filter("barred_at is null or step < barred_at").drop("barred_at")
    tried: list[DataFrame] = []
    late: list[DataFrame] = []
    limit = triage.threshold(F.col("strategy"), config)
    both = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def attempts_of(name: str, ids: DataFrame) -> DataFrame:
        made = extractors[name](ids.select("document_id")).withColumn("strategy", F.lit(name))
        return made.select(*ATTEMPT, *[c for c in triage.USAGE if c in made.columns])

    for step in range(3):
        todo = steps.filter(F.col("step") == step).select("document_id", "strategy")
        won = [both(tried).filter(F.col("has_document") & (F.col("confidence") >= limit))] if tried else []
        for gone in [*won, *late]:
            todo = todo.join(gone.select("document_id").distinct(), "document_id", "left_anti")
        todo = stored(todo)
        plain = [name for name in extractors if budget is None or name != "vision"]
        made = [attempts_of(name, todo.filter(F.col("strategy") == name)) for name in plain]
        if made:
            tried.append(stored(both(made)))
        if budget is not None and "vision" in extractors:
            waiting = stored(numbered(todo.filter("strategy = 'vision'").select("document_id"), "place", "document_id"))
            count, start = waiting.count(), 0
            while start < count and budget.spent_usd < budget.limit_usd:
                part = waiting.filter(F.col("place").between(start, start + budget.at_once - 1))
                tried.append(stored(attempts_of("vision", part)))
                won = tried[-1].filter(F.col("has_document") & (F.col("confidence") >= limit)).withColumn("strategy_used", F.lit("vision"))
                budget.spent_usd += usage(with_usage(won)).agg(F.sum("cost_usd")).first()[0] or 0.0
                start += budget.at_once
            late.append(waiting.filter(F.col("place") >= start).select("document_id"))
    attempts = both(tried) if tried else nothing(profiles, ATTEMPTS)
    late += [] if refused is None else [refused.select("document_id")]
    return triage.cascade(profiles, attempts, config, reduce(DataFrame.unionByName, late) if late else None)


def with_usage(rows: DataFrame) -> DataFrame:
    """rows with all columns of triage.USAGE, null where they were missing."""
    return rows.withColumns({c: F.lit(None).cast("double" if "usd" in c else "long") for c in triage.USAGE if c not in rows.columns})


def usage(ledger: DataFrame) -> DataFrame:
    """document_id, tokens and cost of accepted vision runs that used any: what a budget keeps account of."""
    prompt, completion = (F.coalesce(F.col(c), F.lit(0)) for c in ("token_usage_prompt", "token_usage_completion"))
    used = ledger.filter((F.col("strategy_used") == "vision") & (prompt + completion > 0))
    return used.select("document_id", prompt.alias("prompt"), completion.alias("completion"), F.coalesce("cost_estimate_usd", F.lit(0.0)).alias("cost_usd"))


def over_budget(used: DataFrame, limit_usd: float) -> DataFrame:
    """document_id of those whose vision runs have cost the limit or more."""
    return used.groupBy("document_id").agg(F.sum("cost_usd").alias("spent")).filter(F.col("spent") >= limit_usd).select("document_id")


__all__ = [
    "Budget", "answered", "fast_text", "layout_model", "over_budget", "page_counts", "page_measures", "routed", "span_blocks", "text_lines", "usage", "vision_model", "vision_pages",
]
