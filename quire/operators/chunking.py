"""Chunking: extracted blocks, tables and figures in reading order become logical units with stable hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.text import (
    FIGURE_MENTION,
    PART_JOIN,
    TABLE_MENTION,
    content_hash,
    is_list_item,
    json_list,
    json_object,
    json_string,
    looks_like_heading,
    strip,
    token_count,
)
from quire.plans.schemas import PAYLOAD
from quire.plans.storage import dealt_by, kept, read_stored, stored, written, written_by


#: Entries beyond which a document is long: it is dealt out in parts, what is open at their ends is carried from one to the next.
LONG = 100_000
#: Entries of a part, if that makes no more parts than a shuffle has; beyond these, entries of a part at most: a task holds
#: its entries in several sorts at once, some 1.3 kB for each, and spills what doesn't fit its share of an executor.
SMALL, LARGE = 100_000, 200_000


def given_order(blocks: DataFrame, reading_order: DataFrame) -> DataFrame:
    """The given order, and text blocks by index for the documents without one; only their blocks are looked at for it."""
    given = reading_order.select("document_id", "ref_type", "ref_id", F.col("order").cast("int").alias("order"))
    bare = stored(blocks.select("document_id").distinct().join(reading_order.select("document_id").distinct(), "document_id", "left_anti"))
    if bare.isEmpty():
        return given
    by_index = F.col("reading_order_index").cast("int").alias("order")
    found = kept(blocks, bare, bare.count(), "left_semi")
    return given.unionByName(found.select("document_id", F.lit("text_block").alias("ref_type"), F.col("id").alias("ref_id"), by_index))


#: What tables and figures hold besides; one column of all, as it is carried through every window.
HELD = {"title": "string", "caption": "string", "alt_text": "string", "type": "string", "header": "array<string>", "rows": "array<array<string>>"}


def referenced(blocks: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """Blocks, tables and figures as rows of one kind: document_id, ref_type, ref_id, page, bbox, text and held."""
    own = ["document_id", F.col("id").alias("ref_id"), F.col("page_number").alias("page"), "bbox"]
    kind_of = f"struct<{','.join(f'{n}:{kind}' for n, kind in HELD.items())}>"

    def rows(df: DataFrame, kind: str, *has: str) -> DataFrame:
        text = F.col("text") if kind == "text_block" else F.lit(None).cast("string").alias("text")
        held = F.struct(*[(F.col(n) if n in has else F.lit(None)).cast(t).alias(n) for n, t in HELD.items()]) if has else F.lit(None).cast(kind_of)
        return df.select(F.lit(kind).alias("ref_type"), *own, text, held.cast(kind_of).alias("held"))

    return rows(blocks, "text_block").unionByName(rows(tables, "table", "title", "caption", "header", "rows")).unionByName(rows(figures, "figure", "caption", "alt_text", "type"))


#: The order of a document's entries.
PLACE = ("order", "ref_type", "ref_id")


def tested(entries: DataFrame) -> DataFrame:
    """Entries with what their own texts say: is_text, heading and listed."""
    rows = entries.withColumn("is_text", F.col("found") & (F.col("ref_type") == "text_block") & (F.col("text") != ""))
    rows = rows.withColumn("heading", F.col("is_text") & looks_like_heading(F.col("text"), stripped=True))
    return rows.withColumn("listed", F.col("is_text") & is_list_item(F.col("text"), stripped=True))


def in_order(rows: DataFrame) -> WindowSpec:
    """A document's entries in their order, or those of one of its parts."""
    return Window.partitionBy("doc", "document_id", *(["part"] if "part" in rows.columns else [])).orderBy(*PLACE)


def since_start(by: WindowSpec, to: int = 0) -> WindowSpec:
    return by.rowsBetween(Window.unboundedPreceding, to)


def with_runs(rows: DataFrame) -> DataFrame:
    """goes_on: whether an entry and the one before are list items of one page; opens: whether it may start a list."""
    by = in_order(rows)
    listed, page = F.lag("listed", 1, False).over(by), F.lag("page").over(by)
    if "part" in rows.columns:
        first = F.row_number().over(by) == 1
        listed, page = F.when(first, F.col("carried.listed")).otherwise(listed), F.when(first, F.col("carried.page")).otherwise(page)
    goes_on = F.coalesce(F.col("listed") & listed & (F.col("page") == page), F.lit(False))
    return rows.withColumns({"goes_on": goes_on, "opens": F.col("listed") & ~F.col("heading")})


def with_kinds(rows: DataFrame) -> DataFrame:
    """Entries that count, with the kind of the unit that each starts or goes on with, and whether it starts one.

    Headings win over list items where a unit may start; inside a run of list items (neighbours on one page) only the list
    test counts. So a run's items belong to the list from its first item on that is no heading: from the first opening
    one at or after the run's start. All entries take part, blank ones too, since they end a run; blank and missing ones
    start nothing.
    """
    by, at = in_order(rows), F.struct(*PLACE)
    opened = F.when(F.col("opens"), at)
    rows = rows.withColumns(
        {
            "run": F.last(F.when(~F.col("goes_on"), at), ignorenulls=True).over(since_start(by)),
            "last_opened": F.last(opened, ignorenulls=True).over(since_start(by)),
            "opened_before": F.last(opened, ignorenulls=True).over(since_start(by, -1)),
        }
    )
    open_before = F.col("carried.open") if "part" in rows.columns else F.lit(False)
    since = lambda one: F.when(F.col("run").isNotNull(), F.coalesce(one >= F.col("run"), F.lit(False))).otherwise(one.isNotNull() | open_before)
    in_list, first = F.col("listed") & since(F.col("last_opened")), F.col("opens") & ~since(F.col("opened_before"))
    kind = (
        F.when(in_list, "list").when(F.col("heading"), "heading").when(F.col("is_text"), "paragraph")
        .when(F.col("found") & F.col("ref_type").isin("table", "figure"), F.col("ref_type"))
    )
    rows = rows.withColumn("kind", kind).filter("kind is not null").withColumn("starts", (F.col("kind") != "list") | first)
    return rows.drop("is_text", "heading", "listed", "goes_on", "opens", "run", "last_opened", "opened_before", "found")


def with_numbers(rows: DataFrame) -> DataFrame:
    """Entries with the number (seq) of their unit and the labels of tables and figures."""
    by, carried = in_order(rows), "part" in rows.columns
    count = lambda what, name: F.sum(F.when(what, 1).otherwise(0)).over(since_start(by)) + (F.col(f"carried.{name}") if carried else 0)
    number = lambda kind: count(F.col("kind") == kind, kind).cast("string")
    label = F.when(F.col("kind") == "table", F.concat(F.lit("Table "), number("table"))).when(F.col("kind") == "figure", F.concat(F.lit("Figure "), number("figure")))
    return rows.withColumns({"seq": count(F.col("starts"), "starts").cast("int"), "label": label})


def with_parents(rows: DataFrame) -> DataFrame:
    """Entries with the unit of the last heading before them; headings have none."""
    parent = F.last(F.when(F.col("kind") == "heading", F.col("seq")), ignorenulls=True).over(since_start(in_order(rows), -1))
    parent = F.coalesce(parent, F.col("carried.heading")) if "part" in rows.columns else parent
    return rows.withColumn("parent", parent).withColumn("parent", F.when(F.col("kind") != "heading", ldu_name(F.col("parent"))))


def in_parts(found: DataFrame) -> DataFrame:
    """Looked-up entries of long documents, stored in order, with the range of the sort in which each lies: its part."""
    return stored(tested(found).orderBy("document_id", *PLACE).withColumn("part", F.spark_partition_id()))


def carry(rows: DataFrame, ends: dict[str, Column], into: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """rows of long documents with the struct `carried`: what is open where their part begins.

    ends folds each part of a document to one row; into makes what is carried of those of the parts before, in order.
    """
    parts = rows.groupBy("document_id", "part").agg(*[value.alias(name) for name, value in ends.items()])
    before = since_start(Window.partitionBy("document_id").orderBy("part"), -1)
    table = stored(parts.select("document_id", "part", F.struct(*[value.alias(name) for name, value in into(before).items()]).alias("carried")))
    return kept(rows.drop("carried"), table, table.count(), "inner", ["document_id", "part"])


def numbered_by_parts(rows: DataFrame) -> DataFrame:
    """The steps from with_runs to with_parents over long documents, whose entries lie in parts: a prefix scan by parts.

    Each part is folded to its end: its last entry; whether a list is open; how many units, tables and figures it has; its
    last heading. The ends of a document's parts, one row each, are combined in order and carried into the parts.
    """
    at, one = F.struct(*PLACE), lambda what: F.sum(F.when(what, 1).otherwise(0))
    last, none = lambda name, by: F.last(name, ignorenulls=True).over(by), F.lit(False)
    end = lambda by: F.last("end").over(by)
    rows = carry(rows, {"end": F.max_by(F.struct("listed", "page"), at)}, lambda by: {"listed": F.coalesce(end(by)["listed"], none), "page": end(by)["page"]})
    # places are compared, so a list is open if one was opened since the last run began
    ends = {"broke": F.max(F.when(~F.col("goes_on"), at)), "opened": F.max(F.when(F.col("opens"), at))}
    is_open = lambda by: F.coalesce(last("opened", by) >= last("broke", by), last("opened", by).isNotNull())
    rows = carry(with_runs(rows), ends, lambda by: {"open": is_open(by)})
    counts = {"starts": one(F.col("starts"))} | {kind: one(F.col("kind") == kind) for kind in ("table", "figure")}
    rows = carry(with_kinds(rows), counts, lambda by: {name: F.coalesce(F.sum(name).over(by), F.lit(0)) for name in counts})
    rows = carry(with_numbers(rows), {"heading": F.max(F.when(F.col("kind") == "heading", F.col("seq")))}, lambda by: {"heading": last("heading", by)})
    return with_parents(rows)


def ldu_name(seq: Column) -> Column:
    return F.format_string("ldu_%04d", seq)


def table_text(title: Column, caption: Column, header: Column, rows: Column) -> Column:
    """Title, caption, header, a rule and the rows, as Markdown; empty parts are left out."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    some = F.size(F.coalesce(header, F.array().cast("array<string>"))) > 0
    rule = line(F.transform(header, lambda _: F.lit("---")))
    head = F.array(strip(title), strip(caption), F.when(some, line(header)).otherwise(""), F.when(some, rule).otherwise(""))
    body = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), line)
    return F.array_join(F.filter(F.concat(head, body), lambda p: p != ""), PART_JOIN)


def payload_json(payload: Column) -> Column:
    """A table's or figure's payload as JSON with sorted keys."""
    text = lambda n: F.when(F.coalesce(payload[n], F.lit("")) != "", json_string(payload[n]))
    cells = lambda a: json_list(a, json_string)
    return json_object(
        [
            ("alt_text", text("alt_text")),
            ("caption", text("caption")),
            ("header", cells(payload["header"])),
            ("label", text("label")),
            ("rows", json_list(payload["rows"], cells)),
            ("title", text("title")),
            ("type", text("type")),
        ]
    )


def cross_references(units: DataFrame) -> DataFrame:
    """document_id, seq and relationships of the units that mention tables or figures which came before them.

    units: document_id, seq, ldu_id, kind, label and text. Mentions keep their order and repeat as they do in the text.
    """
    mention = lambda what, pattern: F.transform(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(what).alias("what"), F.concat(F.lit(f"{what} "), n).alias("label"))
    )
    low = F.lower("text")
    may = F.contains(low, F.lit("table")) | F.contains(low, F.lit("figure"))
    asked = units.filter(F.col("kind").isin("paragraph", "list") & may & F.rlike("text", F.lit(r"(?i)\b(?:table|figure)\b")))
    asked = asked.select("document_id", "seq", F.posexplode(F.concat(mention("Table", TABLE_MENTION), mention("Figure", FIGURE_MENTION))).alias("n", "m"))
    targets = units.filter(F.col("label").isNotNull()).select("document_id", F.col("label"), F.col("seq").alias("target_seq"), F.col("ldu_id").alias("target"))
    found = asked.select("document_id", "seq", "n", "m.what", "m.label").join(targets, ["document_id", "label"]).filter("target_seq < seq")
    by_kind = found.groupBy("document_id", "seq", "what").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "target"))), lambda x: x["target"]).alias("targets"))
    entry = F.struct(F.concat(F.lit("references_"), F.lower("what")).alias("key"), F.col("targets").alias("value"))
    return by_kind.groupBy("document_id", "seq").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("relationships"))


def parts_of(total: int, shuffled: int) -> int:
    """How many parts so many entries are dealt into, where a shuffle has `shuffled`: the more entries the more parts, not larger ones."""
    return max(min(total // SMALL, max(shuffled, -(-total // LARGE))), 1)


def chunk(blocks: DataFrame, tables: DataFrame, figures: DataFrame, reading_order: DataFrame, long: int = LONG) -> DataFrame:
    """Logical units (see plans.schemas.LDUS), for a whole corpus at once, stored in buckets of documents."""
    return read_stored(blocks.sparkSession, chunked(blocks, tables, figures, reading_order, long))


def chunked(blocks: DataFrame, tables: DataFrame, figures: DataFrame, reading_order: DataFrame, long: int = LONG) -> str:
    """Where the units of chunk are stored.

    Entries and elements are dealt out by document once; entries are looked up, put in order and merged as they lie, and
    so are mentions and targets: what is stored on the way and in the end lies in the same buckets of documents. A
    document of more than `long` entries is dealt out by its elements and then, in order, by parts of even size, and its
    units by their numbers, so that it is the work of many tasks. The merged units are stored once: units, their mentions
    and the mentions' targets all come from them.
    """
    spark = blocks.sparkSession
    entries = given_order(blocks, reading_order)
    elements = referenced(blocks, tables, figures).withColumn("found", F.lit(True))
    counts = stored(entries.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")))
    sizes = counts.filter(F.col("n") > long).select("document_id")
    many, total = counts.agg(F.count_if(F.col("n") > long), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = parts_of(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    apart = lambda df, how: kept(df, sizes, many, how) if many else df
    short = looked_up(apart(entries, "left_anti").repartition(parts, "document_id"), apart(elements, "left_anti").repartition(parts, "document_id"))
    with dealt_by(spark):
        merged = read_stored(spark, written_by(units_of(with_parents(with_numbers(with_kinds(with_runs(tested(short)))))), "document_id", parts))
    if many:
        found = looked_up(apart(entries, "left_semi"), apart(elements, "left_semi"))
        merged = merged.unionByName(stored(units_of(numbered_by_parts(in_parts(found)))))
        # the units of a long document stay spread over the tasks that hash them
        with dealt_by(spark):
            return written(with_hashes(merged))
    with dealt_by(spark):
        return written_by(with_hashes(merged), "document_id", parts)


def looked_up(entries: DataFrame, elements: DataFrame) -> DataFrame:
    # numbers first: sorts compare names only where these agree
    entries, elements = (df.withColumn("__key", F.xxhash64("document_id", "ref_type", "ref_id")) for df in (entries, elements))
    rows = entries.join(elements, ["__key", "document_id", "ref_type", "ref_id"], "left").drop("__key").withColumn("found", F.coalesce("found", F.lit(False)))
    return rows.withColumns({"text": strip(F.col("text")), "doc": F.xxhash64("document_id")})


def units_of(rows: DataFrame) -> DataFrame:
    """One row for each unit: document_id, seq, own (its text), bbox, kind, page, label, parent and what tables and figures hold."""
    held = F.col("held")
    rendered = F.when(F.col("kind") == "table", table_text(held["title"], held["caption"], held["header"], held["rows"]))
    rendered = rendered.when(F.col("kind") == "figure", F.coalesce(F.nullif(strip(held["caption"]), F.lit("")), strip(held["alt_text"])))
    # a unit's entries are neighbours: its first one, with the parts and boxes of all, is the unit
    unit = Window.partitionBy("doc", "document_id", "seq").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"parts": F.collect_list("text").over(unit), "bbox": geometry.union_all(F.col("bbox"), unit)}).filter("starts")
    own = rendered.when(F.col("kind") == "list", F.array_join("parts", PART_JOIN)).otherwise(F.col("text"))
    return rows.select("document_id", "seq", own.alias("own"), "bbox", "kind", "page", "label", "parent", *[held[n].alias(n) for n in HELD])


def with_hashes(merged: DataFrame) -> DataFrame:
    empty_rows, empty_cells = F.array().cast("array<array<string>>"), F.array().cast("array<string>")
    is_table, is_figure = F.col("kind") == "table", F.col("kind") == "figure"
    nothing = F.lit(None).cast("string")
    given = lambda n: F.nullif(F.col(n), F.lit(""))
    payload = F.struct(
        F.when(is_table, F.coalesce("header", empty_cells)).alias("header"),
        F.when(is_table, F.coalesce("rows", empty_rows)).alias("rows"),
        F.when(is_table, given("title")).otherwise(nothing).alias("title"),
        F.when(is_table | is_figure, given("caption")).otherwise(nothing).alias("caption"),
        F.col("label").alias("label"),
        F.when(is_figure, given("alt_text")).otherwise(nothing).alias("alt_text"),
        F.when(is_figure, given("type")).otherwise(nothing).alias("type"),
        F.when(F.col("kind") == "list", F.lit(True)).alias("list_complete"),
    ).cast(PAYLOAD)
    bare_figure = is_figure & (F.col("own") == "")
    text = F.when(F.col("own") == "", F.col("label")).otherwise(F.col("own"))
    units = merged.select(
        "document_id", "seq", ldu_name(F.col("seq")).alias("ldu_id"), "kind", F.when(bare_figure, "other").otherwise(F.col("kind")).alias("content_type"),
        "label", "own", text.alias("text"), payload.alias("raw_payload"), "page", "bbox", "parent",
    )
    hashed = F.when(bare_figure, F.col("label")).otherwise(F.col("own"))
    json = F.when(is_table | is_figure, payload_json(F.col("raw_payload")))
    refs = cross_references(units)
    units = units.withColumn("json", json).join(refs, ["document_id", "seq"], "left")
    return units.select(
        "document_id", "ldu_id", "seq", "content_type", "text", "raw_payload", F.array("page").alias("page_refs"), F.array("bbox").alias("bounding_boxes"),
        F.col("parent").alias("parent_section_id"), token_count(F.when(is_table, F.col("own")).otherwise(F.col("text")), stripped=True).alias("token_count"),
        content_hash(F.col("content_type"), hashed, F.col("json"), stripped=True).alias("content_hash"),
        F.coalesce("relationships", F.create_map().cast("map<string,array<string>>")).alias("relationships"),
    )
