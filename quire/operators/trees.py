"""Section trees: nested JSON read level by level, and rules of trees by closing chains of parents."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.plans.storage import stored

#: Fields of a section besides its id, owner and children, and their types.
FIELDS = {
    "title": "string", "level": "int", "page_start": "int", "page_end": "int", "key_entities": "array<string>", "summary": "string", "data_types_present": "array<string>",
    "ldu_ids": "array<string>",
}
#: Sections are nested so deep at most; a deeper tree is an error, not cut.
DEEPEST = 1000


def field(name: str, kind: str) -> Column:
    found = F.try_variant_get("node", f"$.{name}", kind)
    missing = {"title": F.lit(""), "level": F.lit(0)} | {n: F.array().cast(k) for n, k in FIELDS.items() if k.startswith("array")}
    return F.coalesce(found, missing[name]) if name in missing else found


def sections(trees: DataFrame) -> DataFrame:
    """The sections of nested trees (tree: JSON of one index a document, as sinks.index_trees writes it), flat.

    document_id (of the tree), section_id, parent_id (null for the root), n (-1 for the root, else the place from 0, parents
    before children and these in their order), owner (the section's own document_id), path (places among siblings), and
    the fields of a section: missing texts and lists are empty, a missing level is 0. What is no JSON, or has no root,
    gives nothing.

    A tree is walked level by level: a round for each level explodes the children of all sections of all trees.
    """
    parsed = trees.select(F.try_parse_json("tree").alias("v")).filter("v is not null")
    root = F.try_variant_get("v", "$.root", "variant")
    level = parsed.select(F.try_variant_get("v", "$.document_id", "string").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.array().cast("array<int>").alias("path"), root.alias("node"))
    found = []
    # a node is taken apart once: its fields are stored, and of what is in it the children alone
    own = [field(name, kind).alias(name) for name, kind in FIELDS.items()]
    is_section = F.try_variant_get("node", "$", "struct<id:variant>").isNotNull()
    for _ in range(DEEPEST):
        told = ["parent_id", "path", F.try_variant_get("node", "$.document_id", "string").alias("owner"), *own, F.try_variant_get("node", "$.child_sections", "variant").alias("children")]
        level = stored(level.filter(is_section).select("document_id", F.try_variant_get("node", "$.id", "string").alias("section_id"), *told))
        if level.isEmpty():
            break
        found.append(level.drop("children"))
        children = F.posexplode(F.try_variant_get("children", "$", "array<variant>")).alias("pos", "node")
        level = level.filter("children is not null").select("document_id", F.col("section_id").alias("parent_id"), "path", children)
        level = level.select("document_id", "parent_id", F.concat("path", F.array("pos")).alias("path"), "node")
    else:
        raise ValueError(f"a tree has more than {DEEPEST} levels")
    if not found:
        names = ("document_id string", "section_id string", "parent_id string", "n int", "path array<int>", "owner string")
        return trees.sparkSession.createDataFrame([], ", ".join([*names, *[f"{n} {k}" for n, k in FIELDS.items()]]))
    # arrays are ordered by their elements, a shorter one before those that go on from it: parents before children
    number = (F.row_number().over(Window.partitionBy("document_id").orderBy("path")) - 2).cast("int")
    return reduce(DataFrame.unionByName, found).select("document_id", "section_id", "parent_id", number.alias("n"), "path", "owner", *FIELDS)


def tree_errors(sections: DataFrame) -> DataFrame:
    """tree_id, section_id and rule, from tree_id, section_id, parent_id (null for a root) and owner (the section's own document).

    orphan: the chain of parents ends at one that isn't there; cycle: it never ends; foreign: the owner is another than
    that of the root at its end. Chains are closed by pointer jumping: after each round a pointer reaches twice as far,
    so a tree of n sections needs log2(n) rounds however deep it is. Sections that repeat count once, the one of the
    least parent and owner.
    """
    rows = stored(sections.groupBy("tree_id", "section_id").agg(F.min(F.struct(F.col("parent_id").isNotNull().alias("inner"), "parent_id", "owner")).alias("s")).select("tree_id", "section_id", "s.parent_id", "s.owner"))
    most = rows.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    # a root points to itself
    state = rows.select("tree_id", "section_id", F.coalesce("parent_id", "section_id").alias("up"))
    for _ in range(ceil(log2(most + 1)) if most else 0):
        further = state.select("tree_id", F.col("section_id").alias("up"), F.col("up").alias("next"))
        state = stored(state.join(further, ["tree_id", "up"], "left").select("tree_id", "section_id", F.coalesce("next", "up").alias("up")))
    ends = rows.select("tree_id", F.col("section_id").alias("up"), F.struct(F.col("parent_id").isNull().alias("root"), "owner").alias("end"))
    closed = rows.join(state, ["tree_id", "section_id"]).join(ends, ["tree_id", "up"], "left")
    rule = F.when(F.col("end").isNull(), "orphan").when(~F.col("end.root"), "cycle").when(~F.col("owner").eqNullSafe(F.col("end.owner")), "foreign")
    return closed.select("tree_id", "section_id", rule.alias("rule")).filter("rule is not null")
