"""Mixing sources to target weights by hash thresholds, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, checkpoint, hash60, text_or_empty, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: 60 hash bits, refined by so many bits at a time; a source has at most 2**LEVEL_BITS histogram rows per level.
HASH_BITS, LEVEL_BITS = 60, 10


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and the hash that thresholds cut."""
    return docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), hash60(F.col("doc_id")).alias("h"))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with `number`, their place from 0 in this order: counted by parts of a range partitioning, not in one task."""
    placed = checkpoint(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition of the sort
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn("number", F.col("__before") + inside).drop("__at", "__part", "__before")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size and target from rows of source and size.

    Sources in code point order, null last, take the weights in turn and share `share` of all sizes. A target stops at
    `most` times its source; what is above is shared again by weight. That settles at one level: each target is the
    lesser of weight times level and its cap. Each round takes the sources that the last level puts above their caps out
    of the sharing, which raises the level, until it puts no more there.
    """
    per_source = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    caps = checkpoint(per_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap")))
    budget = (caps.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("cap")
        part = F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)
        full, open_weight, now = caps.agg(*part).first()
        if now == capped or not open_weight:
            break
        level, capped = (budget - full) / open_weight, now
    target = F.col("cap") if not open_weight else F.least(F.col("weight") * F.lit(level), F.col("cap"))
    return caps.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, sources: int) -> DataFrame:
    """source, source_size, target, whole and below: each document is taken `whole` times, and once more if h < below.

    sources is the number of rows of goals; so many rows are broadcast if they are few, else the joins shuffle.

    `below` is found by nested histograms: words by source and hash bucket, the running sum finds the bucket in which
    the rest of the target ends, and only the rows of that bucket are counted again by the next bits. At the last bits
    the hash on whose side the sum is nearer to the target decides (the lower one in a tie).

    A source whose rest is 0 gives nothing more, also not of its documents without words. Each level's row for each
    source is checkpointed, so that a level's plan has that level alone.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = goals.select("source", "source_size", "target", whole.alias("whole"))
    at = at.select("*", (F.col("target") - F.col("source_size") * F.col("whole")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    at = at.withColumn("more", F.col("rest") > 0)
    for bits in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright(F.col("h"), bits)
        inside = sizes.join(
            broadcast_if_small(at.filter("more").select(F.col("source").alias("at_source"), F.col("prefix")), sources),
            F.col("source").eqNullSafe(F.col("at_source")) & (F.shiftright(F.col("h"), bits + LEVEL_BITS) == F.col("prefix")),
        )
        counts = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket")
        counts = counts.select(F.col("source").alias("c_source"), "bucket", "words", (F.sum("words").over(upto) - F.col("words")).alias("before"))
        # the last bucket that starts at or below the rest; every bucket before it is taken whole
        near = counts.join(broadcast_if_small(at.select(F.col("source").alias("n_source"), "rest"), sources), F.col("c_source").eqNullSafe(F.col("n_source")))
        last = near.filter(F.col("before") <= F.col("rest")).groupBy("c_source").agg(F.max(F.struct("bucket", "before", "words")).alias("last"))
        grouped = at.join(broadcast_if_small(last, sources), F.col("source").eqNullSafe(F.col("c_source")), "left")
        same = ["source", "source_size", "target", "whole", "more"]
        if bits:
            rest = F.col("rest") - F.coalesce(F.col("last.before"), F.lit(0))
            at = checkpoint(grouped.select(*same, rest.alias("rest"), F.coalesce(F.col("last.bucket"), F.lit(0)).cast("long").alias("prefix")))
        else:
            rest = F.col("rest") - F.col("last.before")
            nearer = F.col("last.words") - rest < rest
            below = F.when(F.col("more"), F.col("last.bucket") + F.when(nearer, 1).otherwise(0))
            at = checkpoint(grouped.select("source", "source_size", "target", "whole", F.coalesce(below, F.lit(0)).cast("long").alias("below")))
    return at


def planned(docs: DataFrame, weights: Sequence[int], share: float, most: float) -> tuple[DataFrame, DataFrame, int]:
    """The sizes, the thresholds (a row for each source) and the number of sources."""
    sizes = checkpoint(sized(docs))
    goals = checkpoint(targets(sizes, weights, share, most))
    sources = goals.count()
    return sizes, thresholds(sizes, goals, sources), sources


def copies(h: Column) -> Column:
    """How often a row is taken, beside its source's columns `whole` and `below`."""
    return F.col("whole") + F.when(h < F.col("below"), 1).otherwise(0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    taken is size times copies (0, 1 or 2 with the default `most`, for documents without words too). A null text has size
    0; a null source is a source, last in order; a source without words gives nothing. Rows with one doc_id share a hash
    and are taken alike. Reruns agree, since only doc_id and the sizes decide. An empty table gives an empty result;
    other columns are not read.

    The text is read once, into a checkpoint of four small columns, which every level of the histogram reads. Sums are
    partial before each shuffle, so that a hot source costs no more than another.
    """
    sizes, plan, sources = planned(docs, weights, share, most)
    rows = sizes.join(broadcast_if_small(plan.withColumnRenamed("source", "plan_source"), sources), F.col("source").eqNullSafe(F.col("plan_source")))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("h"))).alias("taken"), copies(F.col("h")).alias("copies")
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of docs and no others.

    Null and empty texts have no words; they come as often as other documents with such a hash, and not at all if their
    source has no words or its rest is 0. Null ids share a hash, and rows that repeat are taken alike. An empty table
    stays empty.
    """
    _, plan, sources = planned(docs, weights, share, most)
    plan = broadcast_if_small(plan.select(F.struct("source", "whole", "below").alias("__quire_plan")), sources)
    h = hash60(F.col("doc_id"))
    taken = F.col("__quire_plan.whole") + F.when(h < F.col("__quire_plan.below"), 1).otherwise(0)
    rows = docs.join(plan, F.col("source").eqNullSafe(F.col("__quire_plan.source")))
    rows = rows.withColumn("__quire_copy", F.explode(F.array_repeat(F.lit(0), taken.cast("int"))))
    return rows.select(*docs.columns)
