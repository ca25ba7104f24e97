"""Connected components by alternating large and small stars (Kiveris et al., 2014), as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, looked_up


def star(edges: DataFrame, large: bool, vertices: int) -> DataFrame:
    """One star operation over rows (a, b). Each vertex hangs its neighbours on the least vertex that it sees.

    The least neighbour is found by an aggregate with partial sums and looked up by vertex, hot vertices apart from the
    others, so the neighbours of one vertex never meet in one task. vertices bounds the number of rows to look up.
    """
    if large:
        ends = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    seen = looked_up(ends, least, "a", vertices)
    if large:
        hung = seen.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        hung = seen.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return hung.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """vertex and root (the least vertex of its component) for every vertex but the roots, from rows (a, b).

    Rounds end when one changes nothing; their number grows with the logarithm of the longest path. Each round is
    written to the checkpoint folder, so a lost executor costs one round at most.
    """
    now = checkpoint(edges.select("a", "b").filter("a <> b"))
    vertices, before = 2 * now.count(), None
    while True:
        now = checkpoint(star(star(now, True, vertices), False, vertices))
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = seen
