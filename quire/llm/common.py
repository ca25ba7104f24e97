"""What the operators of this subpackage share: words, stable hashes, checkpoints and sizes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.storage import folder, stored

#: A word is a run of characters other than ASCII space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes that may be broadcast; beyond either the join shuffles, or goes in blocks.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: A key of more rows than this is hot: its rows don't meet in one task.
HOT = 100_000


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    """How many words a text has; the text must not be null."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash60(*cols: Column) -> Column:
    """A stable hash from 0 to 2**60-1 of the columns' text forms, which other SQL engines can compute too."""
    joined = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("long")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def byte_size(df: DataFrame, rows: int) -> int:
    """About how many bytes a counted table has: 16 a value, and what texts and nested values hold besides."""
    long = [f for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    nested = [f for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    parts = [F.octet_length(f.name) for f in long] + [F.length(F.to_json(f.name)) for f in nested]
    held = df.agg(*[F.sum(p) for p in parts]).first() if parts else ()
    return rows * 16 * len(df.columns) + sum(h or 0 for h in held)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted rows are few and their measured bytes too; without it Spark joins by shuffling."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and byte_size(df, rows) <= BROADCAST_BYTES else df


def blocks(df: DataFrame, rows: int, by: Column) -> list[DataFrame]:
    """df in blocks that may be broadcast, one after the other, dealt by the hash of `by`."""
    n = max(1, -(-rows // BROADCAST_ROWS), -(-byte_size(df, rows) // BROADCAST_BYTES))
    return [F.broadcast(df if n == 1 else df.filter(F.pmod(F.xxhash64(F.lit("block"), by), F.lit(n)) == i)) for i in range(n)]


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: int) -> DataFrame:
    """rows left-joined to a table of `count` rows with unique, non-null keys.

    A table too large for a broadcast is joined by shuffling, but for hot keys of rows: these are at most one for each
    `HOT` rows, and their part of the table is broadcast, so that the rows of one key stay where they are.
    """
    small = broadcast_if_small(table, count)
    if small is not table:
        return rows.join(small, key, "left")
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT).select(key)
    others = [c for c in table.columns if c != key]
    marked = checkpoint(hot.join(table, key, "left").select(key, F.struct(*others).alias("__found")))
    one = rows.join(F.broadcast(marked), key, "left")
    cold = one.filter("__found is null").drop("__found").join(table, key, "left")
    return one.filter("__found is not null").select(*rows.columns, "__found.*").unionByName(cold.select(*rows.columns, *others))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While this lasts, the shuffle files of each execution go when it ends; what is kept must be checkpointed or stored."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


__all__ = ["blocks", "broadcast_if_small", "checkpoint", "hash60", "looked_up", "shuffles_dropped", "stored", "text_or_empty", "word_count"]
