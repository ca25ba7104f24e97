"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, hash60, text_or_empty

#: The multiplier of the linear congruential generator that the paper prescribes.
LCG = 2862933555777941757
LIMB, LIMB_MASK, TOP_MASK = 22, (1 << 22) - 1, (1 << 20) - 1
#: Cells into which each shard is cut to number its rows; shards times cells bounds the broadcast table of offsets.
CELLS = 1024
#: Copies of one row that one array holds at most while they are listed again.
COPIES_AT_ONCE = 4096


def next_key(key: Column) -> Column:
    """key * LCG + 1 modulo 2**64, by limbs of 22 bits so that no product overflows a long under ANSI rules."""
    k = [key.bitwiseAND(LIMB_MASK), F.shiftrightunsigned(key, LIMB).bitwiseAND(LIMB_MASK), F.shiftrightunsigned(key, 2 * LIMB)]
    c = [F.lit(LCG & LIMB_MASK), F.lit(LCG >> LIMB & LIMB_MASK), F.lit(LCG >> 2 * LIMB)]
    low = k[0] * c[0] + F.lit(1)
    mid = k[0] * c[1] + k[1] * c[0] + F.shiftrightunsigned(low, LIMB)
    top = k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftrightunsigned(mid, LIMB)
    return (
        low.bitwiseAND(LIMB_MASK)
        .bitwiseOR(F.shiftleft(mid.bitwiseAND(LIMB_MASK), LIMB))
        .bitwiseOR(F.shiftleft(top.bitwiseAND(TOP_MASK), 2 * LIMB))
    )


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards-1, of a 64-bit key. With one more shard a key stays or moves to the new one."""

    def step(state: Column, _: Column) -> Column:
        key = next_key(state["key"])
        far = F.floor((state["next"] + 1).cast("double") * (F.lit(2.0**31) / (F.shiftrightunsigned(key, 33) + F.lit(1)).cast("double")))
        return F.when(
            state["next"] < shards,
            F.struct(key.alias("key"), state["next"].alias("at"), far.cast("long").alias("next")),
        ).otherwise(state)

    start = F.struct(key.cast("long").alias("key"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    # each step moves ahead by one shard at least, so this many steps always end
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["at"].cast("int")


def shard_of(doc_id: Column, shards: int) -> Column:
    return jump(hash60(doc_id), shards)


def assign(docs: DataFrame, shards: int = 8, name: str = "shard") -> DataFrame:
    """docs with the shard of each row in the column `name`, replacing a column of that name. No shuffle.

    A null doc_id is a key like any other. Rows with the same doc_id share a shard. An empty table stays empty.
    """
    return docs.withColumn(name, shard_of(F.col("doc_id"), shards))


def manifest(docs: DataFrame, shards: int = 8, cells: int = CELLS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is `key`: doc_id and the number of shards decide; grown_shard is where the row goes with one shard more,
    which is its shard or the new one. size is the text's UTF-8 bytes plus 1 (a null text: 1, its CRC that of an empty
    text). slot numbers the rows of a shard from 0 without gaps, by cell, doc_id, CRC and size; rows that repeat get
    slots of their own. Null ids are one key. Other columns are not read. An empty table gives an empty result.

    Rows that repeat are counted before the shuffle and listed again after it, and slots are numbered within cells of a
    shard, so that neither a hot key nor a large shard meets in one task.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("*", hash60(F.col("doc_id")).alias("key")).select(
        "*",
        jump(F.col("key"), shards).alias("shard"),
        jump(F.col("key"), shards + 1).alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(cells)).alias("cell"),
    )
    rows = checkpoint(rows)  # cells are counted first: texts are read once
    per_cell = rows.groupBy("shard", "cell").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(offsets), ["shard", "cell"])
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES_AT_ONCE).cast("long")))
    placed = placed.withColumn("from", blocks)
    block = F.sequence(F.col("from"), F.least(F.col("copies") - 1, F.col("from") + COPIES_AT_ONCE - 1))
    placed = placed.withColumn("copy", F.explode(block))
    slot = (F.col("offset") + F.col("before") + F.col("copy")).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot, "grown_shard")
