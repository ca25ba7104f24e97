"""Rows to learn from: a bounded, repeatable sample of labelled documents outside the held-out fold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if_small, checkpoint


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of doc_id as text, modulo folds. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


#: A text takes a fourth of the bytes that are left at most, or is passed over: no text displaces the others.
SHARE = 4
#: A sample with less than this share of its bytes left is full.
FULL = 16
#: Ids looked up at first for each row that is wanted, and how many times more if too few of them have a text.
AHEAD = 4


def fitting(rows: Iterable[tuple], count: int, size: int) -> tuple[list[tuple], int]:
    """(id, y) of the first `count` of (id, y, bytes) that fit, and the bytes left: what is too large by itself or by now is passed over."""
    kept, left = [], size
    for doc_id, y, own in rows:
        if own <= left // SHARE:
            kept.append((doc_id, y))
            left -= own
            if len(kept) == count:
                break
    return kept, left


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, size: int) -> DataFrame:
    """doc_id, text and y (0 or 1) of labelled documents for which `train` (over doc_id) holds, checkpointed.

    At most `rows` rows with at most `size` bytes of text together: ids that have a text are taken in the order of their
    hashes, so the sample is the same in each run. A text that would take more than a fourth of the bytes left is passed
    over, so none ends the sample for those behind it. Null ids, null labels and null texts are no training rows; of
    several labels of an id the largest counts, of several texts of an id the least.

    Ids are chosen from the labels first, so of documents only the chosen ones' sizes are gathered. Four ids for each
    wanted row are looked up and come to the driver with their sizes; more are only if these fill neither bound.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
    known = checkpoint(known.groupBy("doc_id").agg(F.max("y").alias("y")))
    by_hash, total, ahead = [F.xxhash64("doc_id"), F.col("doc_id")], known.count(), AHEAD * rows
    while True:
        asked = known.orderBy(*by_hash).limit(ahead)
        wanted = broadcast_if_small(asked.select("doc_id"), min(ahead, total))
        sizes = docs.filter("text is not null").select("doc_id", F.octet_length("text").alias("size")).join(wanted, "doc_id", "left_semi")
        sized = asked.join(sizes.groupBy("doc_id").agg(F.max("size").cast("long").alias("size")), "doc_id")
        picked, left = fitting(map(tuple, sized.orderBy(*by_hash).select("doc_id", "y", "size").toLocalIterator()), rows, size)
        if len(picked) >= rows or left < size // FULL or ahead >= total:
            break
        ahead *= AHEAD
    chosen = docs.sparkSession.createDataFrame(picked, known.schema)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(chosen), "doc_id")
    return checkpoint(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
