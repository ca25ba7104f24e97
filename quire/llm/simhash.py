"""Near-duplicates by SimHash: pigeonhole blocks find close fingerprints, their Hamming distance is verified."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import broadcast_if_small, checkpoint, looked_up
from quire.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: Fingerprints that one piece of a bucket holds; larger buckets are compared piece by piece.
PIECE = 2048
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b" \t\n\x0b\x0c\r"


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased in A-Z, in lists of about BLOCK bytes."""
    start = 0
    while len(data) - start > BLOCK:
        end = start + BLOCK
        while end < len(data) and data[end] not in SPACES:
            end += 1
        yield data[start:end].translate(LOWER).split()
        start = end
    yield data[start:].translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode()):
        words = carry + words
        if len(words) >= SHINGLE:
            h = shingle_hashes(words, SHINGLE)
            for part in np.array_split(h, len(h) // 8192 + 1):
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
            words = words[1 - SHINGLE :]
        carry = words
    if not total and carry:
        ones, total = np.unpackbits(shingle_hashes(carry, len(carry)).view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns `also` and fp (the fingerprint as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], [*names, "fp"])

    names = ["doc_id", *also]
    rows = docs.select("text", *names)
    return rows.mapInArrow(run, T.StructType([rows.schema[n] for n in names]).add("fp", "long"))


def block_count(fingerprints: int, distance: int) -> int:
    """So many blocks that a key, which has all but `distance` of them, tells this number of fingerprints apart."""
    blocks = distance + 2
    while blocks < 3 * distance and fingerprints > 1 << 64 // blocks * (blocks - distance):
        blocks += 1
    return blocks


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of all ways to keep blocks - distance blocks: two fingerprints that close agree under one of them."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(kept) for kept in combinations(parts, blocks - distance)]
    assert len(masks) == comb(blocks, distance)
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bucket_links(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join the distinct values of a bucket as all close pairs would: each value takes in the unseen near it."""
    links, unseen = [], values.copy()
    while len(unseen):
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and len(unseen):
            v = queue.pop()
            near = np.bitwise_count(unseen ^ v) <= distance
            if near.any():
                links += [(int(v), int(x)) for x in unseen[near]]
                queue += list(unseen[near])
                unseen = unseen[~near]
    return links


def bucketed_links(distance: int):
    """For mapInArrow over rows (mask, key, low, high, fp) in order of all but fp: links within each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            a, b = [fps[two]], [fps[two + 1]]
            for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
                if links := bucket_links(np.unique(fps[s:e]), distance):
                    pairs = np.array(links, np.uint64)
                    a.append(pairs[:, 0])
                    b.append(pairs[:, 1])
            a, b = (pa.array(np.concatenate(x).view(np.int64)) for x in (a, b))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        keys, fps = np.empty((0, 4), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:4]], axis=1)
            keys, fps = np.concatenate((keys, new)), np.concatenate((fps, batch.column(4).to_numpy().view(np.uint64)))
            if len(keys):  # the last bucket may go on in the next batch
                last = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
                if last:
                    yield links_of(keys[:last], fps[:last])
                    keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield links_of(keys, fps)

    return run


def close_links(distinct: DataFrame, count: int, distance: int = DISTANCE, piece: int = PIECE) -> DataFrame:
    """Rows (a, b) of fp values at most `distance` bits apart that join what all such pairs would join.

    distinct has each fp once, count is about their number. A bucket of more than `piece` members is cut into pieces by
    hash, and each pair of pieces is a bucket of its own, so that no task holds more than about two pieces and none of
    the pairs is lost. The sizes of such buckets, which are few, travel to the fingerprints, so a bucket is in pieces
    before its members meet: there is one shuffle of keys, and it deals out no large bucket by its key alone.
    """
    members = in_pieces(distinct, block_masks(block_count(count, distance), distance), piece)
    dealt = members.repartition("mask", "key", "low", "high").sortWithinPartitions("mask", "key", "low", "high")
    return dealt.mapInArrow(bucketed_links(distance), "a long, b long").distinct()


def in_pieces(distinct: DataFrame, masks: list[int], piece: int) -> DataFrame:
    """mask, key, low, high and fp: each fingerprint in the buckets of its keys, in those of a large one once for each piece."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", keys.alias("k")).select("fp", "k.mask", "k.key")
    large = checkpoint(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > piece))
    members = with_sizes(keyed, large, large.count())
    pieces = F.coalesce(F.ceil(F.col("n") / piece).cast("long"), F.lit(1).cast("long"))
    members = members.select("mask", "key", "fp", pieces.alias("pieces"))
    mine: Column = F.when(F.col("pieces") == 1, 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("pieces")))
    members = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    return members.select("mask", "key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "fp")


def with_sizes(keyed: DataFrame, large: DataFrame, count: int) -> DataFrame:
    """keyed with n, the size of its bucket if that is large. The largest buckets are broadcast, as many as may be.

    Where there are more, the others are joined by shuffling: none of them has more of all keys than the number of
    buckets that are broadcast leaves to each.
    """
    most = common.BROADCAST_ROWS
    if count <= most:
        return keyed.join(F.broadcast(large), ["mask", "key"], "left")
    top = checkpoint(large.orderBy(F.col("n").desc(), "mask", "key").limit(most))
    one = keyed.join(F.broadcast(top), ["mask", "key"], "left")
    rest = one.filter("n is null").drop("n").join(large, ["mask", "key"], "left")
    return one.filter("n is not null").unionByName(rest)


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable).

    Texts without words, null ones too, have fingerprint zero and link like any other. Rows that repeat, or share a
    doc_id, are rows of their own. A null doc_id is never a component_id unless all of the component are null. An empty
    table gives an empty result; other columns are not read.

    Equal fingerprints are one vertex, so a group of copies of any size is one row in the search; the smallest doc_id of
    each is kept by a partial aggregate.
    """
    rows = checkpoint(fingerprints(docs))
    classes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    n = classes.count()
    roots = checkpoint(components(close_links(classes.select("fp"), n, distance)))
    rooted = classes.join(roots, classes["fp"] == roots["vertex"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    # a class alone has its own id; the others' least ones are looked up by root
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    least = checkpoint(least.select("root", F.struct("least_id").alias("least")))
    of_class = looked_up(rooted, least, "root", least.count())
    of_class = checkpoint(of_class.select("fp", F.when(F.col("least").isNull(), F.col("first_id")).otherwise(F.col("least.least_id")).alias("component_id")))
    out = looked_up(rows, of_class, "fp", n)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one document of each group: the least doc_id (null last), then the least text hash; other rows go.

    A row that repeats stays once, the least by its JSON form. Columns and their order are those of docs.

    Texts aren't shuffled: the rows that go are found by id and text hash, and a set of them that is counted as small is
    broadcast; only beyond that does the anti-join deal out the documents.
    """
    text_hash = F.xxhash64("text")
    rows = checkpoint(fingerprints(docs.select("doc_id", "text", text_hash.alias("text_hash")), "text_hash"))
    classes = checkpoint(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n")))
    roots = checkpoint(components(close_links(classes.select("fp"), classes.count(), distance)).select(F.col("vertex").alias("fp"), "root"))
    rooted = looked_up(rows, roots, "fp", roots.count()).select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))
    who = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    keys = checkpoint(rooted.groupBy("root", who.alias("who")).agg(F.count(F.lit(1)).alias("copies")))
    # a document alone in its group stays, whatever the others do
    first = keys.groupBy("root").agg(F.min("who").alias("first"), F.sum("copies").alias("n")).filter("n > 1")
    first = checkpoint(first.select("root", F.struct("first").alias("group")))
    keys = looked_up(keys, first, "root", first.count()).filter("group is not null")
    keys = checkpoint(keys.select(F.col("who.doc_id").alias("__quire_id"), F.col("who.text_hash").alias("__quire_text"), (F.col("who") == F.col("group.first")).alias("stays"), "copies"))
    same = F.col("doc_id").eqNullSafe(F.col("__quire_id")) & (text_hash == F.col("__quire_text"))
    apart = keys.filter("not stays or copies > 1")
    out = docs.join(broadcast_if_small(apart, apart.count()), same, "left_anti")
    again = keys.filter("stays and copies > 1")
    if repeats := again.count():
        row = F.struct(*docs.columns)
        some = docs.join(broadcast_if_small(again, repeats), same, "left_semi")
        one = some.groupBy("doc_id", text_hash.alias("__quire_text")).agg(F.min_by(row, F.to_json(row)).alias("__quire_row"))
        out = out.unionByName(one.select("__quire_row.*"))
    return out


cloudpickle.register_pickle_by_value(sys.modules[__name__])
