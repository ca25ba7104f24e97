"""The trie of conversations' prefixes: sorted turn arrays, longest common prefixes of neighbours, and a sweep with a stack."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import looked_up, stored, word_count

#: Bytes that stand for a turn in a conversation's key.
WIDTH = 16
#: Ids that one row holds at most where a group of equal conversations goes on beyond a partition, and rows of a batch.
IDS, BATCH = 65_536, 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: What a sweep gives: `node` whole ones, `open` parts of those on the path of a partition's first or last row, `path` these
#: paths, `ends` ids of groups that may go on in the neighbour. spine: F for the first row's path, L for the last one's.
SWEPT = pa.schema(
    [("kind", pa.string()), ("part", pa.int64()), ("spine", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64())]
    + [("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()), ("seq", pa.int64()), ("ids", pa.string())]
    + [("first_key", pa.binary()), ("last_key", pa.binary())]
)
SWEPT_TYPE = (
    "kind string, part long, spine string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, "
    "ends_sha256 string, seq long, ids string, first_key binary, last_key binary"
)
#: What the stitching gives: `node` as above with its number, and `ref`: the number and conv_id of the node that a part belongs to.
STITCHED_TYPE = SWEPT_TYPE.split(", seq")[0] + ", node long"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of turn, digest (of role and text) and words.

    Texts are digested where they lie: 16 bytes a turn are shuffled. Turns come null first; ties by digest.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest, word_count(text).alias("words")).alias("turn"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, key (the digests one after the other) and words of every conversation c, rebuilt.

    It is the first h turns of conversation c - c % group, then c's own after its first h; h is CRC-32(c) % shared.
    """
    convs = stored(turn_arrays(turns))
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, shared).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    rows = convs.select("conv_id", base.alias("base"), h.alias("h"), "turns").join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    whole = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    rows = rows.select("conv_id", whole.alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return rows.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two keys share."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size))) // WIDTH


class Open:
    """A node whose subtree is still being swept. What its closed children have given is added up in it.

    first: it is on the path of the partition's first row. kids: rows of closed children, until their parent is known.
    """

    __slots__ = ("children", "conv_id", "ends", "first", "kids", "leaves", "n", "saved", "words")

    def __init__(self, words: int, first: bool):
        self.words, self.first = words, first
        self.conv_id, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.kids = array("q"), []

    def add(self, conv_id: int | None, n: int) -> None:
        self.n += n
        if conv_id is not None and (self.conv_id is None or conv_id < self.conv_id):
            self.conv_id = conv_id


def slices(ids: array) -> Iterator[str]:
    for k in range(0, len(ids), IDS):
        yield ",".join(map(str, ids[k : k + IDS]))


def hashed(texts: Iterable[str]) -> str:
    """SHA-256 of texts joined by commas."""
    state, comma = hashlib.sha256(), b""
    for text in texts:
        state.update(comma + text.encode())
        comma = b","
    return state.hexdigest()


class Sweep:
    """Rows of one partition in the order of their keys: `rows` has what is known so far."""

    def __init__(self, part: int):
        self.part, self.stack, self.rows = part, [], []
        self.first_key = self.last_key = None

    def take(self, key: bytes, words: list[int], conv_id: int) -> None:
        if self.last_key is None:
            self.first_key = key
            self.stack.append(Open(0, True))
        elif key != self.last_key:
            shared = common_turns(self.last_key, key)
            while len(self.stack) - 1 > shared:
                self.close()
        first = self.last_key is None
        for depth in range(len(self.stack), len(key) // WIDTH + 1):
            self.stack.append(Open(words[depth - 1], first))
        self.stack[-1].add(conv_id, 1)
        self.stack[-1].ends.append(conv_id)
        self.last_key = key

    def close(self) -> None:
        """The deepest node is whole, unless it is on the first row's path: then the partition before may have a part of it."""
        depth, node = len(self.stack) - 1, self.stack.pop()
        if node.first:
            self.leave_open(depth, node, "F")
            return
        leaves, saved = node.leaves if node.children else 1, node.saved + (node.n - 1) * node.words
        for row in node.kids:
            self.rows.append(row | {"parent_conv_id": node.conv_id})
        row = {"kind": "node", "depth": depth, "conv_id": node.conv_id, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": hashed(slices(node.ends))}
        parent = self.stack[-1]
        parent.add(node.conv_id, node.n)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        if parent.first:
            self.rows.append(row | {"part": self.part, "spine": "F"})
        else:
            parent.kids.append(row)

    def leave_open(self, depth: int, node: Open, spine: str, at_end: bool = False) -> None:
        row = {"part": self.part, "spine": spine, "depth": depth}
        self.rows += [kid | {"part": self.part, "spine": spine} for kid in node.kids]
        goes_on = node.ends and (node.first or at_end)
        whole = NO_ENDS if goes_on else hashed(slices(node.ends))
        own = {"conv_id": node.conv_id, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "words": node.words, "ends_sha256": whole}
        self.rows.append(row | {"kind": "open"} | own)
        if goes_on:
            self.rows += [row | {"kind": "ends", "seq": k, "ids": text} for k, text in enumerate(slices(node.ends))]

    def end(self) -> None:
        last = len(self.stack) - 1
        for depth, node in enumerate(self.stack):
            self.leave_open(depth, node, "F" if node.first else "L", depth == last)
        still = sum(node.first for node in self.stack) - 1
        self.rows.append({"kind": "path", "part": self.part, "depth": still, "first_key": self.first_key, "last_key": self.last_key})


def record(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, words, conv_id and part of one partition, sorted by key and conv_id, to rows of SWEPT."""
    sweep = None
    for batch in batches:
        columns = [batch.column(n) for n in ("key", "words", "conv_id", "part")]
        for key, words, conv_id, part in zip(*[c.to_pylist() for c in columns], strict=True):
            sweep = sweep or Sweep(part)
            sweep.take(key, words, conv_id)
            if len(sweep.rows) >= BATCH:
                yield record(sweep.rows, SWEPT)
                sweep.rows = []
    if sweep:
        sweep.end()
        for k in range(0, len(sweep.rows), BATCH):
            yield record(sweep.rows[k : k + BATCH], SWEPT)


class Stitch:
    """The open paths of all partitions, one after the other, on one stack: parts of one node are put together."""

    def __init__(self):
        self.nodes, self.stack, self.refs = [], [], []

    def put(self, depth: int, row: dict) -> None:
        """A part of the node at this depth, or a new node."""
        if depth == len(self.stack):
            node = {"depth": depth, "parent": self.stack[-1] if depth else None, "conv_id": None, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "words": row["words"], "ends_sha256": NO_ENDS}
            self.stack.append(len(self.nodes))
            self.nodes.append(node)
        node = self.nodes[self.stack[depth]]
        for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            node[name] += row[name]
        node["conv_id"] = min((x for x in (node["conv_id"], row["conv_id"]) if x is not None), default=None)
        if row["ends_sha256"] != NO_ENDS:
            node["ends_sha256"] = row["ends_sha256"]
        self.refs.append((row["part"], row["spine"], depth, self.stack[depth]))

    def close_to(self, depth: int) -> None:
        while len(self.stack) - 1 > depth:
            node = self.nodes[self.stack.pop()]
            node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["words"]
            if self.stack:
                parent = self.nodes[self.stack[-1]]
                for name in ("n_convs", "n_leaves", "saved_tokens"):
                    parent[name] += node[name]
                parent["n_children"] += 1
                parent["conv_id"] = min((x for x in (parent["conv_id"], node["conv_id"]) if x is not None), default=None)


STITCHED = pa.schema([f for f in SWEPT if f.name not in ("seq", "ids", "first_key", "last_key")] + [("node", pa.int64())])


def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All `path` and `open` rows, by part, `path` first, then by depth: as rows of STITCHED.

    A partition gives as many rows as its first and its last conversation have turns, whatever else it holds.
    """
    stitch, last, still = Stitch(), None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == "path":
                if last is not None:
                    stitch.close_to(common_turns(last, row["first_key"]))
                last, still = row["last_key"], row["depth"]
                continue
            if row["spine"] == "L":
                stitch.close_to(max(still, row["depth"] - 1))
            stitch.put(row["depth"], row)
        # rows of the first path go before those of the last one
    stitch.close_to(-1)
    made = [n | {"kind": "node", "node": k, "parent_conv_id": None if n["parent"] is None else stitch.nodes[n["parent"]]["conv_id"]} for k, n in enumerate(stitch.nodes)]
    made += [{"kind": "ref", "part": part, "spine": spine, "depth": depth, "node": k, "conv_id": stitch.nodes[k]["conv_id"]} for part, spine, depth, k in stitch.refs]
    for k in range(0, len(made), BATCH):
        yield record(made[k : k + BATCH], STITCHED)


def long_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, part, seq and ids, sorted: one hash for each node. Only the state of one is held."""
    schema = pa.schema([("node", pa.int64()), ("whole", pa.string())])
    at, state = None, None
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == at:
                state.update(b"," + ids.encode())
                continue
            if state:
                yield record([{"node": at, "whole": state.hexdigest()}], schema)
            at, state = node, hashlib.sha256(ids.encode())
    if state:
        yield record([{"node": at, "whole": state.hexdigest()}], schema)


def trie(turns: DataFrame, group: int = 20, shared: int = 4) -> DataFrame:
    """The nodes of the trie of all conversations, rebuilt (see `rebuilt`), from conv_id, turn, role and text.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (of the
    subtree), saved_tokens (of the subtree: each node's members but one, times the words of its last text) and
    ends_sha256 (of the ids of members that end here, ascending, joined by commas).

    Null roles and texts are empty, null turns come first, turns of one number by their digests, repeated rows are turns
    of their own. Rows without a conv_id belong to no conversation. Other columns are not read. An empty table has no
    members, so no root either: it stays empty.

    Conversations are sorted over all partitions by their turns' digests and by id, so equal ones are dealt out over
    partitions too. Each partition is swept once; nodes that may go on in a neighbour, those on its first and last path,
    are stitched from a few rows a partition. A conversation is one row of 24 bytes a turn.
    """
    rows = stored(rebuilt(turns, group, shared))
    placed = rows.orderBy("key", "conv_id").withColumn("part", F.spark_partition_id().cast("long"))
    found = stored(placed.select("key", "words", "conv_id", "part").mapInArrow(swept, SWEPT_TYPE))
    spine = found.filter(F.col("kind").isin("path", "open")).repartition(1).sortWithinPartitions("part", F.col("kind").desc(), "spine", "depth")
    parts = stored(spine.mapInArrow(stitched, STITCHED_TYPE))
    refs = parts.filter("kind = 'ref'").select("part", "spine", "depth", "node", F.col("conv_id").alias("of"))
    ends = found.filter("kind = 'ends'").join(refs, ["part", "spine", "depth"]).select("node", "part", "seq", "ids")
    whole = ends.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(long_ends, "node long, whole string")
    own = parts.filter("kind = 'node'").join(whole, "node", "left").withColumn("ends_sha256", F.coalesce("whole", "ends_sha256"))
    nodes = found.filter("kind = 'node'")
    inner = nodes.filter("part is null")
    hanging = nodes.filter("part is not null").withColumn("at", under(F.col("part"), F.col("spine"), F.col("depth") - 1))
    parents = refs.select(under(F.col("part"), F.col("spine"), F.col("depth")).alias("at"), "of")
    hanging = looked_up(hanging, parents, "at", parents.count()).withColumn("parent_conv_id", F.col("of"))
    return inner.select(*RESULT).unionByName(hanging.select(*RESULT)).unionByName(own.select(*RESULT))


def under(part: Column, spine: Column, depth: Column) -> Column:
    return F.concat_ws(":", part.cast("string"), spine, depth.cast("string"))
