"""Line deduplication by an exact set-similarity join: rare tokens first, prefix, positional and length filters."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import common
from quire.llm.common import BROADCAST_ROWS, blocks, broadcast_if_small, checkpoint, shuffles_dropped, stored

JACCARD = 0.8
#: Counters of the sketch that orders tokens by rarity, and how many of them travel in one row.
SKETCH, CHUNK = 1 << 21, 1 << 13
#: Sets of lines that may share a prefix token before they are compared piece by piece, and tokens that may be cut so.
PIECE, HEAVY = 4096, 1_000_000
#: In how many turns tokens are dealt out to find candidates.
TURNS = 4
#: Bytes of text that are cut into tokens at once (so that arrays stay in a processor's cache), and tokens that are grouped to lines at once.
BLOCK, TOKENS = 1 << 16, 250_000
#: Tokens of more bytes than this are hashed one by one.
LONG = 1 << 16
#: Lines, and postings of prefix tokens, that a task gathers before it sends them on.
LINES_AT_ONCE, POSTINGS_AT_ONCE = 200_000, 500_000
#: Postings that a task compares.
PART = 400_000
#: Kinds of rows of the table of lines: the first line of its set in its task, a later one, and a document's count.
FIRST, AGAIN, COUNT = 0, 1, 2
#: A posting as it travels: bucket and size to sort by, the set, a bound of its order, its bitmaps, its size, and its place in the prefix with flags.
POSTING = np.dtype([("key", "<u8"), ("k1", "<i8"), ("doc", "<i8"), ("b1", "<u8"), ("b2", "<u8"), ("size", "<u4"), ("place", "<u4")])
SECOND, SPLIT, ASKS, PLACE = 1 << 31, 1 << 30, 1 << 29, (1 << 29) - 1
SIZE_BITS = 20
EPS = 1e-9
BREAK = re.compile(rb"[\t-\r ]")
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
NONE = np.uint64((1 << 64) - 1)
BASE = 0x9E3779B97F4A7C15
#: Widths to which lines are padded, so that lines of like length are sorted as rows of one matrix.
WIDTHS = np.array([2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 2048, 4096])


def powers(factor: int, n: int) -> np.ndarray:
    """factor**0, factor**1, ... modulo 2**64."""
    found = np.full(n, factor, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


class Tokens:
    """Cuts text into tokens and hashes them, whole blocks at a time.

    A token is a run of bytes other than ASCII white space of the lower-case text. Its hash is a polynomial of its bytes
    modulo 2**64, which differences of running sums give for all tokens of a block at once, and which is then mixed.
    """

    def __init__(self):
        self.up, self.down = powers(BASE, BLOCK + LONG), powers(pow(BASE, -1, 1 << 64), BLOCK + LONG)

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens, and for each how many line ends are before it."""
        b = np.frombuffer(data, np.uint8)
        word = np.concatenate(([False], ~IS_SPACE[b], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[: len(b)])))
        h = (sums[ends] - sums[starts]) * self.down[starts]
        h ^= (ends - starts).astype(np.uint64) << np.uint64(48)
        h = mix(h)
        for i in np.flatnonzero(ends - starts > LONG):
            h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
        return h, np.searchsorted(np.flatnonzero(b == 10), starts)

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes, places in the list and line numbers of the texts' tokens, in order; short texts share a block."""
        waiting: list[bytes] = []
        first = size = 0
        for i, text in enumerate(texts):
            data = (text or "").lower().encode("utf-8", "surrogatepass")
            if waiting and size + len(data) > BLOCK:
                yield self.together(waiting, first)
                waiting, size = [], 0
            if len(data) > BLOCK:
                hashes, lines = self.long(data)
                yield hashes, np.full(len(hashes), i), lines
                continue
            first = first if waiting else i
            waiting.append(data)
            size += len(data) + 1
        if waiting:
            yield self.together(waiting, first)

    def together(self, texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, line = self.block(b"\n".join(texts))
        starts = np.cumsum([0, *[t.count(b"\n") + 1 for t in texts]])
        owner = np.searchsorted(starts, line, side="right") - 1
        return hashes, owner + first, line - starts[owner]

    def long(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and line numbers of a text's tokens, block by block."""
        hashes, lines, start, line = [], [], 0, 0
        while start < len(data):
            end, long = len(data), None
            if end - start > BLOCK + LONG:
                found = BREAK.search(data, start + BLOCK)
                end = found.start() if found else len(data)
                if end - start > BLOCK + LONG:  # a token too long for a block: it ends at `end`
                    long = max(start, max(data.rfind(s, start, start + BLOCK) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1)
            upto = end if long is None else long
            h, n = self.block(data[start:upto])
            hashes.append(h)
            lines.append(n + line)
            line += data.count(b"\n", start, upto)
            if long is not None:
                hashes.append(np.array([xxhash.xxh64_intdigest(data[long:end])], np.uint64))
                lines.append(np.array([line]))
            start = end
        return np.concatenate(hashes), np.concatenate(lines)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def prefix_length(size: np.ndarray, least: float) -> np.ndarray:
    """So many of the rarest tokens that two sets this similar share one of them."""
    return (size - np.ceil(size * least - EPS) + 1).astype(np.int64)


def summed_sketch(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Counts by bucket of the hashes that `count` gives for a task's batches.

    Each task sends its counters in chunks; chunks are summed as they stream past, and SKETCH counters reach the driver.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, np.int64)
        for hashes in count(batches):
            counters += np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        chunks = np.flatnonzero(counters.reshape(-1, CHUNK).any(axis=1))
        parts = [small(counters[c * CHUNK : (c + 1) * CHUNK]) for c in chunks]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def small(counters: np.ndarray) -> bytes:
        return np.minimum(counters, (1 << 31) - 1).astype(np.int32).tobytes()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(CHUNK, np.int64)
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if chunk != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([small(total)], pa.binary())], ["chunk", "counts"])
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                total = total + np.frombuffer(counts.as_py(), np.int32)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([small(total)], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = rows.mapInArrow(tasks, schema).repartition("chunk").sortWithinPartitions("chunk").mapInArrow(sums, schema)
    sketch = np.zeros((SKETCH // CHUNK, CHUNK), np.int32)
    for row in summed.collect():
        sketch[row["chunk"]] = np.frombuffer(row["counts"], np.int32)
    return sketch.reshape(-1)


def text_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    cut, waiting = Tokens(), []
    for batch in batches:
        for hashes, _, _ in cut.of(batch.column(0).to_pylist()):
            waiting.append(hashes)
            if sum(map(len, waiting)) > 4 * TOKENS:
                yield np.concatenate(waiting)
                waiting = []
    if waiting:
        yield np.concatenate(waiting)


def line_sets(hashes: np.ndarray, starts: np.ndarray, scale: np.ndarray, least: float) -> dict[str, np.ndarray | pa.Array]:
    """Of lines that begin at `starts` among the hashes of their tokens: size, k1, k2, b1, b2 (a bitmap), and their prefixes.

    scale gives the rarity of each hash bucket. A token's rank has 16 bits of it and 48 of its hash; equal tokens have
    equal ranks, and a line's prefix are its least. k1 and k2 are sums over the whole hashes of distinct tokens.
    """
    lengths = np.diff(np.concatenate((starts, [len(hashes)])))
    ranks = scale[(hashes % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16)
    n = len(starts)
    size = np.zeros(n, np.int64)
    k1, k2, b1, b2 = np.zeros((4, n), np.uint64)
    prefixes: list[tuple[np.ndarray, np.ndarray]] = []
    width = WIDTHS[np.minimum(np.searchsorted(WIDTHS, lengths), len(WIDTHS) - 1)]
    groups = [(int(w), np.flatnonzero((width == w) & (lengths <= WIDTHS[-1]))) for w in np.unique(width)]
    groups += [(int(lengths[i]), np.array([i])) for i in np.flatnonzero(lengths > WIDTHS[-1])]
    for w, rows in groups:
        for s in range(0, len(rows), max(1, TOKENS // w)):
            own = rows[s : s + max(1, TOKENS // w)]
            column = np.arange(w)[None, :]
            inside = column < lengths[own][:, None]
            at = np.minimum(starts[own][:, None] + column, len(ranks) - 1)
            table, whole = np.where(inside, ranks[at], NONE), hashes[at]
            table.sort(axis=1)
            if (again := ((table[:, 1:] == table[:, :-1]) & (table[:, 1:] != NONE)).any(axis=1)).any():
                # each token once, by its whole hash; two tokens of one rank stay two
                part = np.where(inside[again], whole[again], NONE)
                part.sort(axis=1)
                part[:, 1:][part[:, 1:] == part[:, :-1]] = NONE
                part.sort(axis=1)
                inside[again], whole[again] = part != NONE, part
                rank = scale[(part % np.uint64(SKETCH)).astype(np.int64)].astype(np.uint64) << np.uint64(48) | part >> np.uint64(16)
                table[again] = np.sort(np.where(part != NONE, rank, NONE), axis=1)
            mixed = mix(whole)
            size[own] = inside.sum(axis=1)
            k1[own] = np.where(inside, mixed, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            k2[own] = np.where(inside, mix(mixed ^ np.uint64(BASE)), np.uint64(0)).sum(axis=1, dtype=np.uint64)
            bit = np.where(inside, np.uint64(1) << (mixed >> np.uint64(58)), np.uint64(0))
            odd = mixed & np.uint64(1) == 1
            b1[own] = np.bitwise_or.reduce(np.where(odd, bit, np.uint64(0)), axis=1)
            b2[own] = np.bitwise_or.reduce(np.where(odd, np.uint64(0), bit), axis=1)
            first = prefix_length(size[own], least)
            kept = column < first[:, None]
            prefixes.append((np.repeat(own, first), table[kept]))
    owner = np.concatenate([o for o, _ in prefixes])
    values = np.concatenate([v for _, v in prefixes])
    by_line = np.argsort(owner, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return {"size": size, "k1": k1, "k2": k2, "b1": b1, "b2": b2, "prefix": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[by_line].view(np.int64)))}


def packed(prefix: pa.ListArray) -> pa.BinaryArray:
    """A column of prefixes with the ranks of each as 8 bytes, which travel at less cost than a list's items."""
    offsets = (prefix.offsets.to_numpy() * 8).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(prefix), [None, pa.py_buffer(offsets), pa.py_buffer(prefix.values.to_numpy().astype("<i8"))])


def known_in_task(rows: pa.Table) -> pa.Table:
    """rows with `kind`, FIRST for the earliest line of each set and AGAIN for the others; a line that repeats stays once."""
    k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
    by_set = np.lexsort((k2, k1))
    same = (k1[by_set][1:] == k1[by_set][:-1]) & (k2[by_set][1:] == k2[by_set][:-1])
    several = np.zeros(len(k1), bool)
    several[by_set[1:][same]] = several[by_set[:-1][same]] = True
    kind = pa.array(np.full(len(k1), FIRST, np.int8))
    rows = rows.append_column("kind", kind)
    if not several.any():
        return rows
    one, more = rows.filter(pa.array(~several)), rows.filter(pa.array(several))
    keys = ("k1", "k2", "doc_id", "text_hash", "line")
    more = more.take(pa.compute.sort_indices(more.select(keys), sort_keys=[(c, "ascending") for c in keys], null_placement="at_end"))
    k1, k2, text, line = (more.column(c).to_numpy() for c in ("k1", "k2", "text_hash", "line"))
    ids = more.column("doc_id").combine_chunks()
    before, after = ids.slice(0, len(ids) - 1), ids.slice(1)
    alike = pa.compute.or_kleene(pa.compute.equal(before, after), pa.compute.and_(before.is_null(), after.is_null())).fill_null(False)
    own_set = np.concatenate(([False], (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])))
    repeated = own_set.copy()
    repeated[1:] &= alike.to_numpy(zero_copy_only=False) & (text[1:] == text[:-1]) & (line[1:] == line[:-1])
    more = more.set_column(more.column_names.index("kind"), "kind", pa.array(np.where(own_set, AGAIN, FIRST).astype(np.int8)))
    none = pa.scalar(None, pa.binary())
    more = more.set_column(more.column_names.index("prefix"), "prefix", pa.compute.if_else(pa.array(own_set), none, more.column("prefix").combine_chunks()))
    return pa.concat_tables([one, more.filter(pa.array(~repeated))])


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], tokens: int = TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of tokens put together until they have so many. A document's tokens stay in one part, so a line is never cut."""
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for part in parts:
        if len(part[0]):
            waiting.append(part)
        if sum(len(w[0]) for w in waiting) >= tokens:
            yield tuple(np.concatenate([w[i] for w in waiting]) for i in range(3))
            waiting = []
    if waiting:
        yield tuple(np.concatenate([w[i] for w in waiting]) for i in range(3))


def occurrences(docs: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """A row for each line with tokens: doc_id, text_hash, line, k1 and k2 (the set's hash), size, b1, b2, prefix and kind.

    Lines that a task has seen in an earlier line are AGAIN, so of a line that is everywhere each task sends on but a
    few. A row of kind COUNT has a document's number of lines with tokens as its size.
    """
    scale = (np.log2(sketch.astype(np.float64) + 1) * 1024).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, rarity = Tokens(), scale
        waiting: list[pa.RecordBatch] = []

        def table(ids: pa.RecordBatch, line, made: dict, kind: int | None = None) -> pa.RecordBatch:
            columns = [*ids.columns, pa.array(line.astype(np.int32))]
            columns += [pa.array(made[c].view(np.int64)) for c in ("k1", "k2")] + [pa.array(made["size"].astype(np.int32))]
            columns += [pa.array(made[c].view(np.int64)) for c in ("b1", "b2")] + [made["prefix"] if kind == COUNT else packed(made["prefix"])]
            if kind is None:
                return pa.RecordBatch.from_arrays(columns, names[:-1])
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(ids), kind, np.int8))], names)

        def out() -> Iterator[pa.RecordBatch]:
            yield from known_in_task(pa.Table.from_batches(waiting)).combine_chunks().to_batches(max_chunksize=20_000)
            waiting.clear()

        for batch in batches:
            ids = batch.select([0, 1])
            lines = np.zeros(len(ids), np.int64)
            for hashes, owner, line in gathered(cut.of(batch.column(2).to_pylist())):
                starts = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (owner[1:] != owner[:-1]))))
                lines += np.bincount(owner[starts], minlength=len(ids))
                waiting.append(table(ids.take(pa.array(owner[starts])), line[starts], line_sets(hashes, starts, rarity, least)))
                if sum(map(len, waiting)) >= LINES_AT_ONCE or sum(w.column(8).nbytes for w in waiting) > 8 * POSTINGS_AT_ONCE * 4:
                    yield from out()
            zero = np.zeros(len(ids), np.uint64)
            yield table(ids, zero, {"k1": zero, "k2": zero, "b1": zero, "b2": zero, "size": lines, "prefix": pa.nulls(len(ids), pa.binary())}, COUNT)
        if waiting:
            yield from out()

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    names = ["doc_id", "text_hash", "line", "k1", "k2", "size", "b1", "b2", "prefix", "kind"]
    schema = T.StructType([rows.schema["doc_id"]]).add("text_hash", "long").add("line", "integer").add("k1", "long").add("k2", "long")
    return rows.mapInArrow(run, schema.add("size", "integer").add("b1", "long").add("b2", "long").add("prefix", "binary").add("kind", "byte"))


def prefix_ranks(prefix: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ranks of a column of prefixes, and how many each row has."""
    if not len(prefix):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offsets = np.frombuffer(prefix.buffers()[1], np.int32, len(prefix) + 1, prefix.offset * 4)
    data = prefix.buffers()[2]
    ranks = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view("<u8") if data else np.zeros(0, np.uint64)
    return ranks, np.diff(offsets.astype(np.int64)) // 8


def dealt(rows: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """part and rows (the bytes of those of each part): many small rows travel as few large ones."""
    by_part = np.argsort(part, kind="stable")
    own, cuts = np.unique(part[by_part], return_index=True)
    parts = [r.tobytes() for r in np.split(rows[by_part], cuts[1:])] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(parts, pa.binary())], ["part", "rows"])


def heavy_tokens(sets: DataFrame, piece: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix tokens that more than `piece` sets have, with their exact counts, and the number of all postings.

    Tasks count their own tokens, and their counts meet by token. Of more than `most` heavy tokens the heaviest count;
    the others, which hold a millionth of all postings at most, aren't cut into pieces.
    """
    kind = np.dtype([("token", "<u8"), ("n", "<i8")])
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def counted(tokens: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(tokens), return_counts=True)
        rows = np.empty(len(token), kind)
        rows["token"], rows["n"] = token, n
        return dealt(rows, (mix(token) % np.uint64(parts)).astype(np.int32))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            waiting.append(prefix_ranks(batch.column(0))[0])
            if sum(map(len, waiting)) > 4 * POSTINGS_AT_ONCE:
                yield counted(waiting)
                waiting = []
        if waiting:
            yield counted(waiting)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(b.as_py(), kind) for batch in batches for b in batch.column(1)]
        rows = np.concatenate(found) if found else np.empty(0, kind)
        rows = rows[np.argsort(rows["token"])]
        starts = np.flatnonzero(np.concatenate(([True], rows["token"][1:] != rows["token"][:-1])))[: len(rows)]
        n = np.add.reduceat(rows["n"], starts) if len(rows) else np.zeros(0, np.int64)
        hot = n > piece
        # the last row, of no token, has the sum of all
        tokens = pa.array([*rows["token"][starts][hot].view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([tokens, pa.array([*n[hot].tolist(), int(n.sum())], pa.int64())], ["token", "n"])

    met = sets.select("prefix").mapInArrow(count, "part int, rows binary").repartitionById(parts, "part").mapInArrow(add, "token long, n long")
    met = checkpoint(met)
    total = met.filter("token is null").agg(F.sum("n")).first()[0] or 0
    hot = met.filter("token is not null").orderBy(F.col("n").desc(), "token").limit(most).toArrow()
    token, n = hot.column(0).to_numpy().view(np.uint64), hot.column(1).to_numpy()
    by_token = np.argsort(token)
    return token[by_token], n[by_token], int(total)


def postings(sets: DataFrame, heavy: tuple[np.ndarray, np.ndarray], piece: int, parts: int, turn: int = 0, turns: int = 1, only: np.ndarray | None = None) -> DataFrame:
    """part and rows: postings of each set's prefix tokens, as often as pieces of a heavy token's sets meet.

    Only tokens whose turn it is, and buckets which `only` has if it is given, take part. A bucket is a token, or a pair
    of pieces of its sets; buckets that share a hash only give candidates that fail later.
    """
    hot, counts = heavy
    pieces_of_hot = -(-counts // piece)

    def made(batch: pa.RecordBatch) -> np.ndarray:
        k1, doc, size, b1, b2, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        token, lengths = prefix_ranks(batch.column(6))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bucket = mix(token)
        kept = np.ones(len(token), bool) if turns == 1 else mix(bucket ^ np.uint64(BASE)) % np.uint64(turns) == turn
        kept = np.flatnonzero(kept)
        flags = np.where(asks[owner[kept]], ASKS, 0)
        if len(hot):
            where = np.minimum(np.searchsorted(hot, token[kept]), len(hot) - 1)
            pieces = np.where(hot[where] == token[kept], pieces_of_hot[where], 1)
            at, of, flags = np.repeat(kept, pieces), np.repeat(pieces, pieces), np.repeat(flags, pieces)
            other = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            own = ((k1[owner[at]].view(np.uint64) >> np.uint64(7)) % of.astype(np.uint64)).astype(np.int64)
            low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
            pair = mix(bucket[at] ^ mix((low << np.uint64(32) | high) + np.uint64(BASE)))
            bucket, kept = np.where(of > 1, pair, bucket[at]), at
            flags = flags | np.where(own > other, SECOND, 0) | np.where(own != other, SPLIT, 0)
        else:
            bucket = bucket[kept]
        if only is not None:
            short = bucket >> np.uint64(SIZE_BITS)
            asked = only[np.minimum(np.searchsorted(only, short), len(only) - 1)] == short
            bucket, kept, flags = bucket[asked], kept[asked], flags[asked]
        who = owner[kept]
        rows = np.empty(len(kept), POSTING)
        low_bits = np.uint64((1 << SIZE_BITS) - 1)
        rows["key"] = bucket & ~low_bits | np.minimum(size[who], int(low_bits)).astype(np.uint64)
        for name, values in (("k1", k1), ("doc", doc), ("size", size), ("b1", b1.view(np.uint64)), ("b2", b2.view(np.uint64))):
            rows[name] = values[who]
        rows["place"] = np.minimum(place[kept], PLACE) | flags
        return rows

    def out(waiting: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(waiting)
        return dealt(rows, (rows["key"] >> np.uint64(32)).astype(np.int64) % parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for batch in batches:
            for s in range(0, len(batch), 5000):
                waiting.append(made(batch.slice(s, 5000)))
                if sum(map(len, waiting)) > POSTINGS_AT_ONCE:
                    yield out(waiting)
                    waiting = []
        if waiting:
            yield out(waiting)

    asks = F.col("asks") if "asks" in sets.columns else F.lit(False).alias("asks")
    return sets.select("k1", "doc", "size", "b1", "b2", asks, "prefix").mapInArrow(run, "part int, rows binary")


def needed(sizes_a, sizes_b, least: float):
    """The tokens that two sets of these sizes must share."""
    return np.ceil((sizes_a + sizes_b) * (least / (1 + least)) - EPS)


def close_pairs(rows: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (later, first) of candidates among postings in order of bucket and size.

    Rows of a bucket are compared at distance 1, 2, ... as long as the length filter lets the smaller set reach. The
    positional filter and the bitmaps, which can't differ in more bits than the sets in tokens, take most others out.
    """
    key, k1, doc, b1, b2 = (np.ascontiguousarray(rows[c]) for c in ("key", "k1", "doc", "b1", "b2"))
    bucket, short = key >> np.uint64(SIZE_BITS), (key & np.uint64((1 << SIZE_BITS) - 1)).astype(np.int64)
    size, flags = rows["size"].astype(np.int64), np.ascontiguousarray(rows["place"])
    left = size - (flags & PLACE)
    i, distance = np.arange(len(rows)), 0
    while len(i):
        distance += 1
        i = i[i + distance < len(rows)]
        j = i + distance
        i = i[(bucket[i] == bucket[j]) & (short[j] * least <= short[i] + EPS)]
        j = i + distance
        share = needed(size[i], size[j], least)
        hit = (np.minimum(left[i], left[j]) >= share) & (k1[i] != k1[j])
        hit &= (flags[i] & SPLIT == 0) | ((flags[i] ^ flags[j]) & np.uint32(SECOND) != 0)
        a, b, share = i[hit], j[hit], share[hit]
        differ = np.bitwise_count(b1[a] ^ b1[b]).astype(np.int64) + np.bitwise_count(b2[a] ^ b2[b])
        near = differ <= size[a] + size[b] - 2 * share
        a, b = a[near], b[near]
        for first, later in ((a, b), (b, a)):
            ok = doc[first] <= doc[later]
            yield later[ok], first[ok]


def best_candidates(rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows with a candidate, the candidate of the earliest document, and how many there are."""
    doc = np.ascontiguousarray(rows["doc"])
    best, seen = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
    for later, first in close_pairs(rows, least):
        seen[later] += 1
        better = (best[later] < 0) | (doc[first] < doc[best[later]])
        best[later[better]] = first[better]
    found = np.flatnonzero(best >= 0)
    return found, best[found], seen[found]


def all_candidates(rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All candidates of the rows that ask for them."""
    asks = np.ascontiguousarray(rows["place"]) & ASKS != 0
    pairs = [(later[asks[later]], first[asks[later]]) for later, first in close_pairs(rows, least)]
    later, first = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    return later, first, np.ones(len(later), np.int64)


def candidates(rows: DataFrame, parts: int, least: float, choose: Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """later, first (k1 of two sets), seen and bucket, as `choose` finds them in each part of the postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(b.as_py(), POSTING) for batch in batches for b in batch.column(1)]
        if not found:
            return
        table = np.concatenate(found)
        table = table[np.argsort(table["key"])]
        at, first, seen = choose(table, least)
        k1, bucket = table["k1"], (table["key"] >> np.uint64(SIZE_BITS)).astype(np.int64)
        for s in range(0, len(at), LINES_AT_ONCE):
            p = slice(s, s + LINES_AT_ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (k1[at[p]], k1[first[p]], seen[p], bucket[at[p]])], ["later", "first", "seen", "bucket"])

    return rows.repartitionById(parts, "part").mapInArrow(run, "later long, first long, seen long, bucket long")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, least: float) -> DataFrame:
    """Of rows (later, first) of k1 values, those whose sets are as similar and in this order.

    Only documents with such a line are read again, and only these lines of them are cut into tokens.
    """
    asked = pairs.select(F.explode(F.array("later", "first")).alias("k1")).distinct()
    asked = checkpoint(firsts.join(asked, "k1", "left_semi"))
    lines = F.collect_set(F.struct("line", "k1")).alias("asked")
    few = asked.groupBy(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_text")).agg(lines)
    same = F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.xxhash64("text") == F.col("a_text"))
    held = docs.select("doc_id", "text").join(broadcast_if_small(few, asked.count()), same).select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets = [], []
            for text, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split = text.split("\n")
                for one in lines:
                    keys.append(one["k1"])
                    sets.append(b" ".join(sorted(set(split[one["line"]].lower().encode().split()))))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["k1", "tokens"])

    tokens = held.mapInArrow(run, "k1 long, tokens binary").join(asked.select("k1", order().alias("at")), "k1")
    sides = [tokens.select(*[F.col(c).alias(f"{side}_{c}") for c in ("k1", "tokens", "at")]) for side in ("later", "first")]
    both = pairs.select("later", "first").join(sides[0], F.col("later") == F.col("later_k1"))
    both = with_firsts(both, sides[1], pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > common.HOT))
    both = both.filter(F.col("first_at") < F.col("later_at")).select("later", "first", "later_tokens", "first_tokens")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((frozenset(a.split(b" ")), frozenset(b.split(b" "))) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            close = [len(a & b) >= least * len(a | b) - EPS for a, b in sets]
            yield batch.select([0, 1]).filter(pa.array(close, pa.bool_()))

    return both.mapInArrow(similar, "later long, first long").distinct()


def with_firsts(rows: DataFrame, firsts: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (first and others) joined to firsts (first_k1 and others) by shuffling, but for the hot ones, which travel in blocks.

    hot: first, at most one for each HOT pairs. The candidates of a line that is near everything stay where they are.
    """
    if hot.isEmpty():
        return rows.join(firsts, F.col("first") == F.col("first_k1"))
    hot = checkpoint(hot.select("first"))
    few = broadcast_if_small(hot, hot.count())
    rows, tokens = checkpoint(rows), checkpoint(firsts.join(few, F.col("first") == F.col("first_k1")).drop("first"))
    found = [rows.join(block, F.col("first") == F.col("first_k1")) for block in blocks(tokens, tokens.count(), F.col("first_k1"))]
    found.append(rows.join(few, "first", "left_anti").join(firsts, F.col("first") == F.col("first_k1")))
    return reduce(DataFrame.unionByName, [f.select(*rows.columns, *firsts.columns) for f in found])


def order_bound(name: str, kind: T.DataType) -> Column:
    """A long that never falls from an earlier id to a later one: the id, or the first bytes of a text; null is last."""
    last = F.lit((1 << 63) - 1)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(name).cast("long"), last)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), last)
    return F.when(F.col(name).isNull(), last).otherwise(F.lit(0).cast("long"))


def order() -> Column:
    """Earlier lines are less: by doc_id (null last), hash of the text, and number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "line")


def firsts_of_sets(found: DataFrame) -> DataFrame:
    """The rows of found with `is_first`, true for the earliest line of each set, which alone keeps its prefix.

    Rows are dealt by their set's hash and sorted; a set's lines, a few for each task that met it, stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the first row of the set with which the last batch ended
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if before is None else pa.concat_batches([before, batch])
            k1, k2, text, line = (rows.column(names.index(n)).to_numpy() for n in ("k1", "k2", "text_hash", "line"))
            new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            start = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            doc = rows.column(0)
            other = doc.take(pa.array(start))
            equal = pa.compute.or_kleene(pa.compute.equal(doc, other), pa.compute.and_(doc.is_null(), other.is_null())).fill_null(False)
            first = equal.to_numpy(zero_copy_only=False) & (text == text[start]) & (line == line[start])
            skip = 0 if before is None else 1
            before = rows.slice(int(start[-1]), 1)
            prefix = pa.compute.if_else(pa.array(new), rows.columns[-1], pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], prefix, pa.array(first)], [*names, "is_first"]).slice(skip)

    names = found.columns
    dealt_out = found.repartition("k1").sortWithinPartitions("k1", "k2", F.col("doc_id").asc_nulls_last(), "text_hash", "line")
    return dealt_out.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("is_first", T.BooleanType())]))


def removals(docs: DataFrame, least: float = JACCARD, piece: int = PIECE, turns: int = TURNS, part: int = PART) -> DataFrame:
    """One row per document: doc_id, text_hash, n_lines (with tokens), n_removed and removed (line numbers from 0, sorted).

    A line goes if an earlier one (by doc_id, then line; null ids last) has the same tokens or a Jaccard similarity of
    `least` or more, be that one removed or not. Tokens are words between ASCII white space, in lower case, each once; a
    line without tokens stays. Rows with the same doc_id and text are one document. A null or empty text has no lines.
    An empty table gives an empty result; other columns are not read. doc_id may have any type that can be ordered.

    Lines of one set of tokens meet once and give one set to the search; a task sends on the first line alone of a set
    that it has met. Sets are the same if two sums over the 64-bit hashes of their tokens are; for similar sets hashes only choose
    candidates, and tokens themselves are compared. Tokens are ordered by a sketch of their counts whose size doesn't
    depend on the data: any order is exact, a rarer prefix only means fewer candidates. Tokens that many sets have in
    their prefixes are counted exactly, and their sets are cut into pieces that meet in pairs. Each set first asks for its
    candidate of the earliest document alone; sets for which that fails, and which have others, ask for all of these in a
    second round. So a group of many similar lines needs a row for each, not for each pair, and no line is lost. Tokens
    take part in turns, and the shuffle files of a turn go when it ends, so those of a part of them are on disk at a time.
    """
    with shuffles_dropped(docs.sparkSession):
        sketch = summed_sketch(docs.select("text"), text_tokens)
        found = stored(occurrences(docs, sketch, least))
        lines = stored(firsts_of_sets(found.filter(F.col("kind") == FIRST).select("doc_id", "text_hash", "line", "k1", "k2", "size", "b1", "b2", "prefix")))
        sets = lines.filter("prefix is not null").withColumn("doc", order_bound("doc_id", docs.schema["doc_id"].dataType))
        firsts = sets.select("k1", "doc_id", "text_hash", "line")
        *heavy, total = heavy_tokens(sets, piece)
        whole = total + int((heavy[1] * (-(-heavy[1] // piece) - 1)).sum())  # pieces repeat
        parts = max(1, -(-whole // (turns * part)))
        met = [checkpoint(candidates(postings(sets, heavy, piece, parts, turn, turns), parts, least, best_candidates)) for turn in range(turns)]
        met = reduce(DataFrame.union, met)
        asked = checkpoint(met.groupBy("later", "first").agg(F.max("seen").alias("seen")))
        matched = checkpoint(verified(asked, docs, firsts, least))
        more = asked.groupBy("later").agg(F.max("seen").alias("seen")).filter("seen > 1")
        more = checkpoint(more.join(matched, "later", "left_anti").select("later"))
        if pending := more.count():
            few = broadcast_if_small(more.select(F.col("later").alias("k1"), F.lit(True).alias("asks")), pending)
            open_ = met.filter("seen > 1").join(more, "later", "left_semi").select("bucket").distinct().limit(BROADCAST_ROWS + 1)
            only = np.sort(open_.toArrow().column(0).to_numpy().view(np.uint64))
            # few buckets in which candidates are left travel to all sets; otherwise all are dealt out again
            only = only if len(only) <= BROADCAST_ROWS else None
            asking = sets.join(few, "k1", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
            parts = max(1, -(-whole // part))
            rest = candidates(postings(asking, heavy, piece, parts, only=only), parts, least, all_candidates)
            rest = checkpoint(rest.select("later", "first").distinct().join(asked, ["later", "first"], "left_anti"))
            matched = matched.union(verified(rest, docs, firsts, least))
        gone = checkpoint(matched.select(F.col("later").alias("k1")).distinct().withColumn("matched", F.lit(True)))
    out = lines.select("doc_id", "text_hash", "line", "k1", "is_first").join(broadcast_if_small(gone, gone.count()), "k1", "left")
    out = out.filter("matched or not is_first").select("doc_id", "text_hash", F.col("line").alias("removed"), F.lit(None).cast("int").alias("n"))
    of = lambda kind: found.filter(F.col("kind") == kind)
    out = out.unionByName(of(AGAIN).select("doc_id", "text_hash", F.col("line").alias("removed"), F.lit(None).cast("int").alias("n")))
    out = out.unionByName(of(COUNT).select("doc_id", "text_hash", F.lit(None).cast("int").alias("removed"), F.col("size").alias("n")))
    per = out.groupBy("doc_id", "text_hash").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("removed")).alias("removed"))
    return per.select("doc_id", "text_hash", F.col("n").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def deduplicated(docs: DataFrame, least: float = JACCARD) -> DataFrame:
    """docs with the removed lines taken out of text, other columns and rows as they were; see removals()."""
    gone = checkpoint(removals(docs, least).filter("n_removed > 0").select(F.struct("doc_id", "text_hash", "removed").alias("__quire_gone")))
    same = F.col("doc_id").eqNullSafe(F.col("__quire_gone.doc_id")) & (F.xxhash64("text") == F.col("__quire_gone.text_hash"))
    rows = docs.join(broadcast_if_small(gone, gone.count()), same, "left")
    numbers = F.col("__quire_gone.removed")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(numbers, i)), "\n")
    return rows.withColumn("text", F.when(numbers.isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
