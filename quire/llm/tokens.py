"""Token counts under a SentencePiece BPE vocabulary, by counting distinct pre-tokens."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as limits
from quire.llm.common import blocks, checkpoint, stored

#: Pre-tokens whose counts a Python worker keeps; beyond it the memory starts anew, which costs time but no result.
MEMO = 1_000_000
#: Pre-tokens whose numbers of pieces travel to all tasks, and the bytes that they may have together; the others are joined by a shuffle.
COMMON, COMMON_BYTES = 400_000, 16 << 20
#: Pre-tokens in one batch of rows.
AT_ONCE = 50_000
#: Characters of a text that are cut into pre-tokens at once.
BLOCK = 1 << 20
#: A pre-token longer than this is cut again where no piece of the vocabulary can join the two sides.
LONG = 4096
#: The character that stands for a space in pieces.
SPACE = "▁"


class PieceCounter:
    """Counts the pieces of texts. A pre-token is a run of spaces and the characters up to the next space.

    No piece has a space after another character, so no merge crosses from one pre-token to the next, and a text's
    count is the sum over its pre-tokens. check() holds that against the vocabulary.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.memo: dict[str, int] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.check(pieces)
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # a lone space: what one at the end of a text adds
        self.memo_start = {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}

    @staticmethod
    def check(pieces: list[str]) -> None:
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("this vocabulary has pieces across spaces or with line ends; pre-tokens can't be counted apart")

    @staticmethod
    def blocks(text: str) -> Iterator[str]:
        """The text with the model's leading space, in blocks that begin with a space and end before a run of spaces."""
        text, start = " " + text.replace(SPACE, " "), 0
        while len(text) - start > BLOCK:
            end = PieceCounter.boundary(text, start + BLOCK)
            if end == -1:
                break
            yield text[start:end]
            start = end
        yield text[start:]

    @staticmethod
    def boundary(text: str, at: int) -> int:
        """The first place from `at` on with a space after another character; -1 if there is none."""
        while (at := text.find(" ", at)) != -1 and text[at - 1] == " ":
            at += 1
        return at

    @staticmethod
    def pretokens(block: str) -> list[str]:
        """Each without its first space."""
        words = block[1:].split(" ")
        if "" not in words:
            return words
        found, run = [], 0
        for w in words:
            if w:
                found.append(" " * run + w)
                run = 0
            else:
                run += 1
        return found + [" " * (run - 1)] * bool(run)

    def long(self, pretoken: str) -> int:
        """A long pre-token's pieces, counted in parts between which no piece joins."""
        total, start, first = 0, 0, True
        cuts = [i for i in range(LONG, len(pretoken)) if pretoken[i - 1 : i + 1] not in self.joined and pretoken[i - 1] != " "]
        for end in [*cuts, len(pretoken)]:
            if end - start >= LONG or end == len(pretoken):
                part = pretoken[start:end]
                # behind a line end a part gets no leading space; the two pieces in front are not its own
                total += len(self.model.encode(part)) if first else len(self.model.encode("\n" + part)) - 2
                start, first = end, False
        return total

    def counts(self, pretokens: list[str]) -> list[int]:
        """The numbers of pieces of pre-tokens that aren't long."""
        found: list[int] = []
        for start in range(0, len(pretokens), 4096):
            found += map(len, self.model.encode(pretokens[start : start + 4096], num_threads=1))
        return [n if p else self.memo_start[""] for p, n in zip(pretokens, found, strict=True)]

    def learn(self, pretokens: list[str]) -> None:
        """Count each of these pre-tokens once."""
        short = [p for p in pretokens if len(p) <= LONG]
        self.memo.update(zip(short, self.counts(short), strict=True))
        self.memo.update((p, self.long(p)) for p in pretokens if len(p) > LONG)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        for block in self.blocks(text):
            frequency = Counter(self.pretokens(block))
            if len(self.memo) > MEMO:
                self.memo = {}
            self.memo.setdefault("", self.memo_start[""])
            self.learn([p for p in frequency if p not in self.memo])
            memo = self.memo
            total += sum(n * memo[p] for p, n in frequency.items())
        return total


def pieces_of_vocabulary(docs: DataFrame, model: bytes) -> DataFrame:
    """pretoken, n (how often the corpus has it) and pieces: each distinct pre-token of the corpus is cut into pieces once.

    Tasks count their own pre-tokens and send on distinct ones. Pre-tokens of more than LONG characters are not here.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            short = [p for p in seen if len(p) <= LONG]
            for s in range(0, len(short), AT_ONCE):
                part = short[s : s + AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([seen[p] for p in part], pa.int64())], ["pretoken", "n"])
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for block in PieceCounter.blocks(text) if text else ():
                    seen.update(PieceCounter.pretokens(block))
                if len(seen) > MEMO:
                    yield from out()
        yield from out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counter.counts(batch.column(0).to_pylist()), pa.int32())], ["pretoken", "n", "pieces"])

    found = docs.select("text").mapInArrow(distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return stored(found.mapInArrow(cut, "pretoken string, n long, pieces int"))


def common_pretokens(vocabulary: DataFrame, most: int, size: int) -> tuple[pa.Table, DataFrame | None]:
    """pretoken and pieces of the most frequent pre-tokens, `most` at most with `size` bytes at most, and the hot ones of the others.

    They are found by a histogram over classes of frequency, of which some hundreds come to the driver, not by sorting.
    Whatever is more frequent goes first, long or short. Others that the corpus has more than HOT times, if there are
    any, are a table of pretoken and pieces: at most one for each HOT pre-tokens of the corpus.
    """
    class_ = F.floor(F.log2("n") * 8).cast("int")
    least, rows, held = 1 << 30, 0, 0
    histogram = vocabulary.groupBy(class_.alias("class")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("pretoken")).alias("held"))
    for row in sorted(histogram.collect(), key=lambda r: -r["class"]):
        rows, held = rows + row["rows"], held + row["held"]
        if rows > most or held > size:
            break
        least = row["class"]
    hot = vocabulary.filter((class_ < least) & (F.col("n") > limits.HOT)).select("pretoken", F.col("pieces").alias("hot_pieces"))
    return vocabulary.filter(class_ >= least).select("pretoken", "pieces").toArrow(), None if hot.isEmpty() else checkpoint(hot)


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, common: int = COMMON, size: int = COMMON_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    model is the content of a SentencePiece BPE model file, which travels with the tasks. A null text counts as empty:
    no bytes, no tokens. Rows that repeat are counted each; an empty table gives an empty result; other columns are not
    read. Texts of any length are cut in blocks at spaces, so a text needs little more memory than itself.

    Each distinct pre-token of the corpus is cut into pieces once, and its number of pieces is joined to the documents'
    frequencies: that of the `common` most frequent ones, of `size` bytes together, where the documents are, as they
    travel to every task, that of the others by a shuffle of what documents have of them. If some of these are hot all
    the same, they are broadcast in blocks. A pre-token of more than LONG characters is counted where it is. No ids are made.
    """
    vocabulary = pieces_of_vocabulary(docs, model)
    known, hot = common_pretokens(vocabulary, common, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        pieces = dict(zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True))
        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            totals, rest, times, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                frequency: Counter[str] = Counter()
                for block in PieceCounter.blocks(text) if text else ():
                    frequency.update(PieceCounter.pretokens(block))
                total = 0
                for p, n in frequency.items():
                    if (c := pieces.get(p)) is not None:
                        total += n * c
                    elif len(p) > LONG:
                        total += n * counter.long(p)
                    else:
                        rest.append(p)
                        times.append(n)
                totals.append(total)
                ends.append(len(rest))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(rest, pa.string())), pa.ListArray.from_arrays(ends, pa.array(times, pa.int32()))]
            keys = pa.array(range(key, key + len(totals)), pa.int64())
            key += len(totals)
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(1), pa.array(totals, pa.int64()), *lists], ["key", "doc_id", "n_bytes", "known", "pretoken", "times"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", size, "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = stored(rows.mapInArrow(run, f"key long, doc_id {kind}, n_bytes long, known long, pretoken array<string>, times array<int>"))
    rest = rows.filter(F.size("pretoken") > 0).select("key", F.inline(F.arrays_zip("pretoken", "times")))
    found = []
    for block in blocks(hot, hot.count(), F.col("pretoken")) if hot is not None else ():
        rest = rest.join(block, "pretoken", "left")
        found.append(rest.filter("hot_pieces is not null").select("key", "times", F.col("hot_pieces").alias("pieces")))
        rest = rest.filter("hot_pieces is null").drop("hot_pieces")
    found.append(rest.join(vocabulary.select("pretoken", "pieces"), "pretoken").select("key", "times", "pieces"))
    rest = reduce(DataFrame.unionByName, found).groupBy("key").agg(F.sum(F.col("times") * F.col("pieces")).alias("rest"))
    counted = rows.join(rest, "key", "left").select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
