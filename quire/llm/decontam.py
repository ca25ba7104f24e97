"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import blocks, broadcast_if_small, checkpoint, text_or_empty

SHINGLE, CONTAINMENT = 5, 0.8
#: Words are runs of letters and digits, compared in lower case.
BREAKS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text. A break before the first word leaves an empty string in front, which goes."""
    cut = F.split(F.lower(text), BREAKS)
    return F.filter(cut, lambda w: w != "")


def shingles(cut: Column, size: int, of) -> Column:
    """The shingles of an array of words, repeats included; fewer words are one shingle, none are none.

    Each shingle is a struct of `size` fields of what `of` makes of the words, null where a short text has no word.
    """
    made = F.transform(cut, of)
    n = F.greatest(F.size(cut) - (size - 1), F.least(F.size(cut), F.lit(1)))
    return F.arrays_zip(*[F.slice(made, i + 1, n).alias(f"w{i}") for i in range(size)])


def exploded(texts: DataFrame, ids: list[str], size: int, of) -> DataFrame:
    """ids and the fields w0.. of each shingle of the column text."""
    cut = texts.select(*ids, words(text_or_empty()).alias("cut"))
    return cut.select(*ids, F.inline(shingles(F.col("cut"), size, of)))


def hashed(texts: DataFrame, ids: list[str], size: int) -> DataFrame:
    """ids and the 64-bit hash of each shingle."""
    found = exploded(texts, ids, size, lambda w: F.xxhash64(w))
    return found.select(*ids, F.xxhash64(*[f"w{i}" for i in range(size)]).alias("h"))


def size_class(n: Column) -> Column:
    """The partition of a test item by its number of distinct shingles: class c holds 2**c to 2**(c+1)-1."""
    return F.floor(F.log2(n)).cast("int")


def signatures(items: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """item_key, n, need and h: the bottom-k MinHash sketch of each item, as long as its size class asks for.

    A document that holds the share t of an item's n shingles misses at most floor((1-t)n) of them. The class's upper
    bound m gives k = floor((1-t)m)+1, so a sketch of the k least hashes always has k - floor((1-t)n) >= 1 of its values
    among those of such a document: the search loses none. Items without words have no shingle and match nothing.
    """
    sets = hashed(items, ["item_key"], size).groupBy("item_key").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    n = F.size("hs")
    upper = F.pow(F.lit(2), size_class(n) + 1) - 1
    miss = F.lit(1 - containment) + F.lit(1e-9)
    k = F.least(n, (F.floor(upper * miss) + 1).cast("int"))
    need = F.greatest(F.lit(1), k - F.floor(n * miss).cast("int"))
    return sets.select("item_key", n.alias("n"), need.alias("need"), F.explode(F.slice("hs", F.lit(1), k)).alias("h"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and test item of which the document holds at least the share `containment`.

    Columns: doc_id, item_id, item_shingles, found (distinct shingles of the item in the document) and containment.

    Shingles are `size` words (letters and digits, lower case) in a row; a text of fewer words is one shingle, which
    only an equally short text can hold; texts without words, null ones too, match nothing. Rows that share a doc_id, or
    an item_id, are one text each as far as their shingles go; a null id is an id. Empty tables give an empty result.
    Other columns are not read. Whole texts are searched, however long.

    The items are the small side. Their sketches are broadcast in blocks of a bounded size, one block if they are few.
    Documents pass once for each block, shingles that hit no sketch go in the task that makes them, and hits are counted
    before they are shuffled, so that a shingle that many documents share weighs on no single task. Only documents that hit often enough are read again, for the exact comparison of
    shingle texts.
    """
    items = benchmark.select(F.col("item_id").alias("item_key"), "text")
    sketch = checkpoint(signatures(items, size, containment))
    # however many items there are, documents' shingles stay where they are: sketches travel, block by block
    found = [hashed(docs, ["doc_id"], size).join(block, "h") for block in blocks(sketch, sketch.count(), F.col("h"))]
    hits = reduce(DataFrame.union, found)
    # a shingle may repeat in a document: distinct hashes count
    hits = hits.groupBy("doc_id", "item_key", "need", "h").agg(F.lit(1).alias("hit"))
    pairs = hits.groupBy("doc_id", "item_key", "need").agg(F.sum("hit").alias("hits")).filter("hits >= need")
    pairs = checkpoint(pairs.select(F.col("doc_id").alias("pair_doc"), F.col("item_key").alias("pair_item")))
    n_pairs = pairs.count()
    names = [f"w{i}" for i in range(size)]
    keyed = [F.coalesce(F.col(w), F.lit("")).alias(w) for w in names]
    asked = exploded(items, ["item_key"], size, lambda w: w).select("item_key", *keyed).distinct()
    sizes = asked.groupBy("item_key").agg(F.count(F.lit(1)).alias("item_shingles"))
    asked = checkpoint(asked.join(sizes.withColumnRenamed("item_key", "sized"), F.col("item_key").eqNullSafe(F.col("sized"))).drop("sized"))
    hit_docs = broadcast_if_small(pairs.select("pair_doc").distinct(), n_pairs)
    again = docs.select("doc_id", "text").join(hit_docs, F.col("doc_id").eqNullSafe(F.col("pair_doc")), "left_semi")
    held = exploded(again, ["doc_id"], size, lambda w: w).select("doc_id", *keyed)
    met = [held.join(block, names) for block in blocks(asked, asked.count(), F.col("item_key"))]
    both = reduce(DataFrame.unionByName, met).groupBy("doc_id", "item_key", "item_shingles", *names).agg(F.lit(1).alias("hit"))
    found = both.groupBy("doc_id", "item_key", "item_shingles").agg(F.count(F.lit(1)).alias("found"))
    found = found.filter(F.col("found") >= F.col("item_shingles") * F.lit(containment - 1e-9))
    found = found.join(
        broadcast_if_small(pairs, n_pairs),
        F.col("doc_id").eqNullSafe(F.col("pair_doc")) & F.col("item_key").eqNullSafe(F.col("pair_item")),
        "left_semi",
    )
    return found.select("doc_id", F.col("item_key").alias("item_id"), "item_shingles", "found", (F.col("found") / F.col("item_shingles")).alias("containment"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """docs without the documents that hold a test item, with the columns of docs.

    Rows that share a contaminated doc_id go together, a null one too; see contaminated() for what matches.
    """
    bad = checkpoint(contaminated(docs, benchmark, size, containment).select(F.col("doc_id").alias("__quire_id")).distinct())
    return docs.join(broadcast_if_small(bad, bad.count()), F.col("doc_id").eqNullSafe(F.col("__quire_id")), "left_anti")
