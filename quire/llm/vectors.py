"""Embedding near-duplicates: randomly rotated binary codes with stored correction factors decide what is compared exactly."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpoint, looked_up
from quire.llm.components import components

COSINE, SEED = 0.93, 11
#: Vectors of one block; pairs of blocks of a label are compared in tasks of their own.
BLOCK = 1024
#: Rows of a block that are compared at once with the other block.
STRIPE = 256
#: The share of pairs left open by their codes from which on a whole block is multiplied.
DENSE = 0.05
#: A cosine of a matrix product that is nearer than this to the threshold is computed pair by pair.
NEAR = 1e-9
#: How many standard errors the estimate's confidence bound is wide.
SIGMAS = 8.0


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the sign bits of each after rotation, and the code's cosine with its own vector, to correct with."""
    turned = units @ rotation(units.shape[1])
    bits = turned >= 0
    factor = np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])
    return np.packbits(bits, axis=1), factor


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """The codes as unit vectors with all components alike but for their signs."""
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def bounds(code_cosine: np.ndarray, factor: np.ndarray, dim: int, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the cosine of a vector o with q, from that of o's code with q and the stored cosine of code and o.

    code_cosine / factor estimates the cosine without bias. Its standard error gives the confidence bound; the angle's
    triangle inequality gives one that always holds. Each bound is the closer of the two.
    """
    a = np.clip(factor, 1e-6, 1.0)[:, None]
    estimate = code_cosine / a
    error = sigmas * np.sqrt(1 - a * a) / a / np.sqrt(max(dim - 1, 1))
    angle, own = np.arccos(np.clip(code_cosine, -1, 1)), np.arccos(a)
    low, high = np.cos(np.minimum(angle + own, np.pi)), np.cos(np.abs(angle - own))
    return np.maximum(low, estimate - error), np.minimum(high, estimate + error)


def linked(units: np.ndarray, codes: np.ndarray, factor: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """A matrix of links between two blocks. Codes rule pairs out; all other pairs are computed in double precision."""
    dim = units.shape[1]
    turned = (others @ rotation(dim)).astype(np.float32)
    _, high = bounds(decode(codes, dim) @ turned.T, factor.astype(np.float32), dim)
    slack = 1e-4  # single precision
    open_ = high >= least - slack
    found = np.zeros(open_.shape, bool)
    if open_.mean() > DENSE:
        # a matrix product sums in another order: what is near the threshold is left to the one sum that decides it anywhere
        cosine = units @ others.T
        found, open_ = open_ & (cosine >= least + NEAR), open_ & (np.abs(cosine - least) < NEAR)
    i, j = np.nonzero(open_)
    for s in range(0, len(i), 65536):
        a, b = i[s : s + 65536], j[s : s + 65536]
        found[a, b] = np.einsum("ij,ij->i", units[a], others[b]) >= least
    return found


def unit_vectors(raw: list[bytes], dim: int, width: int) -> np.ndarray:
    """Vectors of length 1 in double precision, from the bytes of their components."""
    found = np.frombuffer(b"".join(raw), np.float32 if width == 4 else np.float64).reshape(-1, dim).astype(np.float64)
    found /= np.abs(found).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """For one pair of blocks of a label (or one block): how many links each vector has there, and a vector it is joined to.

    The links of a pair of blocks are those across; the joins span what the links connect, by one row for each vector. A
    vector stands for `copies` equal ones, which count as links of the others; those among its own copies count elsewhere.
    """
    ids, mine, copies = pdf["vec_id"].to_numpy(), (pdf["block"] == pdf["low"]).to_numpy(), pdf["copies"].to_numpy()
    dim = int(pdf["dim"].iat[0])
    units = unit_vectors(pdf["raw"].to_list(), dim, len(pdf["raw"].iat[0]) // dim)
    codes = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(pdf), -1)
    factor = pdf["factor"].to_numpy()
    single = pdf["low"].iat[0] == pdf["high"].iat[0]
    left = np.flatnonzero(mine)
    right = left if single else np.flatnonzero(~mine)
    count, root = np.zeros(len(pdf), np.int64), np.arange(len(pdf))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s in range(0, len(left), STRIPE):
        rows = left[s : s + STRIPE]
        links = linked(units[rows], codes[rows], factor[rows], units[right], least)
        if single:
            links[np.arange(len(rows)), np.arange(s, s + len(rows))] = False
        count[rows] += links @ copies[right]
        if not single:
            count[right] += copies[rows] @ links
        for row, hit in zip(rows[links.any(axis=1)].tolist(), links[links.any(axis=1)], strict=True):
            a = find(row)
            for b in np.unique(root[right[hit]]).tolist():
                b = find(b)
                if a != b:
                    a, b = min(a, b), max(a, b)
                    root[b] = a
    roots = np.array([find(x) for x in range(len(pdf))])
    return pd.DataFrame({"vec_id": ids, "links": count, "root": ids[roots]})


def coded(vectors: DataFrame) -> DataFrame:
    """vec_id, label, copies, dim, raw (the components' bytes), code and factor of vectors that can link."""
    width = 4 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array([len(v) for v in batch.column(3)])
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                table = np.array(part.column(3).to_pylist(), np.float32 if width == 4 else np.float64).reshape(-1, dim)
                raw = [v.tobytes() for v in table]
                codes, factor = encode(unit_vectors(raw, dim, width))
                own = [*part.columns[:3], pa.array(np.full(len(raw), dim, np.int32)), pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor)]
                yield pa.RecordBatch.from_arrays(own, ["vec_id", "label", "copies", "dim", "raw", "code", "factor"])

    kinds = {n: vectors.schema[n].dataType.simpleString() for n in ("vec_id", "label")}
    rows = vectors.select("vec_id", "label", "copies", "embedding")
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, copies long, dim int, raw binary, code binary, factor double")


def near_duplicates(embeddings: DataFrame, least: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least vec_id reachable by links) and kept (its own component).

    Vectors link if their labels are equal and not null and their cosine is `least` or more. Vectors that are null, zero,
    or hold null or non-finite components link with nothing, and so do vectors of different length. Rows that share a
    vec_id are one vector, the one with the least label and embedding, nulls last; a null vec_id is one row that links
    with nothing, has no component and isn't kept. An empty table gives an empty result. Other columns are not read.

    Equal vectors of a label are one vector with a number of copies, so a group of copies of any size is one row in the
    search. The others are dealt to blocks by hash, and each pair of blocks is a group of its own, so that no task holds
    more than about two blocks, however large a label is. A group gives a row for each of its vectors, not one for each
    link. All pairs of a label are decided, most of them by their codes; each link by its cosine in double precision.
    """
    order = F.struct(F.col("label").isNull(), F.col("label"), F.col("embedding").isNull(), F.col("embedding"))
    one = embeddings.groupBy("vec_id").agg(F.min_by(F.struct("label", "embedding"), order).alias("v")).select("vec_id", "v.label", "v.embedding")
    one = checkpoint(one)
    parts = F.col("embedding")
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(parts, lambda x: x != 0)
    usable = one.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound)
    # labels and components of equal vectors are alike: of all that is grouped here only ids and counts are unlike
    same = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    rows = checkpoint(coded(same))
    per_label = rows.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    placed = rows.join(per_label, ["label", "dim"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    placed = placed.select("label", "dim", low, high, "block", "vec_id", "copies", "raw", "code", "factor")
    kind = rows.schema["vec_id"].dataType.simpleString()
    met = placed.groupBy("label", "dim", "low", "high").applyInPandas(lambda pdf: compare(pdf, least), f"vec_id {kind}, links long, root {kind}")
    met = checkpoint(met.filter("links > 0"))
    links = met.groupBy("vec_id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    of_first = rows.select("vec_id", "copies").join(links, "vec_id", "left").join(roots, F.col("vec_id") == F.col("vertex"), "left")
    of_first = checkpoint(
        of_first.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("component"), "copies")
    )
    # copies are looked up by 128 bits of hashes, so that those of one vector don't meet in one task
    key = F.concat_ws(":", F.xxhash64("label", "embedding"), F.xxhash64(F.lit("copy"), "embedding", "label")).alias("key")
    firsts = of_first.filter("copies > 1").select(F.col("vec_id").alias("first"), "n_links", "component")
    several = same.filter("copies > 1").select(key, F.col("vec_id").alias("first")).join(firsts, "first")
    several = checkpoint(several.select("key", F.struct("first", "n_links", "component").alias("of")))
    copied = looked_up(usable.select("vec_id", key), several, "key", several.count()).filter("of is not null and of.first <> vec_id")
    others = copied.select("vec_id", "of.n_links", "of.component")
    found = of_first.select("vec_id", "n_links", "component").unionByName(others)
    out = one.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
