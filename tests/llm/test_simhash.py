import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash
from tests.llm.cases import WORD, Groups, documents, empty, odd_documents, prose, row


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, distance=4):
    groups = Groups()
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= distance:
                groups.join(i, j)
    return [groups.find(i) for i in range(len(fps))]


def test_fingerprints():
    for text in [None, "", " \n", "One", "one TWO", "a b c", "a b c d", "Ä É x y z", "a b c d " * 50, prose(4, 400)]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprints_of_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    for text in ["a b c d e f g", "abcdefghijk lm nop q", "x" * 30 + " y", prose(4, 60), " \n a  b  ", ""]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_close_pairs_share_a_mask(distance):
    rnd = random.Random(1)
    for count in (10, 1 << 22, 1 << 30):
        masks = simhash.block_masks(simhash.block_count(count, distance), distance)
        for _ in range(50):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), distance):
                b ^= 1 << bit
            assert any((a & m & (1 << 64) - 1) == (b & m & (1 << 64) - 1) for m in masks)


def test_odd_documents(spark):
    rows = odd_documents()
    fps = [plain_fingerprint(r[1]) for r in rows]
    group = components(fps)
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    expected = sorted(((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, group, strict=True)), key=str)
    found = simhash.near_duplicates(documents(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == expected
    assert simhash.near_duplicates(empty(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    rows = odd_documents()
    df = documents(spark, rows)
    kept = simhash.first_of_groups(df)
    group = components([plain_fingerprint(r[1]) for r in rows])
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(group))
    assert {1, 10, 13}.issubset(ids) and not {2, 3, 14}.intersection(ids)
    assert simhash.first_of_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("piece", [7, 2048])
def test_a_dense_group_in_pieces(spark, piece):
    """Fingerprints around one value, close in chains: pieces of a bucket meet in pairs, and nothing is lost."""
    rnd = random.Random(3)
    fps = {0}
    while len(fps) < 120:
        fps.add(rnd.choice(sorted(fps)) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64))
    fps |= {rnd.getrandbits(64) for _ in range(60)}
    values = sorted(fps)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    groups = Groups()
    for a, b in simhash.close_links(df, len(values), 4, piece).collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
        groups.join(signed.index(a), signed.index(b))
    assert [groups.find(i) for i in range(len(values))] == components(values)


def test_repeated_rows_stay_once(spark):
    rows = [row(1, "a b c d e"), row(1, "a b c d e"), row(1, "other words of this id now"), row(None, "z y x w v"), row(None, "z y x w v")]
    kept = simhash.first_of_groups(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "a b c d e"), ("1", "other words of this id now"), ("None", "z y x w v")]


def test_hot_groups_without_broadcasts(spark, monkeypatch):
    """Copies and near copies of a large group don't meet by key; what comes out is the same."""
    from quire.llm import common

    base = prose(9, 300)
    rows = [row(i, base if i % 3 else base.replace(base.split()[i], "changed", 1)) for i in range(60)] + odd_documents()
    df = documents(spark, rows)
    usual = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    kept = sorted(str(r["doc_id"]) for r in simhash.first_of_groups(df).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT", 3)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == usual
    assert sorted(str(r["doc_id"]) for r in simhash.first_of_groups(df).collect()) == kept
    group = components([plain_fingerprint(r[1]) for r in rows])
    assert len(kept) == len(set(group))


@pytest.mark.parametrize("most", [200_000, 2])
def test_a_large_bucket_is_cut_before_it_meets(spark, monkeypatch, most):
    """20,000 fingerprints with equal keys: no two pieces of a bucket have more than about twice a piece of members."""
    from quire.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    df = spark.range(20_000).select(F.col("id").alias("fp"))
    masks = simhash.block_masks(6, 4)
    members = simhash.in_pieces(df, masks, 512)
    sizes = [r["count"] for r in members.groupBy("mask", "key", "low", "high").count().collect()]
    assert max(sizes) < 2.6 * 512
    # each pair of one bucket meets in some pair of pieces
    dropped = next(i for i, m in enumerate(masks) if m & (1 << 21) - 1 == 0)
    one = members.filter(f"mask = {dropped}").select("low", "high", "fp").distinct()
    low, high = (one.filter(f"fp = {v}").select("low", "high") for v in (3, 19_999))
    assert low.intersect(high).count() >= 1
