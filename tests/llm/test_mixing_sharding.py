import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from quire.llm import mixing, sharding
from tests.llm.cases import WORD, documents, empty, odd_documents, prose, row


def key60(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        to = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_is_that_of_the_paper(spark):
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 42, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 8, 9, 100):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump(df["k"], shards).alias("s")).collect()}
        assert got == {k: jump(k & (1 << 64) - 1, shards) for k in keys}


@pytest.mark.parametrize("cells,at_once", [(1024, 4096), (2, 3)])
def test_manifest(spark, monkeypatch, cells, at_once):
    monkeypatch.setattr(sharding, "COPIES_AT_ONCE", at_once)
    rows = odd_documents() + [row(77, "again")] * 40
    found = sharding.manifest(documents(spark, rows), 8, cells).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key", jump(key60(r[0]), 8), jump(key60(r[0]), 9)) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.manifest(empty(spark)).collect() == []


def test_assign(spark):
    df = documents(spark, odd_documents())
    out = sharding.assign(df, 8, "part")
    assert out.columns == [*df.columns, "part"]
    assert all(r["part"] == jump(key60(r["doc_id"]), 8) for r in out.collect())


def plain_targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, budget = {s: 0.0 for s in order}, share * sum(sizes.values())
    free = set(order)
    while True:
        left = budget - sum(most * sizes[s] for s in order if s not in free)
        total = sum(weight[s] for s in free)
        for s in order:
            target[s] = left * weight[s] / total if s in free else most * sizes[s]
        above = {s for s in free if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        free -= above


def mixed(spark, rows):
    found = mixing.mix(documents(spark, rows)).collect()
    size_of = Counter()
    for r in rows:
        size_of[r[3]] += len(WORD.findall(r[1] or ""))
    return found, size_of, plain_targets(size_of)


def test_odd_documents(spark):
    rows = odd_documents()
    found, sizes, targets = mixed(spark, rows)
    by_id = {str(r[0]) + str(len(WORD.findall(r[1] or ""))): r for r in rows}
    assert len(found) == len(rows)
    for r in found:
        source = by_id[str(r["doc_id"]) + str(r["size"])][3]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        assert r["source_size"] == sizes[source] or str(r["doc_id"]) in ("1", "None")
    assert sorted({round(r["target"], 6) for r in found}) == sorted({round(t, 6) for t in targets.values()})
    assert mixing.mix(empty(spark)).collect() == []


def test_targets_are_met_and_thresholds_are_nested(spark):
    rows = [row(i, prose(1, 12 * (1 + i % 9)), ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i in range(1500)]
    found, sizes, targets = mixed(spark, rows)
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    taken, biggest = Counter(), 12 * 9
    for r in found:
        taken[rows[r["doc_id"]][3]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= biggest
    for s in targets:
        mine = sorted((key60(r["doc_id"]), r["copies"]) for r in found if rows[r["doc_id"]][3] == s and r["size"])
        assert [c for _, c in mine] == sorted((c for _, c in mine), reverse=True) and mine[0][1] - mine[-1][1] <= 1


def test_mix_itself(spark):
    rows = [row(i, prose(1, 12 * (1 + i % 9)), ["a", "b", None, "hot"][i % 4]) for i in range(300)]
    df = documents(spark, rows)
    out = mixing.apply_mix(df)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    assert out.columns == df.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: v for k, v in copies.items() if v})


def test_without_broadcasts(spark, monkeypatch):
    rows = [row(i, prose(1, 24), "ab"[i % 2]) for i in range(40)]
    usual = sorted(map(tuple, mixing.mix(documents(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "broadcast_if_small", lambda df, rows: df)
    assert sorted(map(tuple, mixing.mix(documents(spark, rows)).collect())) == usual


def plain_copies(rows):
    """How often each row is taken, by hand: documents of a source in order of their hashes, up to the nearest side of its rest."""
    sizes, by_source = Counter(), defaultdict(lambda: defaultdict(int))
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        by_source[r[3]][key60(r[0])] += n
    below, whole = {}, {}
    for source, target in plain_targets(sizes).items():
        size = sizes[source]
        whole[source] = int(target // size) if size else 0
        rest, at, cut = target - size * whole[source], 0, 0
        for h in sorted(by_source[source]):
            words = by_source[source][h]
            if rest <= 0 or at > rest:
                break
            # of documents of one sum so far the last decides
            cut = h + (1 if words - (rest - at) < rest - at else 0)
            at += words
        below[source] = cut
    return [whole[r[3]] + (key60(r[0]) < below[r[3]]) for r in rows]


def test_documents_without_words_come_twice_at_most(spark):
    rows = [row(0, "three words here", "full")] + [row(i, ["", None, " \n"][i % 3], "full") for i in range(1, 200)]
    rows += [row(i, "", "empty") for i in range(200, 240)] + [row(i, prose(1, 24), "b") for i in range(240, 260)]
    found = mixing.mix(documents(spark, rows)).collect()
    copies = {r["doc_id"]: r["copies"] for r in found}
    assert max(copies.values()) <= 2 and copies[0] == 2
    assert all(copies[i] == 0 for i in range(200, 240))
    assert [copies[r[0]] for r in rows] == plain_copies(rows)
    assert mixing.apply_mix(documents(spark, rows)).count() == sum(plain_copies(rows))


def test_copies_are_those_of_a_plain_walk(spark):
    rows = [row(i, prose(1, 12 * (i % 7)) if i % 5 else "", ["a", "b", None, "hot", "hot"][i % 5]) for i in range(400)]
    found = {r["doc_id"]: r["copies"] for r in mixing.mix(documents(spark, rows)).collect()}
    assert [found[r[0]] for r in rows] == plain_copies(rows)


def test_the_plan_of_a_mix_is_short(spark):
    rows = [row(i, prose(1, 24), "ab"[i % 2]) for i in range(40)]
    plan = mixing.mix(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20
