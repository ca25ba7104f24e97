import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import tries

TURNS = "conv_id long, turn long, role string, text string, key string, depth string, part string, words string"


def brute(rows, group=20, shared=4):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    found = {}
    for path in sorted(nodes, key=len, reverse=True):
        kids = [k for k in found if len(k) == len(path) + 1 and k[: len(path)] == path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved = (len(nodes[path]) - 1) * words + sum(found[k][5] for k in kids)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        found[path] = (min(nodes[path]), len(path), len(nodes[path]), len(kids), sum(found[k][4] for k in kids) or 1, saved, digest)
    return {(*found[p], min(nodes[p[:-1]]) if p else None) for p in found}


def made(seed, convs=120, texts=3):
    rnd = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rnd.randrange(0, 6)):
            out.append((c, t, rnd.choice(["user", "user", "assistant"]), rnd.choice(["a", "b c", "d e f"][:texts]), *"abcd"))
    return out


ODD = [
    (1, None, "user", "first by null", *"abcd"), (1, 3, None, None, *"abcd"), (1, 2, "", "", *"abcd"), (None, 1, "user", "of none", *"abcd"), (2, 1, "user", "x", *"abcd"), (2, 1, "user", "x", *"abcd"),
    (-7, 1, "user", "minus", *"abcd"), (-20, 1, "user", "head", *"abcd"), (40, 0, "a", "bc", *"abcd"), (41, 0, "ab", "c", *"abcd"), (45, 0, "user", "w " * 9000, *"abcd"), (46, 5, "user", " x y", *"abcd"),
]


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def found_in(spark, rows):
    got = tries.trie(spark.createDataFrame(rows, TURNS)).collect()
    as_sets = {(r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"], r["parent_conv_id"]) for r in got}
    assert len(as_sets) == len(got)
    return as_sets


CASES = {
    "odd": ODD,
    "random": made(1) + ODD,
    "few texts": made(2, 300, 1),
    "one group of copies": [(20 * c, t, "user", f"t{t}", *"abcd") for c in range(400) for t in range(4)] + made(3),
    "copies and longer ones": [(20 * c, t, "user", f"t{t}", *"abcd") for c in range(200) for t in range(3 + (c % 50 == 0))],
    "one long": [(20, t, "user", f"t{t}", *"abcd") for t in range(600)] + [(20 * c, t, "user", f"t{t}", *"abcd") for c in range(2, 9) for t in range(100 * c)],
    "one": [(5, 0, "user", "x", *"abcd")],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force_over_partitions(uncoalesced, name, monkeypatch):
    monkeypatch.setattr(tries, "IDS", 3)
    monkeypatch.setattr(tries, "BATCH", 5)
    assert found_in(uncoalesced, CASES[name]) == brute(CASES[name])


@pytest.mark.parametrize("seed", range(40))
def test_stitching_at_every_cut(seed):
    """Sweeps of any parts of sorted keys, empty ones left out, stitched: the same nodes as one sweep of all."""
    rnd = random.Random(seed)
    keys = sorted((bytes([rnd.choice(b"ab")]) * tries.WIDTH * rnd.choice([1, 1, 0]) + b"".join(bytes([rnd.choice(b"ab")]) * tries.WIDTH for _ in range(rnd.randrange(5))), c) for c in range(30))

    def nodes(cuts):
        swept = []
        for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
            if a < b:
                sweep = tries.Sweep(part)
                for key, conv in keys[a:b]:
                    sweep.take(key, [3] * (len(key) // tries.WIDTH), conv)
                sweep.end()
                swept += sweep.rows
        spine = sorted((r for r in swept if r["kind"] in ("path", "open")), key=lambda r: (r["part"], r["kind"] == "open", r.get("spine") or "", r["depth"]))
        out = [r for b in tries.stitched(iter([tries.record(spine, tries.SWEPT)])) for r in b.to_pylist()]
        refs = {(r["part"], r["spine"], r["depth"]): r["conv_id"] for r in out if r["kind"] == "ref"}
        inner = [r if r.get("part") is None else r | {"parent_conv_id": refs[r["part"], r["spine"], r["depth"] - 1]} for r in swept if r["kind"] == "node"]
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        return sorted((tuple(r[n] for n in names) for r in [*inner, *(r for r in out if r["kind"] == "node")]), key=str)

    whole = nodes([])
    for _ in range(20):
        assert nodes(sorted(rnd.sample(range(len(keys) + 1), rnd.randrange(1, 6)))) == whole


def test_empty_table(spark):
    assert tries.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert tries.trie(spark.createDataFrame([(None, 1, "user", "x", *"abcd")], TURNS)).collect() == []
