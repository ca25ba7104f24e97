import numpy as np
import pytest

from quire.llm import vectors
from tests.llm.cases import Groups

SCHEMA = "vec_id long, embedding array<float>, label int, root string, unit string, block string, links string"


def rows_of(units, labels, first=0):
    return [(first + i, [float(x) for x in u], lab, *"abcd") for i, (u, lab) in enumerate(zip(units, labels, strict=True))]


def plain(rows, least=0.93):
    one = {}
    for r in rows:
        if r[0] is not None:
            one.setdefault(r[0], r)
    ok = {}
    for i, r in one.items():
        v = r[1]
        if v and r[2] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(np.float64)
            ok[i] = (r[2], a / np.linalg.norm(a))
    links, groups = {i: 0 for i in one}, Groups()
    ids = sorted(ok)
    for i in one:
        groups.find(i)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= least:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return sorted((i, links[i], groups.find(i), groups.find(i) == i) for i in one)


def clustered(seed, n=300, dim=64, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((n // 6, dim))
    made = centres[rnd.integers(0, len(centres), n)] + rnd.standard_normal((n, dim)) * rnd.choice([0.05, 0.2, 0.28, 0.35], (n, 1))
    return made, [None if i % 41 == 0 else int(i % labels) for i in range(n)]


@pytest.mark.parametrize("block", [16, 1024])
def test_links_are_those_of_brute_force(spark, block):
    rows = rows_of(*clustered(1))
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [float("inf")] * 64, 1), (904, [None] * 64, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1e-30] * 64, 2), (909, [1e30] * 64, 2)]
    rows += [(*r, *"abcd") for r in odd] + [(None, rows[0][1], 0, *"abcd"), rows[5], rows[6]]
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(tuple(r) for r in found if r["vec_id"] is not None) == plain(rows)
    assert [tuple(r) for r in found if r["vec_id"] is None] == [(None, 0, None, False)]


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_hold_and_the_estimate_has_no_bias():
    rnd = np.random.default_rng(2)
    o = rnd.standard_normal((400, 64))
    q = o[rnd.permutation(400)] * 0.5 + rnd.standard_normal((400, 64)) * 0.6
    o, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (o, q))
    codes, factor = vectors.encode(o)
    turned = q @ vectors.rotation(64)
    cosine = vectors.decode(codes, 64) @ turned.T
    low, high = vectors.bounds(cosine, factor, 64)
    truth = o @ q.T
    assert (low <= truth + 1e-5).all() and (truth <= high + 1e-5).all()
    assert abs((cosine / factor[:, None] - truth).mean()) < 0.002
    assert (high < 0.93).mean() > 0.99


def test_boundary_is_decided_in_double_precision(spark):
    a = np.zeros(64)
    a[0] = 1.0
    b = np.zeros(64)
    b[0], b[1] = 0.93, np.sqrt(1 - 0.93**2)
    c = b.copy()
    c[0] = 0.9299
    rows = rows_of([a, b, c], [1, 1, 1])
    assert sorted(tuple(r) for r in vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == plain(rows)


def test_copies_count_as_links_without_being_expanded(spark):
    made, labels = clustered(4, 120)
    made[30:90] = made[30]
    made[95:100] = made[95] * 2
    labels = [None if x is None else x % 2 for x in labels]
    rows = rows_of(made, labels)
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert sorted(tuple(r) for r in found) == plain(rows)


def test_copies_without_broadcasts(spark, monkeypatch):
    from quire.llm import common

    made, labels = clustered(5, 60)
    made[10:50] = made[10]
    rows = rows_of(made, [1] * 60)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT", 5)
    found = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=16).collect()
    assert sorted(tuple(r) for r in found) == plain(rows)


def test_links_are_exact_where_codes_alone_would_accept(spark):
    """Two pairs a hair above and below the threshold, in a dense block and in a thin one."""
    rnd = np.random.default_rng(7)
    base = rnd.standard_normal((40, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = np.roll(base, 1, axis=1)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = np.where(np.arange(40) % 2 == 0, 0.93 + 2e-7, 0.93 - 2e-7)[:, None]
    near = cosine * base + np.sqrt(1 - cosine**2) * other
    rows = [(i, [float(x) for x in u], 1, *"abcd") for i, u in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    assert [got[i] for i in range(40)] == [1 - i % 2 for i in range(40)]


def test_one_sum_decides_at_the_threshold(monkeypatch):
    """Whether a block is multiplied or goes pair by pair changes no link, at the very threshold either."""
    rnd = np.random.default_rng(3)
    units = rnd.standard_normal((200, 61))
    units[100:] = units[:100] + rnd.standard_normal((100, 61)) * 0.3
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    codes, factor = vectors.encode(units)
    pair = np.einsum("ij,ij->i", units[:100], units[100:])
    for least in pair[:30]:
        found = []
        for dense in (-1.0, 2.0):
            monkeypatch.setattr(vectors, "DENSE", dense)
            found.append(vectors.linked(units, codes, factor, units, float(least)))
        assert (found[0] == found[1]).all() and found[0][np.flatnonzero(pair == least)[0], 100 + np.flatnonzero(pair == least)[0]]
