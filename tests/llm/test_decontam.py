import re

from quire.llm import decontam
from tests.llm.cases import documents, empty, odd_documents, prose, row

ITEMS = "item_id long, text string, doc_id string, h string, n string, need string"


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(docs, items, least=0.8):
    held, asked = {}, {}
    for r in docs:
        held.setdefault(r[0], set()).update(shingles(r[1]))
    for i in items:
        asked.setdefault(i[0], set()).update(shingles(i[1]))
    return {(d, i, len(q), len(q & s)) for d, s in held.items() for i, q in asked.items() if q and len(q & s) >= least * len(q) - 1e-9}


def cases():
    passage = " ".join(f"item{i}" for i in range(30))
    words = passage.split()
    docs = odd_documents() + [
        row(100, prose(5, 5000) + " " + passage + " " + prose(6, 5000)),
        row(101, "before " + passage.upper().replace(" ", ", ") + "! after"),
        row(102, " ".join([*words[:10], "cut", *words[10:]])),  # one word put in: 4 of 26 shingles go
        row(103, " ".join([*words[:10], "cut", *words[10:20], "cut", *words[20:]])),  # two: 8 of 26
        row(104, " ".join(words[:20])),
        row(105, passage + " " + passage),
    ]
    items = [(1, passage, *"abcd"), (2, "one two", *"abcd"), (3, None, *"abcd"), (4, "", *"abcd"), (5, "a b c d e f", *"abcd"), (None, "one", *"abcd"), (6, "...", *"abcd"), (1, passage, *"abcd")]
    return docs, items


def test_finds_what_brute_force_finds(spark):
    docs, items = cases()
    found = decontam.contaminated(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r["doc_id"], r["item_id"], r["item_shingles"], r["found"]) for r in found}
    assert got == brute(docs, items) and len(got) == len(found)
    assert {d for d, i, *_ in got if i == 1} == {100, 101, 102, 105}


def test_without_a_broadcast(spark, monkeypatch):
    docs, items = cases()
    monkeypatch.setattr(decontam, "broadcast_if_small", lambda df, rows: df)
    found = decontam.contaminated(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["found"]) for r in found} == brute(docs, items)


def test_clean_keeps_columns_and_other_rows(spark):
    docs, items = cases()
    df = documents(spark, docs)
    kept = decontam.clean(df, spark.createDataFrame(items, ITEMS))
    bad = {d for d, *_ in brute(docs, items)}
    assert kept.columns == df.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(r[0]) for r in docs if r[0] not in bad)


def test_empty_tables(spark):
    docs, items = cases()
    nothing = spark.createDataFrame([], ITEMS)
    assert decontam.contaminated(empty(spark), spark.createDataFrame(items, ITEMS)).collect() == []
    assert decontam.contaminated(documents(spark, docs), nothing).collect() == []
    assert decontam.clean(documents(spark, docs), nothing).count() == len(docs)


def test_sketches_lose_no_document():
    """k - floor((1-t)n) values of a sketch of k are always among those of a set that misses at most floor((1-t)n)."""
    for n in range(1, 400):
        upper = 2 ** (n.bit_length()) - 1
        k = min(n, int(upper * (0.2 + 1e-9)) + 1)
        missed = int(n * (0.2 + 1e-9))
        assert k - missed >= 1


def test_sketches_in_blocks(spark, monkeypatch):
    from quire.llm import common

    docs, items = cases()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 7)
    found = decontam.contaminated(documents(spark, docs), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], r["item_shingles"], r["found"]) for r in found} == brute(docs, items)
