import numpy as np
import pytest
import xxhash

from quire.llm import lines
from tests.llm.cases import documents, empty, odd_documents, prose, row


def token_sets(text):
    for n, line in enumerate((text or "").lower().encode().split(b"\n")):
        if found := frozenset(line.split()):
            yield n, found


def plain(rows, least=0.8):
    """Removed lines by (doc_id, text); rows that repeat are one document."""
    seen, out = [], {}
    unique = {(r[0], r[1]) for r in rows}
    for doc in sorted(unique, key=lambda d: (d[0] is None, d[0] or 0, text_order(d[1]))):
        out[doc] = (sum(1 for _ in token_sets(doc[1])), [])
        for n, tokens in token_sets(doc[1]):
            if any(len(tokens & s) >= least * len(tokens | s) - 1e-9 for s in seen):
                out[doc][1].append(n)
            seen.append(tokens)
    return out


def text_order(text):
    """Spark's xxhash64 as a signed long; its hash of a null is the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def check(spark, rows, **options):
    df = documents(spark, rows)
    got = {(r["doc_id"], r["text_hash"]): (r["n_lines"], r["removed"], r["n_removed"]) for r in lines.removals(df, **options).collect()}
    expected = plain(rows)
    assert len(got) == len(expected)
    for (doc_id, text), (n, removed) in expected.items():
        assert got[(doc_id, text_order(text))] == (n, removed, len(removed)), doc_id


def test_odd_documents(spark):
    check(spark, odd_documents())
    assert lines.removals(empty(spark)).collect() == []


def similar_rows():
    base = [f"word{i}" for i in range(40)]
    rows = []
    for d in range(60):
        changed = list(base)
        for k in range(d % 9):
            changed[(d * 7 + k * 5) % 40] = f"new{d}x{k}"
        rows.append(row(d, "\n".join([" ".join(changed), "of the and", f"short line {d % 5}", prose(d % 11, 60, 30)])))
    return rows


@pytest.mark.parametrize("piece", [5, 4096])
def test_groups_of_similar_lines(spark, piece):
    check(spark, similar_rows(), piece=piece)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(lines, "broadcast_if_small", lambda df, rows: df)
    check(spark, similar_rows())


def test_one_line_with_many_near_copies(spark, monkeypatch):
    """The tokens of a line that hundreds are near travel to these, in blocks, and not they to it."""
    from quire.llm import common

    base = [f"word{i}" for i in range(30)]
    rows = [row(0, " ".join(base))] + [row(d, " ".join([*base[: d % 27], f"own{d}", *base[d % 27 :]]) + f"\nline {d} of this one alone") for d in range(1, 300)]
    asked, usual = [], lines.with_firsts
    monkeypatch.setattr(lines, "with_firsts", lambda both, firsts, hot: (asked.append(hot.count()), usual(both, firsts, hot))[1])
    monkeypatch.setattr(common, "HOT", 100)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    check(spark, rows + similar_rows())
    assert max(asked) >= 1


def test_cleaned_documents(spark):
    rows = [row(1, "keep this first line\n\ncopyright of all rights"), row(2, "Copyright of all rights\nanother line that stays"), row(3, None), row(3, ""), row(4, "one\none\nOne two")]
    df = documents(spark, rows)
    cleaned = lines.deduplicated(df)
    assert cleaned.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in cleaned.collect()} == {(1, rows[0][1]), (2, "another line that stays"), (3, None), (3, ""), (4, "one\nOne two")}


@pytest.mark.parametrize("block,long", [(8, 4), (1 << 20, 1 << 16)])
def test_tokens_of_blocks_are_those_of_the_whole(monkeypatch, block, long):
    monkeypatch.setattr(lines, "LONG", long)
    monkeypatch.setattr(lines, "BLOCK", block)
    cut = lines.Tokens()
    texts = ["", "a", "a b\nc  d\n\n e", None, "longer words here\n" * 9, "x" * 50 + " y\nz", "ä é 日本\n\tq", "same same same\nsame", "\n"]
    parts = list(cut.of(texts))
    hashes, owner, at = (np.concatenate([p[i] for p in parts]).tolist() for i in range(3))
    expected = [(i, n, t) for i, text in enumerate(texts) for n, line in enumerate((text or "").lower().encode().split(b"\n")) for t in line.split()]
    assert list(zip(owner, at, strict=True)) == [(i, n) for i, n, _ in expected]
    by_token = {}
    for h, (_, _, t) in zip(hashes, expected, strict=True):
        assert by_token.setdefault(t, h) == h
    assert len(set(by_token.values())) == len(by_token)


def test_sets_of_long_lines(monkeypatch):
    monkeypatch.setattr(lines, "WIDTHS", np.array([2, 4]))
    hashes = lines.mix(np.array([1, 2, 1, 3, 4, 5, 5, 6, 7, 8, 9, 9], np.uint64))
    made = lines.line_sets(hashes, np.array([0, 3, 5]), np.zeros(lines.SKETCH, np.uint64), 0.8)
    assert made["size"].tolist() == [2, 2, 5]
    assert [len(p) for p in made["prefix"].to_pylist()] == [1, 1, 2]


def test_ids_of_text_and_lines_that_are_everywhere(spark):
    """Ids need no number; a line that each document has is removed but for the first."""
    rows = [(f"id{i:03d}" if i % 7 else None, f"the same line for all of them\nown {i} words of {i * 3} and more of {i * 5}\nthe same line for all of these") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    got = {(r["doc_id"], r["text_hash"]): (r["n_lines"], r["removed"]) for r in lines.removals(df).collect()}
    expected, seen = {}, []
    for i, t in sorted(set(rows), key=lambda d: (d[0] is None, (d[0] or "").encode(), text_order(d[1]))):
        removed = []
        for n, tokens in token_sets(t):
            if any(len(tokens & s) >= 0.8 * len(tokens | s) - 1e-9 for s in seen):
                removed.append(n)
            seen.append(tokens)
        expected[(i, text_order(t))] = (3, removed)
    assert got == expected


def test_heavy_tokens_are_counted_exactly(spark):
    ranks = [[1, 2, 3], [1, 5], [1, 2], [], [7]]
    df = spark.createDataFrame([(np.array(r, np.int64).tobytes(),) for r in ranks], "prefix binary")
    token, n, total = lines.heavy_tokens(df, 1)
    assert (token.tolist(), n.tolist(), total) == ([1, 2], [3, 2], 8)
    assert [a.tolist() for a in lines.heavy_tokens(df, 1, most=1)[:2]] == [[1], [3]]


def test_tokens_of_one_rank_stay_apart():
    """Hashes that agree in the bits that a rank keeps are two tokens of a set; a repeated one is one."""
    a, b = np.uint64(0x1234 << 48), np.uint64(0x1234 << 48 | 1 << 15)
    scale = np.zeros(lines.SKETCH, np.uint16)
    made = lines.line_sets(np.array([a, b, a, b], np.uint64), np.array([0, 2]), scale, 0.8)
    assert made["size"].tolist() == [2, 2]
    once = lines.line_sets(np.array([a, b, a], np.uint64), np.array([0]), scale, 0.8)
    assert once["size"].tolist() == [2] and once["k1"][0] == made["k1"][0] and once["k2"][0] == made["k2"][0]
