import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import tokens
from tests.llm.cases import documents, empty, odd_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = open(PATH, "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
COUNTER = tokens.PieceCounter(MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t▁<s>/é日😀 ")) | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_counts_are_those_of_the_library(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


@pytest.mark.parametrize("block,long", [(16, 8), (64, 5)])
def test_blocks_and_long_pretokens_change_nothing(monkeypatch, block, long):
    monkeypatch.setattr(tokens, "BLOCK", block)
    monkeypatch.setattr(tokens, "LONG", long)
    counter = tokens.PieceCounter(MODEL)
    for text in ("hello   world again  and\nagain " * 9, "internationalization" * 20, "日本語" * 40 + "  x", " " * 70, "a" * 100):
        assert counter.count(text) == len(LIBRARY.encode(text))


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    counter = tokens.PieceCounter(MODEL)
    for text in ("a b c d e f g ", "h i j k a b", ""):
        assert counter.count(text) == len(LIBRARY.encode(text))


def test_odd_documents(spark):
    rows = odd_documents()
    found = sorted(map(tuple, tokens.count_tokens(documents(spark, rows), MODEL).collect()), key=str)
    expected = []
    for r in rows:
        n = len(LIBRARY.encode(r[1] or ""))
        expected.append((r[0], len((r[1] or "").encode()), n, n > 4096))
    assert found == sorted(expected, key=str)
    assert tokens.count_tokens(empty(spark), MODEL).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.PieceCounter.check(["▁a", "a▁b"])


def words_documents(spark, n=60):
    import random

    rnd = random.Random(3)
    words = [f"word{i}" for i in range(40)] + ["Über", "日本語", "a", "the", "x" * 90]
    rows = [(i, "  ".join(rnd.choice(words) for _ in range(1 + i * 3)) + (" " if i % 4 == 0 else "\n") + "y" * (5000 if i % 20 == 1 else 1)) for i in range(n)]
    rows += [(i, t) for i, t in rows[:3]] + [(None, "the end "), (1, None), (2, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("common", [0, 10, 400_000])
def test_common_and_other_pretokens_give_the_same(spark, common):
    rows, df = words_documents(spark)
    found = tokens.count_tokens(df.repartition(3), MODEL, common=common).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, found), key=str) == sorted(((i, len(LIBRARY.encode(t or ""))) for i, t in rows), key=str)


def test_each_pretoken_of_the_corpus_is_cut_once(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    rows, df = words_documents(spark)
    vocabulary = tokens.pieces_of_vocabulary(df.repartition(3), MODEL).collect()
    assert len({r["pretoken"] for r in vocabulary}) == len(vocabulary)
    expected = {}
    for _, t in rows:
        for block in COUNTER.blocks(t) if t else ():
            for p in COUNTER.pretokens(block):
                expected[p] = expected.get(p, 0) + (len(p) <= tokens.LONG)
    assert {r["pretoken"]: r["n"] for r in vocabulary} == {p: n for p, n in expected.items() if n}
    assert all(r["pieces"] == (len(LIBRARY.encode("b " + r["pretoken"])) - len(LIBRARY.encode("b")) if r["pretoken"].strip() else r["pieces"]) for r in vocabulary)


def test_a_long_pretoken_in_every_document_is_no_hot_key(spark, monkeypatch):
    """Frequent pre-tokens travel whatever their length; where they may not, hot ones are broadcast in blocks."""
    rule = "https://" + "x" * 92
    rows = [(i, f"{rule} word{i} {rule}  own{i % 7} the") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known, hot = tokens.common_pretokens(tokens.pieces_of_vocabulary(df, MODEL), tokens.COMMON, tokens.COMMON_BYTES)
    assert any(len(p.as_py()) >= 100 for p in known.column(0)) and hot is None
    expected = {i: len(LIBRARY.encode(t)) for i, t in rows}
    monkeypatch.setattr(tokens.limits, "HOT", 20)
    monkeypatch.setattr(tokens.limits, "BROADCAST_ROWS", 3)
    _, hot = tokens.common_pretokens(tokens.pieces_of_vocabulary(df, MODEL), 0, 0)
    assert hot.count() >= 2 and max(len(r["pretoken"]) for r in hot.collect()) >= 100
    for common, size in ((tokens.COMMON, tokens.COMMON_BYTES), (0, 0), (5, 10**6)):
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df, MODEL, common=common, size=size).collect()} == expected
