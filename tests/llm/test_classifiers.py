import numpy as np
import pytest

from quire.llm import boosting, quality, toxicity
from tests.llm.cases import crc_fold, documents, empty, odd_documents, prose, row

LABELS = "doc_id long, quality int, toxic int, text string, y string"


def labelled_documents(n=240):
    rows, labels = [], []
    for i in range(n):
        good, toxic = i % 3 != 0, i % 4 == 0
        text = prose(i % 7 + 1, 60)
        if toxic:
            words = text.split(" ")
            words[5:5] = [["idiot", "moron", "scum"][i % 3]] * 2
            text = " ".join(words)
        if not good:
            text = " ".join(w + "%%%" for w in text.split()) if i % 2 else " ".join(w for w in text.split()[:20] for _ in range(5))
        rows.append(row(i, text))
        labels.append((i, int(good), int(toxic), "x", "y"))
    return rows, labels


@pytest.mark.parametrize("module,column,folds,rest,threshold", [(quality, 1, 5, 0, 0.3), (toxicity, 2, 3, 1, 0.7)])
def test_held_out_documents(spark, module, column, folds, rest, threshold):
    rows, labels = labelled_documents()
    odd = [(None, 1, 1, "x", "y"), (3, None, None, "x", "y"), (10_000, 1, 0, "x", "y"), (0, 0, 1, "x", "y")]
    df = documents(spark, rows + odd_documents()[3:7] + [rows[9]])
    found = module.scored(df, spark.createDataFrame(labels + odd, LABELS)).collect()
    assert len(found) == len(rows) + 5
    right = []
    for r in found:
        assert r["held_out"] == (crc_fold(r["doc_id"], folds) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        if r["held_out"] and r["doc_id"] < 240:
            right.append(r["predicted"] == labels[r["doc_id"]][column])
    assert len(right) > 20 and np.mean(right) >= 0.9
    assert len({r["score"] for r in found if r["doc_id"] == 9}) == 1


@pytest.mark.parametrize("module,column", [(quality, 1), (toxicity, 2)])
def test_held_out_labels_are_not_learned(spark, module, column):
    """Turning the labels of the held-out fold round changes no score."""
    rows, labels = labelled_documents(90)
    folds, rest = (5, 0) if module is quality else (3, 1)
    turned = [(i, 1 - q, 1 - t, *x) if crc_fold(i, folds) == rest else (i, q, t, *x) for i, q, t, *x in labels]
    df = documents(spark, rows)
    a, b = ({r["doc_id"]: r["score"] for r in module.scored(df, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_few_labels_and_empty_tables(spark, module):
    rows, labels = labelled_documents(12)
    none = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in module.scored(documents(spark, rows), none).collect()} == {0.5}
    same = [(i, 1, 1, "x", "y") for i in range(12)]
    scores = {r["score"] for r in module.scored(documents(spark, rows), spark.createDataFrame(same, LABELS)).collect()}
    assert len(scores) == 1 and scores.pop() > 0.8
    assert module.scored(empty(spark), spark.createDataFrame(labels, LABELS)).collect() == []


def test_accepted_keeps_columns(spark):
    rows, labels = labelled_documents()
    df = documents(spark, rows)
    kept = quality.accepted(df, spark.createDataFrame(labels, LABELS))
    assert kept.columns == df.columns
    assert 0.9 < np.mean([labels[r["doc_id"]][1] for r in kept.select("doc_id").collect()])


def test_quality_scores_don_t_depend_on_grouping():
    rows, labels = labelled_documents(60)
    model = quality.fit([r[1] for r in rows], [x[1] for x in labels])
    texts = [r[1] for r in rows] + ["", "x" * 500]
    together = model.scores(texts, {})
    assert np.allclose(together, [model.scores([t], {})[0] for t in texts])


def test_trees_and_calibration():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 3))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(float)
    margins = boosting.boost(x, y).margins(x)
    assert ((margins > 0) == y).mean() > 0.97
    low, mean = boosting.isotonic(margins, y)
    values = boosting.calibrated(margins, low, mean)
    assert (np.diff(mean) >= 0).all() and 0 < values.min() and values.max() < 1
    assert abs(values.mean() - y.mean()) < 0.02


def test_second_person_near_a_toxic_word():
    lexicon = toxicity.Lexicon({"w:idiot": 0.9})
    near, far = (lexicon.features(t, {}) for t in ("you idiot " + "a " * 30, "you " + "a " * 30 + "idiot"))
    assert near[11] > far[11] > 0 and lexicon.features("", {}) == [0.0] * toxicity.FEATURES
    assert lexicon.word("1d10t")[0] == 0.9


def plain_quality(model, text):
    """The score of a text by loops: the mean of its words' log-odds, each the word's, its shape's and the mean of its n-grams'."""
    from zlib import crc32

    words = [w[i : i + 64] for w in text.split() for i in range(0, len(w), 64)] if any(len(w) > 64 for w in text.split()) else text.split()
    z = model.bias + float(model.logit[crc32(b"d:") % quality.BUCKETS])
    total = 0.0
    for w in words:
        grams, codes = [], [ord(c) for c in f"<{w}>"]
        for n in quality.NGRAMS:
            for i in range(len(codes) - n + 1):
                h = n
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 & (1 << 64) - 1) ^ c
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
                grams.append(float(model.logit[(h >> 40) % quality.BUCKETS]))
        total += float(model.logit[crc32(b"w:" + w.encode()) % quality.BUCKETS]) + float(model.logit[crc32(quality.shape(w).encode()) % quality.BUCKETS]) + sum(grams) / len(grams)
    total += float(model.logit[crc32(b"r:") % quality.BUCKETS]) * sum(a == b for a, b in zip(words, words[1:], strict=False))
    z += total / len(words) if words else 0.0
    return 1 / (1 + np.exp(-z))


def test_quality_scores_are_those_of_plain_loops():
    rows, labels = labelled_documents(80)
    model = quality.fit([r[1] for r in rows], [x[1] for x in labels])
    texts = [r[1] for r in rows[:12]] + ["", "one", "a a a b", "Über straße 😀 !!", "x" * 150, "Titel UND (klein)."]
    assert np.allclose(model.scores(texts, {}), [plain_quality(model, t) for t in texts], atol=1e-9)


def plain_toxicity(lexicon, text):
    """The features of a text by a walk over its words."""
    words = toxicity.words_of(text)
    if not words:
        return [0.0] * toxicity.FEATURES
    seen = []
    for w in words:
        terms = toxicity.terms_of(w)
        of = lambda kinds: max((lexicon.share.get(t, 0.0) for t in terms if (t[0] == "w") == kinds), default=0.0)  # noqa: E731, B023
        core = w.strip(toxicity.EDGE)
        seen.append((of(True), of(False), core.lower() in toxicity.SECOND_PERSON, sum(c.isalpha() for c in w), sum(c.isupper() for c in w), core, w))
    whole, stem = [s[0] for s in seen], [s[1] for s in seen]
    best = [max(a, b) for a, b in zip(whole, stem, strict=True)]
    letters = max(1, sum(s[3] for s in seen))
    size = sum(len(w) for w in words)
    counts, top = {}, []
    for w, b in zip(words, best, strict=True):
        counts[w] = counts.get(w, 0) + 1
        if b > 0 and counts[w] <= 3:
            top.append(b)
    top = [*sorted(top, reverse=True)[:3], 0.0, 0.0, 0.0][:3]
    toxic, person = [i for i, b in enumerate(best) if b >= toxicity.SHARE], [i for i, s in enumerate(seen) if s[2]]
    near = 1 / (1 + min(abs(i - j) for i in toxic for j in person)) if toxic and person else 0.0
    many = lambda values, least: float(sum(v >= least for v in values))
    return [
        max(whole), max(stem), top[1], top[2], many(whole, toxicity.SHARE), many(stem, toxicity.SHARE), many(best, 0.75), many(whole, toxicity.SHARE) / len(words), many(stem, toxicity.SHARE) / len(words),
        sum(best) / len(words), len(person) / len(words), near, sum(s[4] for s in seen) / letters, sum(s[3] > 1 and s[4] == s[3] for s in seen) / len(words),
        (size - sum(s[3] for s in seen)) / size, sum(w.count("!") for w in words) / size, sum(bool(toxicity.MIXED.search(s[5])) for s in seen) / len(words),
    ]


def test_toxicity_features_are_those_of_a_walk():
    lexicon = toxicity.Lexicon({"w:idiot": 0.9, "w:moron": 0.6, "4:idio": 0.7, "5:scumb": 0.4, "w:you": 0.1})
    texts = ["you idiot!", "IDIOTS are 1d10ts and m0rons, you MORON", "", "calm words only", "scumbag scumbag scumbag scumbag u", "!!! ... ***", "x" * 130 + " you", "Du b1st ein Idiot!! " * 9]
    for text in texts:
        assert np.allclose(lexicon.features(text, {}), plain_toxicity(lexicon, text)), text
    rnd = np.random.default_rng(0)
    model = toxicity.Model(lexicon, boosting.boost(rnd.random((300, toxicity.FEATURES)), (rnd.random(300) > 0.5).astype(float)), np.array([-1.0, 1.0]), np.array([0.2, 0.8]))
    x = np.array([plain_toxicity(lexicon, t) for t in texts])
    assert np.allclose(model.scores(x), model.scores(np.array([lexicon.features(t, {}) for t in texts])))


def test_long_texts_are_learned_from_too(spark):
    """A sample is bounded in rows and bytes, not by the length of a text."""
    from quire.llm import labelled

    rows = [row(i, "word " * (50_000 if i == 3 else 5)) for i in range(20)] + [row(30, None)]
    labels = spark.createDataFrame([(i, i % 2, 0, "x", "y") for i in range(31)], LABELS)
    from pyspark.sql import functions as F

    pick = lambda n, size: {r["doc_id"] for r in labelled.sample(documents(spark, rows), labels, "quality", F.lit(True), n, size).collect()}
    assert pick(100, 1 << 20) == set(range(20)) and len(pick(7, 1 << 20)) == 7
    assert sum(len(rows[i][1]) for i in pick(100, 260_000)) <= 260_000


def test_an_over_long_text_does_not_end_the_sample(spark):
    """The text first in hash order is larger than the whole sample may be: the others are learned from all the same."""
    from pyspark.sql import functions as F

    from quire.llm import labelled

    labels = spark.createDataFrame([(i, i % 2, 0, "x", "y") for i in range(200)], LABELS)
    first = labels.orderBy(F.xxhash64("doc_id"), "doc_id").first()["doc_id"]
    for long in (30_000, 8_000, 4_900):
        rows = [row(i, "w" * (long if i == first else 40)) for i in range(0, 200, 2)] + [row(first, "w" * long)]
        picked = {r["doc_id"] for r in labelled.sample(documents(spark, rows), labels, "quality", F.lit(True), 60, 20_000).collect()}
        assert len(picked) == 60 and (first in picked) == (long == 4_900)


def test_training_goes_on_beside_an_over_long_text(spark, monkeypatch):
    """A labelled text above the sample's bytes, wherever it stands, changes no score of the others."""
    rows, labels = labelled_documents(60)
    monkeypatch.setattr(quality, "train", lambda docs, labels, keep=quality.train: keep(docs, labels, 200, 300_000))
    found = []
    for long in (None, "bad " * 100_000):
        df = documents(spark, [*rows, row(1000, long)])
        found.append({r["doc_id"]: r["score"] for r in quality.scored(df, spark.createDataFrame([*labels, (1000, 0, 1, "x", "y")], LABELS)).collect()})
    assert len(set(found[0].values())) > 30
    assert all(found[0][i] == found[1][i] for i in range(60))
