"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import boosting, labelled
from quire.llm.boosting import Trees, boost, calibrated, isotonic
from quire.llm.labelled import fold, sample

#: The sample: at most so many labelled rows, with so many bytes of text together.
ROWS, BYTES = 20_000, 1 << 30
#: Terms of the learned lexicon at most; those with the highest smoothed share come first.
TERMS = 20_000
#: A term needs so many toxic documents, and this smoothed share of toxic ones among all that have it.
SUPPORT, SHARE = 3, 0.5
SMOOTH = 4.0
STEMS = (4, 5)
FOLDS, THRESHOLD, CROSS = 3, 0.7, 3
LONGEST, MEMO = 64, 400_000
#: Words that address a reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tus tuyo usted ustedes vosotros".split())
#: Signs that stand in for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„’"
MIXED = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
FEATURES = 17


def words_of(text: str) -> list[str]:
    words = text.split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def terms_of(word: str) -> list[str]:
    """What the lexicon knows a word by: itself in lower case, its reading without look-alike signs, and its stems."""
    core = word.strip(EDGE).lower()
    if not core:
        return []
    plain = word.lower().strip("#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”„’\"").translate(LOOKALIKES).replace("*", "") if MIXED.search(word) else core
    return [f"w:{core}"] + [f"w:{plain}"] * (plain != core) + [f"{n}:{plain[:n]}" for n in STEMS if len(plain) > n]


@dataclass
class Lexicon:
    """Smoothed shares of toxic documents by term."""

    share: dict[str, float]

    def word(self, word: str) -> tuple[float, ...]:
        """What a word adds: best share as a word and as a stem, second person, letters, capitals, all capitals, signs, exclamations, obfuscated."""
        terms = terms_of(word)
        whole = max((self.share.get(t, 0.0) for t in terms if t[0] == "w"), default=0.0)
        stem = max((self.share.get(t, 0.0) for t in terms if t[0] != "w"), default=0.0)
        letters = sum(map(str.isalpha, word))
        capitals = sum(map(str.isupper, word)) if letters else 0
        core = word.strip(EDGE)
        return (
            whole, stem, float(core.lower() in SECOND_PERSON), letters, capitals, float(letters > 1 and capitals == letters),
            len(word) - letters, word.count("!"), float(bool(MIXED.search(core))),
        )

    def features(self, text: str, memo: dict[str, tuple[float, ...]]) -> list[float]:
        words = words_of(text)
        if not words:
            return [0.0] * FEATURES
        counted = Counter(words)
        if len(memo) > MEMO:
            memo.clear()
        for w in counted:
            if w not in memo:
                memo[w] = self.word(w)
        seen = np.array([memo[w] for w in counted])
        n = np.fromiter(counted.values(), np.float64, len(counted))
        whole, stem = seen[:, 0], seen[:, 1]
        total, letters = n.sum(), max(1.0, n @ seen[:, 3])
        best = np.maximum(whole, stem)
        near = 0.0
        if best.max() >= SHARE and seen[:, 2].any():
            toxic = [i for i, w in enumerate(words) if max(memo[w][:2]) >= SHARE]
            person = np.array([i for i, w in enumerate(words) if memo[w][2]])
            place = np.searchsorted(person, toxic)
            gap = np.minimum(np.abs(person[np.minimum(place, len(person) - 1)] - toxic), np.abs(person[np.maximum(place - 1, 0)] - toxic))
            near = 1 / (1 + float(gap.min()))
        top = np.sort(np.repeat(best[best > 0], np.minimum(n[best > 0], 3).astype(int)))[::-1][:3]
        top = np.pad(top, (0, 3 - len(top)))
        size = n @ (seen[:, 3] + seen[:, 6])
        return [
            float(whole.max()), float(stem.max()), *top[1:].tolist(), float(n @ (whole >= SHARE)), float(n @ (stem >= SHARE)), float(n @ (best >= 0.75)),
            float(n @ (whole >= SHARE) / total), float(n @ (stem >= SHARE) / total), float(n @ best / total),
            float(n @ seen[:, 2] / total), near, float(n @ seen[:, 4] / letters), float(n @ seen[:, 5] / total),
            float(n @ seen[:, 6] / size), float(n @ seen[:, 7] / size), float(n @ seen[:, 8] / total),
        ]


def term_counts(picked: DataFrame) -> DataFrame:
    """term and, for each cross-fitting fold, the toxic (p0..) and other (n0..) documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*counts.values(), strict=True)) or [[]] * (2 * CROSS)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names)

        for batch in batches:
            for part, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term in {t for w in set(words_of(text)) for t in terms_of(w)}:
                    counts.setdefault(term, [0] * (2 * CROSS))[part + CROSS * (1 - y)] += 1
            if len(counts) > MEMO:
                yield out()
                counts = {}
        yield out()

    names = ["term", *[f"p{i}" for i in range(CROSS)], *[f"n{i}" for i in range(CROSS)]]
    rows = picked.select(cross_fold(), F.col("y").cast("int"), "text")
    found = rows.mapInArrow(run, ", ".join(["term string", *[f"{n} long" for n in names[1:]]]))
    return found.groupBy("term").agg(*[F.sum(n).alias(n) for n in names[1:]])


def cross_fold():
    return F.pmod(F.xxhash64(F.lit("cross"), "doc_id"), F.lit(CROSS)).cast("int").alias("part")


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    ends: np.ndarray
    mean: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(features), self.mean[0])
        return calibrated(self.trees.margins(features), self.ends, self.mean)


def share_of(positive: np.ndarray, negative: np.ndarray, prior: float) -> np.ndarray:
    return (positive + SMOOTH * prior) / (positive + negative + SMOOTH)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = BYTES) -> Model:
    """Learn from labelled rows outside the held-out fold.

    Lexicon terms are counted over the sample in Spark; the `TERMS` best come to the driver. Each training row's
    features use a lexicon learned without its own fold, so that the trees see words as they'll see those of new texts.
    The trees are fitted on two folds each and scored on the third; these scores calibrate, and all rows make the final trees.
    """
    picked = sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != 1, rows, size)
    totals = picked.groupBy(cross_fold()).agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).toPandas().set_index("part").reindex(range(CROSS), fill_value=0)
    toxic, others = totals["p"].to_numpy(float), (totals["n"] - totals["p"]).to_numpy(float)
    prior = (toxic.sum() + 1) / (toxic.sum() + others.sum() + 2)
    if not toxic.sum() or not others.sum():
        return Model(Lexicon({}), None, np.zeros(1), np.array([prior]))
    all_p, all_n = (sum(F.col(f"{k}{i}") for i in range(CROSS)) for k in "pn")
    share = (all_p + SMOOTH * prior) / (all_p + all_n + SMOOTH)
    terms = term_counts(picked).filter(all_p >= SUPPORT - 1).filter(share >= SHARE / 2).orderBy(share.desc(), "term").limit(TERMS).toPandas()
    p, n = (terms[[f"{k}{i}" for i in range(CROSS)]].to_numpy(float) for k in "pn")

    def lexicon(without: int | None) -> Lexicon:
        kept = [i for i in range(CROSS) if i != without]
        positive, negative = p[:, kept].sum(axis=1), n[:, kept].sum(axis=1)
        value = share_of(positive, negative, prior)
        return Lexicon({t: v for t, v, s in zip(terms["term"], value.tolist(), positive, strict=True) if s >= SUPPORT - 1 and v >= SHARE / 2})

    parts = [lexicon(i) for i in range(CROSS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos: list[dict] = [{} for _ in parts]
        for batch in batches:
            found = [parts[k].features(t, memos[k]) for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "part", "y", "x"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    made = picked.select("doc_id", cross_fold(), "text", "y").mapInArrow(run, f"doc_id {kind}, part int, y int, x array<double>")
    made = made.toPandas().sort_values("doc_id")
    x, y, part = np.array(made["x"].tolist()), made["y"].to_numpy(float), made["part"].to_numpy()
    margins = np.zeros(len(y))
    for k in range(CROSS):
        own = part == k
        if own.any() and not own.all():
            margins[own] = boost(x[~own], y[~own]).margins(x[own])
    return Model(lexicon(None), boost(x, y), *isotonic(margins, y))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 if score >= 0.7).

    The score is a function of the whole text alone. Empty texts and null ones score as texts without any feature. Rows
    that repeat get a row each; an empty table gives an empty result. Without labelled rows of both classes every score
    is the smoothed share of toxic ones. Other columns are not read.
    """
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[float, ...]] = {}
        for texts in batches:
            x = np.array([model.lexicon.features(t, memo) for t in texts.fillna("")], dtype=float).reshape(-1, FEATURES)
            yield pd.Series(model.scores(x), dtype="float64")

    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 1).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


for module in (labelled, boosting, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)
