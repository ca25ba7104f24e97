"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, then softmax."""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import labelled
from quire.llm.labelled import fold, sample

#: The sample: at most so many labelled rows, with so many bytes of text together. It bounds the driver's memory.
ROWS, BYTES = 3000, 24_000_000
BUCKETS, DIM, EPOCHS, RATE = 1 << 15, 8, 6, 0.5
NGRAMS = (3, 4, 5)
FOLDS, THRESHOLD = 5, 0.3
#: Longer words are cut into words of this length, so that a text without spaces is no single word.
LONGEST = 64
#: Words whose scores a Python worker keeps.
MEMO = 400_000
#: Documents whose new words are scored together.
GROUP = 64
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REPEAT, DOCUMENT = crc32(b"r:") % BUCKETS, crc32(b"d:") % BUCKETS


def words_of(text: str) -> list[str]:
    words = text.split()
    if words and max(map(len, words)) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def shape(word: str) -> str:
    """Case, length and the punctuation around a word: what it looks like, whatever its letters."""
    core = word.strip(EDGE)
    case = "0" if not core else "U" if core.isupper() else "l" if core.islower() else "T" if core.istitle() else "m"
    tail = word[len(word.rstrip(EDGE)) :]
    return f"s:{case}{min(len(core), 20) // 4}{word[:1] if word[:1] in EDGE else ''}|{tail[:3]}"


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The word's number and the bucket of each character n-gram of the words, each between < and >."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    owners, buckets = [], []
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) ^ codes[at + i]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        owners.append(owner[at])
        buckets.append((h >> np.uint64(40)).astype(np.int64) % BUCKETS)
    return np.concatenate(owners), np.concatenate(buckets)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each word itself and of its shape."""
    whole = [crc32(b"w:" + w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words]
    look = [crc32(shape(w).encode("utf-8", "surrogatepass")) % BUCKETS for w in words]
    return np.array(whole, np.int64), np.array(look, np.int64)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and weights of a document.

    A word weighs as its own vector, its shape's, and the mean of its n-grams', the mean over all words is taken. A
    word that repeats the one before adds a vector of its own. Each document has one more, all that an empty one has.
    """
    words = words_of(text)
    buckets, weights = [np.array([DOCUMENT])], [np.ones(1)]
    if words:
        counted = Counter(words)
        distinct, n = list(counted), np.fromiter(counted.values(), np.float64) / len(words)
        owner, grams = ngram_buckets(distinct)
        whole, look = word_buckets(distinct)
        buckets += [whole, look, grams, np.array([REPEAT])]
        weights += [n, n, (n / np.bincount(owner, minlength=len(distinct)))[owner], np.array([sum(map(eq, words, words[1:])) / len(words)])]
    ids, where = np.unique(np.concatenate(buckets), return_inverse=True)
    return ids.astype(np.int32), np.bincount(where, np.concatenate(weights)).astype(np.float32)


@dataclass
class Model:
    """Per bucket the log-odds that its vector adds: softmax over two classes needs no more to score."""

    logit: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, grams = ngram_buckets(words)
        whole, look = word_buckets(words)
        of_grams = np.bincount(owner, self.logit[grams], len(words)) / np.bincount(owner, minlength=len(words))
        return self.logit[whole] + self.logit[look] + of_grams

    def scores(self, texts: list[str], memo: dict[str, float]) -> list[float]:
        split = [words_of(t) for t in texts]
        counted = [Counter(words) for words in split]
        if len(memo) > MEMO:
            memo.clear()
        new = list({w for c in counted for w in c if w not in memo})
        for i in range(0, len(new), 20_000):
            memo.update(zip(new[i : i + 20_000], self.word_scores(new[i : i + 20_000]).tolist(), strict=True))
        found = []
        for words, c in zip(split, counted, strict=True):
            z = self.bias + float(self.logit[DOCUMENT])
            if words:
                z += (sum(n * memo[w] for w, n in c.items()) + float(self.logit[REPEAT]) * sum(map(eq, words, words[1:]))) / len(words)
            found.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
        return found


def fit(texts: list[str], y: list[int], seed: int = 7) -> Model:
    """Stochastic gradient descent over documents in a fixed random order, with a rate that falls to zero.

    With rows of one class only, or none, the model is the smoothed share of class 1.
    """
    prior = (sum(y) + 1) / (len(y) + 2)
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS), float(np.log(prior / (1 - prior))))
    random = np.random.default_rng(seed)
    features = [document_features(t) for t in texts]
    vectors = random.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, step = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(y)):
            rate = RATE * (1 - step / steps)
            ids, weights = features[i]
            hidden = weights @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= rate * error
            vectors[ids] -= rate * np.outer(weights, back)
            step += 1
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = BYTES) -> Model:
    """A model of labels.quality, from labelled rows outside the held-out fold. Only `sample` reaches the driver."""
    picked = sample(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != 0, rows, size).toPandas().sort_values("doc_id")
    return fit(picked["text"].tolist(), picked["y"].tolist())


def scorer(model: Model):
    """A column function from text to score; a null text counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, float] = {}
        for texts in batches:
            texts = texts.fillna("").tolist()
            yield pd.Series([s for i in range(0, len(texts), GROUP) for s in model.scores(texts[i : i + GROUP], memo)], dtype="float64")

    return score


def predicted(score: Column, threshold: float = THRESHOLD) -> Column:
    return F.when(score >= threshold, 1).otherwise(0)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 if score >= 0.3).

    The score is a function of the whole text alone. Empty texts and null ones get the score of a text without words.
    Rows that repeat get a row each; an empty table gives an empty result. Without labelled rows of both classes every
    score is the smoothed share of class 1. Other columns are not read.
    """
    score = scorer(train(docs, labels))
    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", predicted(F.col("score")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects, with the columns of docs.

    Null and empty texts are judged like a text without words; rows that repeat are judged alike; an empty table stays empty.
    Without labelled rows of both classes all rows share one score, so all stay or all go.
    """
    score = scorer(train(docs, labels))
    return docs.withColumn("__quire_score", score("text")).filter(predicted(F.col("__quire_score")) == 1).drop("__quire_score")


for module in (labelled, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)
