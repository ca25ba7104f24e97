"""The pipeline against a version in plain Python: no operator of quire.llm decides here but the trained model's weights."""

from collections import Counter

import corpus_pipeline
import pytest

from quire.llm import quality
from tests.llm.cases import documents, prose, row
from tests.llm.test_classifiers import LABELS, plain_quality
from tests.llm.test_decontam import shingles
from tests.llm.test_mixing_sharding import jump, key60, plain_copies
from tests.llm.test_simhash import components, plain_fingerprint


def corpus():
    """Prose, junk, copies, near copies, a benchmark passage, odd texts, and a null source."""
    rows = [row(i, prose(i % 40 + 1, 60 + i % 50), ["web", "books", None, "code"][i % 4]) for i in range(90)]
    rows += [row(100 + i, prose(i % 5 + 1, 60 + i % 5), "copies") for i in range(20)]
    near = prose(50, 400)
    rows += [row(130 + i, near.replace(near.split()[10 * i + 5], "changed", 1), "near") for i in range(8)]
    rows += [row(140 + i, " ".join(w + "%%%" for w in prose(i + 1, 40).split()), "junk") for i in range(30)]
    passage = " ".join(f"item{i}" for i in range(30))
    rows += [row(180, prose(60, 100) + " " + passage, "web"), row(181, passage.upper().replace(" ", ", "), "web"), row(182, " ".join(passage.split()[:12]) + " " + prose(61, 80), "web")]
    rows += [row(190, None), row(191, ""), row(192, "one two")]
    items = [(1, passage, *"abcd"), (2, None, *"abcd"), (3, "never found in any of these texts at all", *"abcd")]
    labels = [(r[0], int(r[3] != "junk"), 0, "x", "y") for r in rows if r[0] < 180]
    return rows, items, labels


def plain(rows, items, model, shards):
    """The rows of the pipeline, with their shard, by loops over all pairs."""
    kept = [r for r in rows if plain_quality(model, r[1] or "") >= 0.3]
    group = components([plain_fingerprint(r[1]) for r in kept])
    first = {}
    for r, g in zip(kept, group, strict=True):
        first.setdefault(g, r)
        if r[0] < first[g][0]:
            first[g] = r
    kept = list(first.values())
    asked = [s for _, t, *_ in items if (s := shingles(t))]
    clean = []
    for r in kept:
        held = shingles(r[1])
        if not any(len(q & held) >= 0.8 * len(q) - 1e-9 for q in asked):
            clean.append(r)
    out = Counter()
    for r, n in zip(clean, plain_copies(clean), strict=True):
        if n:
            out[(r[0], r[1], r[3], jump(key60(r[0]), shards))] += n
    return out


@pytest.fixture
def folder(spark, tmp_path):
    rows, items, labels = corpus()
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string, doc_id string, h string, n string, need string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_the_pipeline_is_that_of_plain_python(spark, folder):
    rows, items, _ = corpus()
    model = quality.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    expected = plain(rows, items, model, corpus_pipeline.SHARDS)
    found = Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == expected
    ids = {k[0] for k in expected}
    assert not ids & {180, 181} and 182 in ids and not ids & set(range(140, 170)) and len(ids & set(range(130, 138))) == 1
