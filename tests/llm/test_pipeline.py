from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quire.llm import decontam, mixing, quality, sharding, simhash
from tests.llm.cases import documents, empty, odd_documents


def test_stages_are_those_of_the_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    labels, benchmark = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    scored = {r["doc_id"]: r["predicted"] for r in quality.scored(docs, labels).collect()}
    kept = docs.filter(F.col("doc_id").isin([i for i, p in scored.items() if p]))
    first = kept.filter(F.col("doc_id").isin([r["component_id"] for r in simhash.near_duplicates(kept).collect()]))
    clean = first.filter(~F.col("doc_id").isin([r["doc_id"] for r in decontam.contaminated(first, benchmark).collect()]))
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()})
    out = corpus_pipeline.run(spark, small)
    assert out.columns == [*names, "shard"]
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == +copies
    shards = {r["doc_id"]: r["shard"] for r in sharding.assign(clean).collect()}
    assert all(r["shard"] == shards[r["doc_id"]] for r in rows)


def test_stages_on_odd_and_empty_documents(spark, small):
    for docs in (documents(spark, odd_documents()), empty(spark)):
        names = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            assert [c for c in out.columns if c != "shard"] == [c for c in names if c != "shard"] or k == 4
            out.write.format("noop").mode("overwrite").save()
