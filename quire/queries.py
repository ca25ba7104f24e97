"""The queries of the library by name; each shows one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import extraction_queries, store_queries
from quire.functions import rules
from quire.functions import text as tx
from quire.functions import vectors as vx
from quire.operators import chunking, facts, retrieval, sections, triage, validation
from quire.plans import derived
from quire.plans.derived import table
from quire.plans.oracle import CLAIMS, KEYWORDS, TOPICS
from quire.plans.oracle import ORACLE_SQL as OWN_SQL


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.document_lines(spark, sf_dir).filter(tx.strip(F.col("text")) != "")
    return rows.select("document_id", "n", tx.content_hash(F.lit("paragraph"), F.col("text")).alias("content_hash"))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.document_lines(spark, sf_dir).filter(tx.strip(F.col("text")) != "")
    return rows.select("document_id", "n", tx.token_count(F.col("text")).alias("tokens"))


def block_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.document_lines(spark, sf_dir).filter(tx.strip(F.col("text")) != "")
    return rows.select("document_id", "n", tx.looks_like_heading(F.col("text")).alias("heading"), tx.is_list_item(F.col("text")).alias("listed"))


def ldus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ldus(spark, sf_dir)


def ldu_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks anew, which the other queries over units don't."""
    page = F.get("page_refs", F.lit(0)).alias("page")
    return chunking.chunk(*derived.extracted(spark, sf_dir)).select("document_id", "ldu_id", "content_type", "text", page, "token_count", "content_hash", "parent_section_id")


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = F.count_distinct(F.concat("document_id", "parent_section_id")).alias("parents")
    return ldus(spark, sf_dir).groupBy("content_type").agg(F.count(F.lit(1)).alias("units"), F.count("parent_section_id").alias("with_parent"), parents)


def digest_sum(*cols: str) -> Column:
    """A sum over rows that tells sets of them apart: of the first 8 hex digits of their MD5. No list is gathered for it."""
    return F.sum(F.conv(F.substring(F.md5(F.concat_ws(" ", *cols)), 1, 8), 16, 10).cast("long")).alias("digest")


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of references, and a digest of them."""
    refs = ldus(spark, sf_dir).select("document_id", "ldu_id", F.explode(F.flatten(F.map_values("relationships"))).alias("target"))
    return refs.groupBy("document_id").agg(F.count(F.lit(1)).alias("refs"), digest_sum("ldu_id", "target"))


def ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    units = ldus(spark, sf_dir)
    return units, sections.section_ranges(units, derived.page_counts(spark, sf_dir))


def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges(spark, sf_dir)[1].select("document_id", "section_id", "title", "level", "page_start", "page_end")


def section_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is in which section: a row for each unit of each section."""
    return sections.section_members(*ranges(spark, sf_dir)).select("document_id", "section_id", "ldu_id")


def section_data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.build_index(ldus(spark, sf_dir), derived.page_counts(spark, sf_dir))
    return rows.select("document_id", "section_id", F.array_join("data_types_present", ",").alias("data_types"), F.size("ldu_ids").cast("long").alias("units"))


def topic_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = sections.build_index(ldus(spark, sf_dir), derived.page_counts(spark, sf_dir))
    found = sections.navigate(index, spark.createDataFrame(list(TOPICS), "topic_id string, topic string"))
    return found.select("topic_id", "document_id", "section_id", "score", "rank")


def table_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table_facts(ldus(spark, sf_dir)).select("document_id", "seq", "entity", "metric", "value")


def keyvalue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.text_facts(ldus(spark, sf_dir)).filter(F.col("at.a") == 0).select("document_id", "seq", "metric", "value")


def period_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.text_facts(ldus(spark, sf_dir)).filter(F.col("at.a") == 1).select("document_id", "seq", "value")


def claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CLAIMS), "query_id string, query string")


def fact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.search_facts(facts.extract_facts(ldus(spark, sf_dir)), claims(spark))
    return found.select("query_id", "rank", "document_id", "entity", "metric", "value")


def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ldus(spark, sf_dir)
    found = facts.search_facts(facts.extract_facts(units), claims(spark))
    hits = retrieval.nearest(retrieval.embedded(units, vx.embedding_digest), retrieval.embedded_questions(claims(spark)), 10)
    cited = retrieval.evidence(claims(spark), hits, found)
    return retrieval.audits(claims(spark), cited).select("query_id", "n_items", "status")


def vectors(spark: SparkSession, sf_dir: str, label: int | None = None, labels: tuple[int, ...] = ()) -> DataFrame:
    """Neighbours of each fiftieth vector among all, those of some documents (here a label is one), or those of chosen units."""
    rows = table(spark, sf_dir, "embeddings").withColumn("document_id", F.col("label").cast("string"))
    asked = rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    within = None if label is None else rows.filter(F.col("label") == label).select("vec_id")
    found = retrieval.nearest(rows, asked, 5, keys=("vec_id",), within=within, document_ids=[str(x) for x in labels])
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir)


def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, labels=(1, 3))


def section_narrowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir, label=2)


def deterministic_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", vx.deterministic_embedding(F.col("text")).alias("v"))
    return rows.select("item_id", F.posexplode("v").alias("place", "value")).withColumn("value", F.round("value", 9))


def provenance_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("query_id"), (F.col("l_partkey") % 200).cast("string").alias("document_id"), F.col("l_linenumber").alias("page_number"),
        F.col("l_returnflag").alias("content_hash"), (F.col("l_linenumber") % 2).alias("source"), F.col("l_orderkey").alias("rank"), F.lit("").alias("ldu_id"), F.lit("").alias("snippet"),
    )
    return retrieval.first_citations(rows).select("query_id", "document_id", "page_number", "content_hash", "source", "rank")


def origin_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.origins(derived.signal_pages(spark, sf_dir)).select("document_id", "pages", "origin", "origin_confidence")


def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.layouts(derived.signal_pages(spark, sf_dir))


def cost_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.cost_rules(spark, sf_dir)


def strategy_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cost_rules(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(name).alias("strategy"), *derived.attempted(F.col("document_id"), s)) for s, name in enumerate(rules.STRATEGIES, 1)])
    tries = found.select("document_id", F.inline(each))
    out = triage.cascade(found, tries, refused=found.filter(F.col("document_id") % 11 == 0).select("document_id"))
    return out.select("document_id", "strategy_used", "confidence", F.array_join("escalation_chain", ">").alias("chain"), "notes")


def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategy_cascade(spark, sf_dir).groupBy("strategy_used").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("confidence"), 4).alias("confidence"))


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*[F.lit(t) for _, _, t in KEYWORDS])
    term = lambda i, n: F.get(terms, (i % n).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    # 30 keywords; the first position may lie beyond them, where there is none
    text = F.concat(F.lit("The "), term(key, 37), F.lit(" and the "), term(size, 30), F.lit(" of "), term(key + size, 30))
    found = triage.domains(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("document_id"), text.alias("text")))
    return found.select("document_id", "domain", F.round("domain_confidence", 6).alias("domain_confidence"))


def fast_text_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = triage.fast_text_scores(derived.measured_pages(spark, sf_dir))
    return found.select("document_id", "chars", "pages", "low_pages", "missing_text", F.round("score", 6).alias("score"))


def density_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.densities(derived.measured_pages(spark, sf_dir))


def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ldus(spark, sf_dir)
    bad = bad.withColumn("page_refs", F.when(F.col("seq") % 97 == 0, F.array().cast("array<int>")).otherwise(F.col("page_refs")))
    bad = bad.withColumn("content_hash", F.when(F.col("seq") % 89 == 0, "").otherwise(F.col("content_hash")))
    bad = bad.withColumn("parent_section_id", F.when(F.col("seq") % 83 != 0, F.col("parent_section_id")))
    return validation.chunk_errors(bad).groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("errors"))


OWN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        content_hash, token_count, block_classification, ldu_chunking, section_carry_forward, cross_references, section_ranges, section_membership,
        section_data_types, topic_topn, table_facts, keyvalue_facts, period_facts, fact_search, claim_audit, vector_topk, vector_topk_filtered,
        section_narrowed_search, deterministic_embedding, provenance_dedupe, origin_rules, layout_rules, cost_rules, strategy_cascade, ledger_summary,
        domain_rules, fast_text_confidence, density_stats, chunk_validation,
    )
}

QUERIES = OWN | {name: query for module in (extraction_queries, store_queries) for name, (query, _) in module.ENTRIES.items()}
ORACLE_SQL = OWN_SQL | {name: sql for module in (extraction_queries, store_queries) for name, (_, sql) in module.ENTRIES.items()}
