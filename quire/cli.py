"""The command line: profiles, answers, audits and looks at tables, over stores that sinks have written.

    python -m quire.cli triage --signals PATH --texts PATH
    python -m quire.cli ask QUESTION --store DIR [--document ID] [--top-k N]
    python -m quire.cli audit CLAIM --store DIR [--document ID]
    python -m quire.cli inspect PATH
    python -m quire.cli query NAME --tables DIR

A store is a folder with index, vectors, facts, and if there are any names.json.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from quire.operators import facts, retrieval, triage
from quire.plans.config import environment, load_rules
from quire.sources import readers

DEFAULT_QUESTION = "overview contents subject"


def names_of(spark: SparkSession, store: str) -> DataFrame | None:
    """The document names of a store, if it has any."""
    try:
        return readers.document_names(spark, f"{store}/names.json")
    except AnalysisException:
        return None


def printed_citations(items: list[Row]) -> None:
    """A line of tab-separated fields for each citation: document and page, sides of the box, hash."""
    for item in items:
        sides = " ".join(f"{v:g}" for v in item["bbox"]) if item["bbox"] else "-"
        print(f"{item['document_name']} p.{item['page_number']}\t{sides}\t{item['content_hash']}")
    if not items:
        print("(no citations)")


def ask(spark: SparkSession, question: str, store: str, document: str | None = None, top_k: int = 10) -> int:
    """Print the answer to one question and what it cites."""
    asked = spark.createDataFrame([("q", question, document)], "query_id string, query string, document_id string")
    index, vectors, found = readers.section_index(spark, f"{store}/index"), readers.vectors(spark, f"{store}/vectors"), readers.facts(spark, f"{store}/facts")
    answer = retrieval.answers(asked, index, vectors, found, names_of(spark, store), top_k=top_k).first()
    print(f"{answer['answer']}\n\nverified: {answer['verified']}")
    printed_citations(answer["items"] or [])
    return 0


def audit(spark: SparkSession, claim: str, store: str, document: str | None = None) -> int:
    """Print whether a claim is supported, and by what; 0 if it is, else 1."""
    asked = spark.createDataFrame([("q", claim, document)], "query_id string, query string, document_id string")
    vectors, found = readers.vectors(spark, f"{store}/vectors"), readers.facts(spark, f"{store}/facts")
    hits = retrieval.nearest(vectors, retrieval.embedded_questions(asked), 10, document_ids=[document] if document else None)
    cited = retrieval.evidence(asked, hits, facts.search_facts(found, asked), names_of(spark, store))
    result = retrieval.audits(asked, cited).first()
    print(f"{result['response']}\n\nVerified: {result['verified']} ({result['status']})")
    printed_citations(cited.orderBy("place").collect())
    return 0 if result["verified"] else 1


def triaged(spark: SparkSession, signals: str, texts: str, rules: str | None = None) -> int:
    """Print a profile as JSON for each document of a table of page signals and one of page texts (document_id, page, text)."""
    config = load_rules(rules)
    found = triage.profiles(spark.read.parquet(signals), triage.sample_text(spark.read.parquet(texts), config.domain), config)
    for line in found.toJSON().toLocalIterator():
        print(line)
    return 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("triage")
    one.add_argument("--signals", required=True)
    one.add_argument("--texts", required=True)
    one.add_argument("--rules")
    for name in ("ask", "audit"):
        one = commands.add_parser(name)
        one.add_argument("text", nargs="?" if name == "ask" else None)
        one.add_argument("--store", default=".quire")
        one.add_argument("--document")
        if name == "ask":
            one.add_argument("--top-k", type=int, default=10)
    commands.add_parser("inspect").add_argument("path")
    one = commands.add_parser("query")
    one.add_argument("name")
    one.add_argument("--tables", required=True)
    given = parser.parse_args(arguments)
    environment()
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if given.command == "triage":
        return triaged(spark, given.signals, given.texts, given.rules)
    if given.command == "ask":
        return ask(spark, (given.text or "").strip() or DEFAULT_QUESTION, given.store, given.document, given.top_k)
    if given.command == "audit":
        return audit(spark, given.text, given.store, given.document)
    if given.command == "inspect":
        print(json.dumps(readers.inspect(readers.table(spark, given.path)), default=str, ensure_ascii=False, indent=2))
        return 0
    from quire.queries import QUERIES

    QUERIES[given.name](spark, given.tables).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
