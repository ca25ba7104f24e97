"""Incremental ingestion: extracted elements arrive as files, each batch is chunked whole and appended or replaced by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunking import chunk
from quire.operators.facts import extract_facts
from quire.operators.retrieval import embedded
from quire.operators.validation import accepted

ELEMENT = (
    "document_id string, ref_type string, id string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, order int, text string, title string, "
    "caption string, alt_text string, type string, header array<string>, rows array<array<string>>"
)


def split_elements(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Blocks, tables, figures and reading order from rows of one kind, as a batch holds them."""
    own = ["document_id", "id", "page_number", "bbox"]
    of = lambda kind: elements.filter(F.col("ref_type") == kind)
    blocks = of("text_block").select(*own, "text", F.col("order").alias("reading_order_index"))
    tables = of("table").select(*own, "title", "caption", "header", "rows")
    figures = of("figure").select(*own, "caption", "alt_text", "type")
    return blocks, tables, figures, elements.select("document_id", "ref_type", F.col("id").alias("ref_id"), "order")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Start a query that turns what arrives in `source` (JSON lines of ELEMENT) into units, facts and vectors under `target`.

    A document arrives whole, in one file. Each batch writes its own folder, batch=<id>, by overwriting it: a batch that
    is run again after a failure replaces what it had written, so each is there exactly once. Readers take, of a document
    that came several times, the rows of the last batch that had it: see latest().
    """
    arriving = spark.readStream.schema(ELEMENT).json(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        units = accepted(chunk(*split_elements(batch))).persist()
        facts = extract_facts(units)
        for name, rows in (("ldus", units), ("facts", facts), ("vectors", embedded(units))):
            rows.write.mode("overwrite").parquet(f"{target}/{name}/batch={batch_id}")
        # last: before it is there nothing of the batch is read
        batch.select("document_id").distinct().write.mode("overwrite").parquet(f"{target}/documents/batch={batch_id}")
        units.unpersist()
        batch.unpersist()

    return arriving.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The rows of a table that ingest() writes, of each document those of the last batch that had it.

    A document that came again without facts, or whose units were refused, has none: what counts is that it came.
    """
    rows, came = spark.read.parquet(f"{target}/{name}"), spark.read.parquet(f"{target}/documents")
    last = came.groupBy(F.col("document_id").alias("of")).agg(F.max("batch").alias("last"))
    return rows.join(last, (F.col("document_id") == F.col("of")) & (F.col("batch") == F.col("last")), "left_semi").drop("batch")


def ledger_counts(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Runs and mean confidence by strategy and time window, of a stream of ledger entries; late ones count until `delay`."""
    timed = events.withWatermark("start_time", delay).groupBy(F.window("start_time", window), "strategy_used")
    return timed.agg(F.count(F.lit(1)).alias("runs"), F.avg("confidence_score").alias("confidence"))


__all__ = ["ELEMENT", "ingest", "latest", "ledger_counts", "split_elements"]
