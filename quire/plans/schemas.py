"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
TEXT_BLOCKS = "document_id string, id string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, text string, reading_order_index int"
TABLES = (
    "document_id string, id string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, title string, caption string, "
    "header array<string>, rows array<array<string>>"
)
FIGURES = "document_id string, id string, page_number int, bbox struct<x0:double,y0:double,x1:double,y1:double>, caption string, alt_text string, type string"
READING_ORDER = "document_id string, ref_type string, ref_id string, order int"
PAYLOAD = (
    "struct<header:array<string>,rows:array<array<string>>,title:string,caption:string,label:string,alt_text:string,type:string,list_complete:boolean>"
)
LDUS = (
    f"document_id string, ldu_id string, seq int, content_type string, text string, raw_payload {PAYLOAD}, page_refs array<int>, "
    "bounding_boxes array<struct<x0:double,y0:double,x1:double,y1:double>>, parent_section_id string, token_count int, content_hash string, "
    "relationships map<string,array<string>>"
)
FACTS = (
    "document_id string, entity string, metric string, value string, unit string, period string, category_path string, "
    "source_reference struct<bbox:array<double>,content_hash:string,document_id:string,ldu_id:string,page:int>, source_page int, "
    "seq int, at struct<a:int,b:int>, fact_id long, created_at timestamp"
)
PAGE_SIGNALS = "document_id string, page int, chars int, image_ratio double, table_ratio double, table_regions int, columns int"
LEDGER = (
    "document_id string, strategy_used string, origin_type string, layout_complexity string, start_time timestamp, end_time timestamp, "
    "processing_time_ms long, confidence_score double, cost_estimate_usd double, token_usage_prompt long, token_usage_completion long, "
    "escalation_chain array<string>, notes string"
)
VECTORS = (
    "document_id string, ldu_id string, seq int, content string, content_type string, page_number int, content_hash string, "
    "bbox struct<x0:double,y0:double,x1:double,y1:double>, parent_section_id string, embedding array<double>"
)
ATTEMPTS = "document_id string, strategy string, has_document boolean, confidence double, notes string"
