"""Schemas of the stored tables, as DDL; readers take them, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

QUOTE = "STRUCT<text: STRING, source_id: STRING, chunk_id: STRING, explanation: STRING>"
SOURCE_METADATA = "STRUCT<source: STRING, source_type: STRING, authority: STRING, document_type: STRING, organization: STRING, title: STRING, jurisdiction: STRING, created_at: TIMESTAMP, processed_at: TIMESTAMP, last_updated: TIMESTAMP, cites: ARRAY<STRING>, attributes: MAP<STRING, STRING>>"

ENTITIES = f"""id STRING, type STRING, name STRING, description STRING, jurisdiction STRING, attributes MAP<STRING, STRING>, source_metadata {SOURCE_METADATA},
  best_quote {QUOTE}, all_quotes ARRAY<{QUOTE}>, chunk_ids ARRAY<STRING>, source_ids ARRAY<STRING>, mentions_count INT, provenance ARRAY<STRUCT<source: STRING, quote: STRING, authority: STRING, title: STRING>>,
  claim_type STRING, claim_status STRING, claimant STRING, respondent_party STRING, relief_sought ARRAY<STRING>, evidence_context STRING, is_critical BOOLEAN, linked_claim_type STRING,
  case_name STRING, court STRING, docket_number STRING, decision_date DATE, filing_date DATE, parties MAP<STRING, ARRAY<STRING>>, holdings ARRAY<STRING>,
  procedural_history ARRAY<STRUCT<event: STRING, date: DATE, description: STRING>>, citations ARRAY<STRING>, outcome STRING, ruling_type STRING, relief_granted ARRAY<STRING>, damages_awarded DOUBLE, claim_types ARRAY<STRING>"""
EDGES = "src STRING, dst STRING, type STRING, weight DOUBLE, conditions STRING, strength DOUBLE, evidence_level STRING, attributes MAP<STRING, STRING>"
SOURCES = "source_id STRING, locator STRING, kind STRING, title STRING, jurisdiction STRING, sha256 STRING, fetched_at TIMESTAMP"
TEXT_BLOBS = "blob_id STRING, sha256 STRING, text STRING, length INT"
QUOTES = "quote_id STRING, source_id STRING, start_offset INT, end_offset INT, quote_sha256 STRING, chunk_id STRING"
PROVENANCE = "prov_id STRING, subject_type STRING, subject_id STRING, source_id STRING, quote_id STRING, citation STRING, chunk_id STRING, chunk_index INT, added_at TIMESTAMP"
CHUNKS = """chunk_id STRING, source_id STRING, chunk_index INT, content_hash STRING, prev_chunk_id STRING, next_chunk_id STRING, text STRING, token_count INT, title STRING, section STRING, source STRING, source_type STRING,
  doc_title STRING, document_type STRING, jurisdiction STRING, organization STRING, tags ARRAY<STRING>, entities ARRAY<STRING>, description STRING, proves STRING, `references` STRING, case_document_id STRING, case_name STRING,
  court STRING, docket_number STRING, decision_date DATE, embedding ARRAY<FLOAT>"""
JOBS = "job_id STRING, status STRING, seq BIGINT, total INT, processed INT, failed INT, skipped INT, at TIMESTAMP"
CACHE = "key STRING, data STRING, created_at TIMESTAMP, expires_at TIMESTAMP"
#: What a model returns for a document; both forms of links are accepted.
EXTRACTION = """claims ARRAY<STRUCT<id: STRING, name: STRING, claim_type: STRING, description: STRING, relief_sought: ARRAY<STRING>, source_quote: STRING, claimant: STRING, respondent: STRING, status: STRING>>,
  evidence ARRAY<STRUCT<id: STRING, name: STRING, description: STRING, is_critical: BOOLEAN, evidence_context: STRING, linked_claim_id: STRING, claim_ids: ARRAY<STRING>, source_quote: STRING, type: STRING, evidence_source_type: STRING>>,
  procedures ARRAY<STRUCT<id: STRING, name: STRING, description: STRING, steps: ARRAY<STRING>, source_quote: STRING>>,
  outcomes ARRAY<STRUCT<id: STRING, name: STRING, outcome_type: STRING, description: STRING, linked_claim_id: STRING, claim_ids: ARRAY<STRING>, disposition: STRING, decision_maker: STRING, source_quote: STRING>>,
  laws ARRAY<STRUCT<id: STRING, name: STRING, citation: STRING, description: STRING, source_quote: STRING>>,
  relationships ARRAY<STRUCT<`from`: STRING, `to`: STRING, source: STRING, target: STRING, type: STRING>>"""

TABLES = {"entities": ENTITIES, "edges": EDGES, "sources": SOURCES, "text_blobs": TEXT_BLOBS, "quotes": QUOTES, "provenance": PROVENANCE, "chunks": CHUNKS, "jobs": JOBS, "cache": CACHE}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
