"""Documents and what a model extracted from them, as the tables of the graph: one plan, no request per row.

Documents: locator, kind, title, text. Extractions: locator, json (the contract in
``schemas.EXTRACTION``; fenced or slightly broken JSON is repaired). The model is
outside; its output is a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom import schemas
from graphloom.functions import text as tx
from graphloom.operators import chunking, dedup, ingest

#: Lists of an extraction, the type of their entities, and how those are tied to claims.
LISTS = {"claims": "legal_claim", "evidence": "evidence", "procedures": "legal_procedure", "outcomes": "legal_outcome", "laws": "law"}


@dataclass
class Graph:
    """The tables of an ingest."""

    sources: DataFrame
    text_blobs: DataFrame
    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame
    quotes: DataFrame
    provenance: DataFrame
    skipped: DataFrame


def _rows(parsed: DataFrame) -> DataFrame:
    """One row for each named item: source_id, short_id, id, type, name, description, claim_type, is_critical, linked (short ids of claims), source_quote."""
    none = F.lit(None).cast("string")
    out = None
    for field, kind in LISTS.items():
        item = parsed.select("source_id", F.posexplode(f"e.{field}").alias("pos", "x")).filter(F.coalesce(F.trim("x.name"), F.lit("")) != "")
        links = F.coalesce(F.col("x.claim_ids"), F.when(F.col("x.linked_claim_id").isNotNull(), F.array("x.linked_claim_id"))) if field in ("evidence", "outcomes") else F.lit(None).cast("array<string>")
        entity_id = tx.law_id("x.citation", "x.name") if kind == "law" else tx.entity_id(F.lit(kind), "x.name")
        own = item.select(
            "source_id", F.coalesce("x.id", F.concat(F.lit(f"{field}_"), "pos")).alias("short_id"), entity_id.alias("id"), F.lit(kind).alias("type"), F.trim("x.name").alias("name"), F.col("x.description").alias("description"),
            (F.coalesce(F.col("x.claim_type"), tx.described_claim_type("x.name", "x.description", d.CLAIM_TYPES, d.CLAIM_FRAGMENTS)) if field == "claims" else none).alias("claim_type"),
            (F.coalesce(F.col("x.is_critical"), F.lit(False)) if field == "evidence" else F.lit(None).cast("boolean")).alias("is_critical"),
            (F.coalesce(F.col("x.disposition"), none) if field == "outcomes" else none).alias("outcome"), links.alias("linked"), F.col("x.source_quote").alias("source_quote"),
        )
        out = own if out is None else out.unionByName(own)
    return out


def _located(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Quotes with their offsets in the canonical text; those that it does not contain are dropped."""
    held = rows.filter(F.coalesce("source_quote", F.lit("")) != "").select("source_id", F.col("id").alias("subject_id"), tx.canonical("source_quote").alias("quote")).distinct()
    met = held.join(texts.select("source_id", "text"), "source_id").withColumn("start_offset", F.expr("instr(text, quote)") - 1)
    found = met.filter("start_offset >= 0").withColumn("end_offset", F.col("start_offset") + F.length("quote")).drop("text")
    return ingest.quote_ids(found)


def run(docs: DataFrame, extractions: DataFrame, target: int = 3000, overlap: int = 200, keep_lines: bool = False) -> Graph:
    """All tables of an ingest. Documents of equal canonical text are one source; ``keep_lines`` leaves line ends for the heading split."""
    sources, blobs = ingest.register_sources(docs.dropDuplicates(["locator"]))
    ids = sources.select("locator", "source_id")
    texts = docs.dropDuplicates(["locator"]).join(ids, "locator").select("source_id", "title", (F.col("text") if keep_lines else tx.canonical("text")).alias("text")).dropDuplicates(["source_id"])
    chunks = chunking.chunk_documents(texts, target, overlap)

    parsed = extractions.join(ids, "locator").select("source_id", tx.parsed_json("json", f"struct<{_inner(schemas.EXTRACTION)}>").alias("e")).filter("e is not null")
    rows = _rows(parsed)
    named = rows.select("id", "type", "name", "description", "claim_type", "is_critical", "outcome")
    entities, moved = dedup.by_name(named)
    moved = moved.distinct()

    short = rows.join(moved.select(F.col("old").alias("id"), "new"), "id").select(F.col("source_id").alias("doc"), "short_id", F.col("new").alias("id")).distinct()
    stated = parsed.select(F.col("source_id").alias("doc"), F.explode("e.relationships").alias("r")).select("doc", F.coalesce("r.from", "r.source").alias("from"), F.coalesce("r.to", "r.target").alias("to"), F.upper("r.type").alias("type"))
    checked = ingest.validate_relations(stated, short).withColumn("reason", F.when(F.col("reason") != "valid", F.col("reason")).when(~F.coalesce(F.col("type").isin(*d.RELATIONSHIP_TYPES), F.lit(False)), "unknown type").otherwise("valid"))
    told = ingest.resolve_relations(checked.filter("reason = 'valid'").select("doc", "from", "to", "type"), short).select("src", "dst", "type")
    linked = rows.join(moved.select(F.col("old").alias("id"), "new"), "id").select(F.col("source_id").alias("doc"), "type", F.col("new").alias("id"), F.explode("linked").alias("short_id")).join(short.withColumnRenamed("id", "claim"), ["doc", "short_id"])
    kind = F.when(F.col("type") == "evidence", "HAS_EVIDENCE").otherwise("RESULTS_IN")
    edges = told.unionByName(linked.select(F.col("claim").alias("src"), F.col("id").alias("dst"), kind.alias("type"))).filter("src <> dst").distinct()

    quotes = _located(rows.join(moved.select(F.col("old").alias("id"), "new"), "id").withColumn("id", F.col("new")), texts.withColumn("text", tx.canonical("text")))
    linked_quotes = quotes.join(ingest.link_quotes(quotes.select("quote_id", "source_id", "quote"), chunks.select("source_id", "chunk_index", "text"), ["quote_id"]), "quote_id", "left")
    provenance = ingest.provenance_rows(linked_quotes.select(F.lit("entity").alias("subject_type"), "subject_id", "source_id", "quote_id", "chunk_id"))
    best = linked_quotes.groupBy(F.col("subject_id").alias("id")).agg(F.min_by(F.struct(F.col("quote").alias("text"), "source_id", "chunk_id", F.lit(None).cast("string").alias("explanation")), F.struct(-F.length("quote"), "quote_id")).alias("best_quote"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.count_distinct("source_id").cast("int").alias("mentions_count"))
    return Graph(sources, blobs, chunks, entities.join(best, "id", "left"), edges, linked_quotes.select("quote_id", "source_id", "start_offset", "end_offset", "quote_sha256", "chunk_id").distinct(), provenance, checked.filter("reason <> 'valid'").select("doc", "from", "to", "type", "reason"))


def _inner(ddl: str) -> str:
    """Top-level fields of a DDL string with colons, as inside a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schemas.struct(ddl))


def new_documents(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents whose content no source has yet: what an ingest need not look at again."""
    return docs.withColumn("sha256", tx.sha(tx.canonical("text"))).join(sources.select("sha256").distinct(), "sha256", "left_anti").drop("sha256")
