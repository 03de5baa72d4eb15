"""From extraction output to graph rows: ids, links to chunks, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def document_edges(held: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """src, dst, type: from a document to the entities found in it, the type by the entity's."""
    kind = F.lit(None).cast("string")
    for entity_type, edge in kinds.items():
        kind = F.when(F.col("entity").startswith(f"{entity_type}:"), edge).otherwise(kind)
    return held.select(F.col("document").alias("src"), F.col("entity").alias("dst"), kind.alias("type")).filter("type is not null").distinct()


def resolve_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations (doc, from, to) with the ids that short names stand for within their document (doc, short_id, id); others are dropped."""
    a = ids.select("doc", F.col("short_id").alias("from"), F.col("id").alias("src"))
    b = ids.select("doc", F.col("short_id").alias("to"), F.col("id").alias("dst"))
    return relations.join(a, ["doc", "from"]).join(b, ["doc", "to"])


def validate_relations(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with a reason: valid, unknown source or unknown target."""
    a = ids.select("doc", F.col("short_id").alias("from"), F.lit(True).alias("has_from")).distinct()
    b = ids.select("doc", F.col("short_id").alias("to"), F.lit(True).alias("has_to")).distinct()
    met = relations.join(a, ["doc", "from"], "left").join(b, ["doc", "to"], "left")
    return met.withColumn("reason", F.when(F.col("has_from").isNull(), "unknown source").when(F.col("has_to").isNull(), "unknown target").otherwise("valid"))


def link_quotes(quotes: DataFrame, chunks: DataFrame, keys: list[str], prefix: int = 80) -> DataFrame:
    """For each quote the first chunk of its source that contains its beginning, else the source's first chunk."""
    hit = F.contains("text", F.substring("quote", 1, prefix))
    met = quotes.join(chunks.select("source_id", "chunk_index", "text"), "source_id").groupBy(*dict.fromkeys([*keys, "source_id"])).agg(F.min(F.when(hit, F.col("chunk_index"))).alias("hit"), F.min("chunk_index").alias("first"))
    return met.select(*keys, F.concat_ws(":", "source_id", F.coalesce("hit", "first")).alias("chunk_id"), F.col("hit").isNotNull().alias("found"))


def register_sources(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, text_blobs) of documents (locator, kind, title, text): canonical text, hash, id from the content; blobs once each."""
    held = docs.select("locator", "kind", "title", tx.canonical("text").alias("text"))
    sources = held.select(tx.content_uuid("text").alias("source_id"), "locator", "kind", "title", tx.sha("text").alias("sha256"))
    blobs = held.select(F.concat(F.lit("t:"), tx.sha("text")).alias("blob_id"), tx.sha("text").alias("sha256"), "text", F.length("text").alias("length")).dropDuplicates(["blob_id"])
    return sources, blobs


def reuse_chunks(new: DataFrame, known: DataFrame) -> DataFrame:
    """chunk_id, content_hash, use_id: the chunk whose content a new one repeats, among known ones first, then in its batch; itself if none."""
    held = known.groupBy("content_hash").agg(F.min("chunk_id").alias("known_id"))
    first = F.first("chunk_id").over(Window.partitionBy("content_hash").orderBy("source_id", "chunk_index"))
    return new.withColumn("first_id", first).join(held, "content_hash", "left").select("chunk_id", "content_hash", F.coalesce("known_id", "first_id").alias("use_id"))


def remap_chunk_ids(entities: DataFrame, moved: DataFrame) -> DataFrame:
    """Entities (id, chunk_ids) with chunk ids replaced (chunk_id, use_id), once each, in order."""
    each = entities.select("id", F.posexplode("chunk_ids").alias("pos", "chunk_id")).join(moved.select("chunk_id", "use_id"), "chunk_id", "left")
    kept = each.groupBy("id", F.coalesce("use_id", "chunk_id").alias("use_id")).agg(F.min("pos").alias("pos"))
    return kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "use_id"))), lambda x: x["use_id"]).alias("chunk_ids"))


def quote_ids(quotes: DataFrame) -> DataFrame:
    """Adds quote_id and quote_sha256; offsets refer to canonical text."""
    return quotes.withColumn("quote_id", F.concat_ws(":", F.lit("q"), "source_id", "start_offset", "end_offset")).withColumn("quote_sha256", tx.sha("quote"))


def provenance_rows(rows: DataFrame) -> DataFrame:
    """Adds prov_id, the hash of what it links; one row for each."""
    key = F.concat_ws(":", "subject_type", "subject_id", "source_id", F.coalesce("quote_id", F.lit("")), F.coalesce("chunk_id", F.lit("")))
    return rows.withColumn("prov_id", F.concat(F.lit("prov:"), F.sha2(key.cast("binary"), 256))).dropDuplicates(["prov_id"])


def evidence_to_claims(evidence: DataFrame, claims: DataFrame, dictionary, per_evidence: int = 3) -> DataFrame:
    """src, dst, type (REQUIRES): evidence (id, text) tied to the first claims (claim, claim_type) of the first type whose words its text contains."""
    from .graph import first_per

    typed = evidence.select(F.col("id").alias("dst"), tx.first_key("text", dictionary).alias("claim_type")).filter("claim_type is not null")
    firsts = first_per(claims, ["claim_type"], ["claim"], per_evidence).select("claim_type", F.col("claim").alias("src"))
    return typed.join(firsts, "claim_type").select("src", "dst", F.lit("REQUIRES").alias("type"))
