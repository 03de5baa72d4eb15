"""Queries of §2.E and §2.F: aggregations, ordering, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx
from graphloom.operators import audit, graph, predict, retrieval
from graphloom.operators.chunking import SENTENCE

from .catalog import query
from .projection import CHUNKS_SQL, EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, chunks, edges, entities, with_sql

EE = with_sql(ENTITIES_SQL, EDGES_SQL)


@query("e1_entities_by_type", f"{EE} SELECT type, count(*) AS n FROM entities GROUP BY 1")
def _(t):
    return audit.by_type(entities(t))


@query("e1_edges_by_type", f"{EE} SELECT type, count(*) AS n FROM edges GROUP BY 1")
def _(t):
    return audit.by_type(edges(t))


@query("e2_claim_types", f"{EE} SELECT DISTINCT claim_type FROM entities WHERE claim_type IS NOT NULL")
def _(t):
    return entities(t).select("claim_type").filter("claim_type is not null").distinct()


@query("e3_law_citations", f"{GRAPH_SQL} SELECT b.other AS law, l.name, l.description, count(*) AS citations FROM both_ways b JOIN entities l ON l.id = b.other AND l.type = 'law' JOIN entities c ON c.id = b.node AND c.type = 'legal_claim' GROUP BY 1, 2, 3 ORDER BY citations DESC, law LIMIT 8")
def _(t):
    ent = entities(t)
    near = graph.undirected(edges(t, ("law", "legal_claim"))).join(ent.filter("type = 'legal_claim'").select(F.col("id").alias("node")), "node", "left_semi")
    met = near.groupBy("other").agg(F.count(F.lit(1)).alias("n")).join(ent.filter("type = 'law'").select(F.col("id").alias("other"), "name", "description"), "other")
    return met.groupBy(F.col("other").alias("law"), "name", "description").agg(F.sum("n").alias("citations")).orderBy(F.desc("citations"), "law").limit(8)


@query("e4_remedy_citations", f"{EE} SELECT trim(regexp_replace(o.name, '[0-9]+(\\.[0-9]+)?%', '', 'g')) AS remedy, count(*) AS citations, min(o.id) AS first_id FROM edges e JOIN entities o ON o.id = e.dst AND o.type = 'legal_outcome' WHERE e.type IN ('RESULTS_IN', 'AUTHORIZES') GROUP BY 1 ORDER BY citations DESC, remedy LIMIT 6")
def _(t):
    met = edges(t).filter("type in ('RESULTS_IN', 'AUTHORIZES')").join(entities(t).filter("type = 'legal_outcome'").select(F.col("id").alias("dst"), "name"), "dst")
    return met.groupBy(tx.clean_remedy("name").alias("remedy")).agg(F.count(F.lit(1)).alias("citations"), F.min("dst").alias("first_id")).orderBy(F.desc("citations"), "remedy").limit(6)


@query("e5_table_counts", f"{with_sql(ENTITIES_SQL, EDGES_SQL, CHUNKS_SQL)} SELECT 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'chunks', count(*) FROM chunks")
def _(t):
    return audit.table_counts({"entities": entities(t), "edges": edges(t), "chunks": chunks(t)})


@query("e6_orphans", f"{GRAPH_SQL} SELECT e.type, count(*) FILTER (WHERE b.node IS NULL) AS orphans, count(*) AS total, CAST(floor(count(*) FILTER (WHERE b.node IS NULL) * 100 / count(*)) AS BIGINT) AS percent FROM entities e LEFT JOIN (SELECT DISTINCT node FROM both_ways) b ON b.node = e.id GROUP BY 1")
def _(t):
    return audit.orphans(entities(t), edges(t))


@query("e7_chunk_linkage", f"{with_sql(CHUNKS_SQL)} SELECT lang AS type, count(*) FILTER (WHERE n > 1) AS \"with\", count(*) FILTER (WHERE n <= 1) AS without, round(avg(CASE WHEN n > 1 THEN 1 ELSE 0 END) * 100, 4) AS percent FROM (SELECT source_id, min(lang) AS lang, count(*) AS n FROM chunks GROUP BY 1) GROUP BY 1")
def _(t):
    held = chunks(t).groupBy("source_id").agg(F.min("lang").alias("type"), (F.count(F.lit(1)) > 1).alias("has"))
    return audit.presence(held, "has")


@query("e8_quote_presence", "SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[^.!?\\n]+[.!?]')) AS quoted, count(*) AS total FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("lang").agg(F.count_if(F.col("text").rlike(SENTENCE)).alias("quoted"), F.count(F.lit(1)).alias("total"))


@query("e9_claim_completeness", f"{GRAPH_SQL} SELECT e.src IS NOT NULL AS has_evidence, l.node IS NOT NULL AS has_law, count(*) AS n FROM entities c LEFT JOIN (SELECT DISTINCT src FROM edges WHERE type = 'HAS_EVIDENCE') e ON e.src = c.id LEFT JOIN (SELECT DISTINCT node FROM both_ways WHERE other LIKE 'law:%') l ON l.node = c.id WHERE c.type = 'legal_claim' GROUP BY 1, 2")
def _(t):
    return audit.claim_completeness(entities(t), edges(t))


@query("e10_case_out_profile", f"{EE} SELECT c.id, count(e.src) AS n_edges, coalesce(string_agg(DISTINCT e.type, ',' ORDER BY e.type), '') AS types FROM entities c LEFT JOIN edges e ON e.src = c.id WHERE c.type = 'case_document' GROUP BY 1")
def _(t):
    return audit.out_profile(entities(t), edges(t), "case_document")


@query("e11_duplicate_names", f"{EE} SELECT lower(name) AS name, type, count(*) AS n FROM entities GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, name, type LIMIT 20")
def _(t):
    return audit.duplicate_names(entities(t))


@query("e12_degree_bands", f"{GRAPH_SQL}, g AS (SELECT e.id, e.type, count(b.node) AS degree FROM entities e LEFT JOIN both_ways b ON b.node = e.id GROUP BY 1, 2) SELECT id, type, degree, 'under' AS band FROM g WHERE degree <= 2 UNION ALL (SELECT id, type, degree, 'well' FROM g WHERE degree > 2 ORDER BY degree DESC, id LIMIT 80)")
def _(t):
    under, well = audit.connection_bands(entities(t), edges(t), 2, 80)
    return under.withColumn("band", F.lit("under")).unionByName(well.withColumn("band", F.lit("well")))


@query("e13_graph_insights", f"{GRAPH_SQL}, g AS (SELECT e.id, e.type, count(b.node) AS degree FROM entities e LEFT JOIN both_ways b ON b.node = e.id GROUP BY 1, 2), m AS (SELECT avg(degree) AS mean FROM g) SELECT type, count(*) AS n, count(*) FILTER (WHERE degree >= 1.5 * mean) AS strong, count(*) FILTER (WHERE degree < 0.5 * mean) AS weak FROM g, m GROUP BY 1")
def _(t):
    return audit.insights(entities(t), edges(t))


_KINDS = ", ".join(repr(k) for k in d.SUPPORTING_EDGES)


@query("e13_confidence", f"{GRAPH_SQL}, g AS (SELECT node, count(*) AS degree FROM both_ways GROUP BY 1), m AS (SELECT avg(degree) AS mean FROM g), s AS (SELECT any_value(mean) AS mean_degree, count(*) FILTER (WHERE degree >= 1.5 * mean) AS strong FROM g, m), k AS (SELECT type, count(*) AS n FROM edges GROUP BY 1), c AS (SELECT sum(n)::BIGINT AS relations, coalesce(sum(n) FILTER (WHERE type IN ({_KINDS})), 0)::BIGINT AS supporting, string_agg(type || '=' || n, ',' ORDER BY type) AS types FROM k) SELECT round(mean_degree, 6) AS mean_degree, relations, supporting, strong, types, round(least(1.0, 0.5 + CASE WHEN relations > 10 THEN 0.2 WHEN relations > 5 THEN 0.1 ELSE 0 END + CASE WHEN strong > 3 THEN 0.15 WHEN strong > 0 THEN 0.1 ELSE 0 END + CASE WHEN supporting > 5 THEN 0.15 ELSE 0 END), 6)::DOUBLE AS confidence FROM c, s")
def _(t):
    held = audit.confidence(entities(t), edges(t), d.SUPPORTING_EDGES)
    return held.withColumns({"mean_degree": F.round("mean_degree", 6), "confidence": F.round("confidence", 6)})


@query("e13_supporting_edges", f"{EE} SELECT src, dst, coalesce(a.name, split_part(src, ':', -1)) || ' ' || e.type || ' ' || coalesce(b.name, split_part(dst, ':', -1)) AS relationship, CASE WHEN e.type IN ('ENABLES', 'REQUIRES') THEN 'strong' ELSE 'moderate' END AS strength FROM edges e LEFT JOIN entities a ON a.id = src LEFT JOIN entities b ON b.id = dst WHERE e.type IN ({_KINDS})")
def _(t):
    return audit.supporting(edges(t), entities(t).select("id", "name"), d.SUPPORTING_EDGES)


@query("e13_graph_paths", f"WITH RECURSIVE {ENTITIES_SQL}, {EDGES_SQL}, p AS (SELECT id AS seed, [id] AS nodes, CAST([] AS VARCHAR[]) AS types, 0 AS length FROM entities WHERE type = 'jurisdiction' OR id IN ('law:3', 'law:11', 'case_document:5', 'case_document:8', 'legal_claim:7') UNION ALL SELECT seed, list_append(nodes, dst), list_append(types, kind), length + 1 FROM (SELECT p.*, e.dst, e.type AS kind, row_number() OVER (PARTITION BY p.nodes, p.types ORDER BY e.dst, e.type) AS r FROM p JOIN edges e ON e.src = p.nodes[-1] AND NOT list_contains(p.nodes, e.dst) WHERE p.length < 3) WHERE r <= 4) SELECT seed, length, array_to_string(nodes, '>') AS nodes, array_to_string(types, '>') AS types FROM p WHERE length > 0")
def _(t):
    seeds = entities(t).filter("type = 'jurisdiction' or id in ('law:3', 'law:11', 'case_document:5', 'case_document:8', 'legal_claim:7')")
    return graph.paths(edges(t), seeds, 3, 4).select("seed", "length", F.array_join("nodes", ">").alias("nodes"), F.array_join("types", ">").alias("types"))


@query("e14_histograms", f"{EE}, x AS (SELECT *, CASE type WHEN 'law' THEN 'binding_legal_authority' WHEN 'case_document' THEN 'persuasive_authority' END AS authority, CASE WHEN type = 'evidence' THEN 'required' WHEN status IS NOT NULL THEN 'presented' END AS evidence_context FROM entities), h AS (SELECT 'type' AS kind, type AS value FROM x UNION ALL SELECT 'authority', authority FROM x UNION ALL SELECT 'claim_type', claim_type FROM x UNION ALL SELECT 'evidence_context', evidence_context FROM x) SELECT kind, value, count(*) AS n FROM h WHERE value IS NOT NULL GROUP BY 1, 2")
def _(t):
    authority = F.when(F.col("type") == "law", "binding_legal_authority").when(F.col("type") == "case_document", "persuasive_authority")
    context = F.when(F.col("type") == "evidence", "required").when(F.col("status").isNotNull(), "presented")
    return audit.richness(entities(t).withColumns({"authority": authority, "evidence_context": context}))


@query("e14_richness", f"{EE} SELECT type, count(*) AS n, count(DISTINCT claim_type) AS claim_types, count(description) AS described, coalesce(string_agg(DISTINCT outcome, ',' ORDER BY outcome), '') AS outcomes FROM entities GROUP BY 1")
def _(t):
    return entities(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("claim_type").alias("claim_types"), F.count("description").alias("described"), F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("outcomes"))


@query("e15_mentions", "SELECT l_partkey AS law, count(DISTINCT l_orderkey) AS mentions FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("law")).agg(F.count_distinct("l_orderkey").alias("mentions"))


@query("e16_win_rates", f"{EE} SELECT jurisdiction, count(*) FILTER (WHERE outcome = 'plaintiff_win') AS wins, count(*) FILTER (WHERE outcome = 'defendant_win') AS losses, count(*) FILTER (WHERE outcome = 'settlement') AS settlements, round(count(*) FILTER (WHERE outcome = 'plaintiff_win') / nullif(count(*) FILTER (WHERE outcome IN ('plaintiff_win', 'defendant_win')), 0), 6) AS win_rate FROM entities WHERE type = 'case_document' GROUP BY 1")
def _(t):
    return predict.win_rate(entities(t).filter("type = 'case_document'"), "jurisdiction").withColumn("win_rate", F.round("win_rate", 6))


@query("e17_favourable_rate", f"{EE} SELECT c.claim_type, round(avg(CASE WHEN k.outcome = 'plaintiff_win' THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM edges e JOIN entities c ON c.id = e.dst JOIN entities k ON k.id = e.src AND k.type = 'case_document' WHERE e.type = 'ADDRESSES' GROUP BY 1")
def _(t):
    ent = entities(t)
    met = graph.hop(edges(t), "ADDRESSES", "case", "claim").join(ent.select(F.col("id").alias("claim"), "claim_type"), "claim").join(ent.filter("type = 'case_document'").select(F.col("id").alias("case"), F.col("outcome").alias("o")), "case")
    return met.groupBy("claim_type").agg(F.round(F.avg(predict.favourable(F.col("o")).cast("int")), 6).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("e19_strength_labels", "SELECT l_orderkey AS claim, round(avg(l_discount * 10), 6) AS strength, CASE WHEN round(avg(l_discount * 10), 6) >= 0.7 THEN 'Strong' WHEN round(avg(l_discount * 10), 6) >= 0.4 THEN 'Moderate' WHEN round(avg(l_discount * 10), 6) > 0 THEN 'Weak' ELSE 'Insufficient' END AS label FROM lineitem GROUP BY 1")
def _(t):
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("claim")).agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("strength"))
    return held.withColumn("label", audit.strength_label(F.col("strength")))


@query("e20_ingest_stats", "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 5) AS processed, round(sum(value), 4) AS elapsed, round(avg(value), 6) AS average FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("value") > 5).alias("processed"), F.round(F.sum("value"), 4).alias("elapsed"), F.round(F.avg("value"), 6).alias("average"))


@query("e21_e23_best_hits", f"{with_sql(CHUNKS_SQL)}, s AS (SELECT *, length(text) - length(replace(text, 'the', '')) AS score FROM chunks) SELECT source, CAST(max(score) AS BIGINT) AS best, count(*) AS n, substr(max_by(text, lpad(CAST(score AS VARCHAR), 8, '0') || chunk_id), 1, 200) AS preview FROM s GROUP BY 1 ORDER BY best DESC, source LIMIT 10")
def _(t):
    hits = chunks(t).withColumn("score", (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))).cast("long"))
    return audit.best_hits(hits, "source")


@query("e21_e23_hit_lists", f"{with_sql(CHUNKS_SQL)}, s AS (SELECT source, chunk_id, text, CAST(length(text) - length(replace(text, 'the', '')) AS BIGINT) AS score FROM chunks ORDER BY score DESC, chunk_id LIMIT 200) SELECT source, max(score) AS best, count(*) AS n, string_agg(chunk_id, ',' ORDER BY score DESC, chunk_id) AS chunk_ids, sha256(string_agg(substr(text, 1, 200), '|' ORDER BY score DESC, chunk_id)) AS previews FROM s GROUP BY 1 ORDER BY best DESC, source LIMIT 10")
def _(t):
    # The hits of a search, so many and no more.
    hits = chunks(t).withColumn("score", (F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))).cast("long")).orderBy(F.desc("score"), "chunk_id").limit(200)
    return audit.hit_lists(hits, "source").withColumns({"chunk_ids": F.array_join("chunk_ids", ","), "previews": tx.sha(F.array_join("previews", "|"))})


@query("e22_cases_by_court", f"{with_sql(CHUNKS_SQL)} SELECT source_id AS \"case\", count(*) AS n, max(start) AS latest FROM chunks WHERE lang = 'fr' GROUP BY 1 ORDER BY latest DESC, 1 LIMIT 50")
def _(t):
    return chunks(t).filter("lang = 'fr'").groupBy(F.col("source_id").alias("case")).agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("latest")).orderBy(F.desc("latest"), "case").limit(50)


@query("e24_manifest_sizes", "SELECT source, count(*) AS entry_count FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count("doc_id").alias("entry_count"))


@query("e25_error_patterns", "SELECT substr(props, 1, 7) AS pattern, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10")
def _(t):
    return t.events.filter("event_type = 'error'").groupBy(F.substring("props", 1, 7).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(10)


@query("f1_top_k", "SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY score DESC, id LIMIT 10")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("f2_top_k_per_group", "SELECT o_orderpriority AS kind, o_orderkey AS id, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def _(t):
    held = t.orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return graph.first_per(held, ["kind"], [F.desc("score"), "id"], 5).drop("rank")


@query("f3_page", f"{EE} SELECT id, (SELECT count(*) FROM entities) AS total, CAST(120 AS BIGINT) AS next_cursor FROM entities ORDER BY id LIMIT 20 OFFSET 100")
def _(t):
    from graphloom.operators.search import page

    return page(entities(t), 100, 20).select("id", "total", "next_cursor")


RANK_SQL = "CASE {c} WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 1 END"


@query("f4_f5_source_index", f"WITH s AS (SELECT doc_id, source, {RANK_SQL.format(c='doc_id % 6')} AS authority, coalesce(lang, '') AS jurisdiction, substr(text, 1, 64) AS quote FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source, quote ORDER BY authority DESC, jurisdiction, doc_id) AS r FROM s) SELECT doc_id, 'S' || row_number() OVER (ORDER BY authority DESC, jurisdiction, doc_id) AS label FROM k WHERE r = 1 ORDER BY authority DESC, jurisdiction, doc_id LIMIT 200")
def _(t):
    name = F.element_at(F.array(*map(F.lit, d.AUTHORITIES)), (F.col("doc_id") % 6 + 1).cast("int"))
    held = t.documents.select("doc_id", "source", name.alias("authority"), F.col("lang").alias("jurisdiction"), F.col("text").alias("quote"))
    return retrieval.source_index(held, ["doc_id"], top=200).select("doc_id", "label")


@query("f6_rank_fusion", "WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 200), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders ORDER BY rank LIMIT 3000), c AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) SELECT id, score FROM c ORDER BY score DESC, id LIMIT 50")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("a").alias("list"), "o_totalprice", "o_orderdate")
    lists = retrieval.ranked(a, [F.desc("o_totalprice"), "id"], 200).select("list", "id", "rank").unionByName(retrieval.ranked(a.withColumn("list", F.lit("b")), [F.desc("o_orderdate"), "id"], 3000).select("list", "id", "rank"))
    return retrieval.fuse(lists).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").limit(50)


@query("f7_recent_jobs", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 25")
def _(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(25)


@query("f8_argmax_threshold", "SELECT l_orderkey AS id, l_linenumber AS best, l_quantity AS score FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1 AND l_quantity >= 30")
def _(t):
    held = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.max(F.struct(F.col("l_quantity").alias("score"), (-F.col("l_linenumber")).alias("n"))).alias("b"))
    return held.filter("b.score >= 30").select("id", (-F.col("b.n")).alias("best"), F.col("b.score").alias("score"))


@query("f9_preferred_outcome", "SELECT o_custkey AS id, max_by(o_orderstatus, lpad(CAST(n AS VARCHAR), 6, '0') || o_orderstatus) AS outcome FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(t):
    held = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("outcome"))
