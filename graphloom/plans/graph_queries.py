"""Queries of §2.D: joins and traversals."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx
from graphloom.operators import graph as g

from .catalog import query
from .projection import CHUNKS_SQL, EDGES_SQL, ENTITIES_SQL, GRAPH_SQL, chunks, edges, entities, with_sql

ALL, EE = GRAPH_SQL, with_sql(ENTITIES_SQL, EDGES_SQL)
SEEDS = "id in ('legal_claim:1', 'legal_claim:7', 'law:3', 'case_document:5', 'legal_outcome:2', 'evidence:Brand#3')"
_SEEDS = f"seeds AS (SELECT id FROM entities WHERE {SEEDS})"


@query("d1_induced_subgraph", f"{EE} SELECT src, dst, e.type FROM edges e WHERE src IN (SELECT id FROM entities WHERE type IN ('law', 'legal_outcome')) AND dst IN (SELECT id FROM entities WHERE type IN ('law', 'legal_outcome'))")
def _(t):
    return g.induced(edges(t), entities(t).filter("type in ('law', 'legal_outcome')")).select("src", "dst", "type")


@query("d2_touching_edges", f"{EE}, {_SEEDS} SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)")
def _(t):
    return g.touching(edges(t), entities(t).filter(SEEDS))


@query("d2_missing_nodes", f"{EE}, {_SEEDS}, x AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT id FROM seeds) OR dst IN (SELECT id FROM seeds)) SELECT id FROM (SELECT src AS id FROM x UNION SELECT dst FROM x) WHERE id NOT IN (SELECT id FROM seeds)")
def _(t):
    seeds = entities(t).filter(SEEDS)
    return g.missing_nodes(g.touching(edges(t), seeds), seeds)


@query("d3_neighbours", f"{EE}, {_SEEDS}, n AS (SELECT src AS seed, dst AS other, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges) SELECT seed, other, type, direction FROM (SELECT *, row_number() OVER (PARTITION BY seed, direction ORDER BY other, type) AS r FROM n WHERE seed IN (SELECT id FROM seeds)) WHERE r <= 10")
def _(t):
    return g.neighbours(edges(t), entities(t).filter(SEEDS)).select("seed", "other", "type", "direction")


@query("d4_legal_chains", f"{EE} SELECT a.src AS law, a.dst AS claim, b.dst AS outcome, c.src AS case_id FROM edges a JOIN edges b ON a.dst = b.src AND b.type = 'RESULTS_IN' JOIN edges c ON c.dst = a.dst AND c.type = 'ADDRESSES' AND c.src LIKE 'case_document:%' JOIN entities e ON e.id = c.src AND e.jurisdiction = 'BUILDING' WHERE a.type = 'ENABLES'")
def _(t):
    e = edges(t, ("law", "legal_claim", "legal_outcome", "case_document"))
    held = entities(t).filter("jurisdiction = 'BUILDING'").select(F.col("id").alias("case_id"))
    paths = g.chains(e, [("law", "ENABLES", "claim"), ("claim", "RESULTS_IN", "outcome"), ("case_id", "ADDRESSES", "claim")])
    return paths.filter(F.col("case_id").startswith("case_document:")).join(held, "case_id", "left_semi").select("law", "claim", "outcome", "case_id")


@query("d5_chains_from_laws", f"{EE}, r AS (SELECT src AS law, dst AS remedy, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges WHERE type = 'AUTHORIZES') SELECT law, remedy, (SELECT min(src) FROM edges p WHERE p.type = 'RESULTS_IN' AND p.dst = remedy) AS procedure, (SELECT min(dst) FROM edges q WHERE q.type = 'ADDRESSES' AND q.src = law) AS evidence, CAST(0.8 AS DOUBLE) AS score FROM r WHERE k <= 5")
def _(t):
    return g.chains_from_laws(edges(t), entities(t).filter("type = 'law'"), "AUTHORIZES", "RESULTS_IN", "ADDRESSES")


@query("d6_chains_of_top_laws", f"{ALL}, top AS (SELECT other AS law FROM both_ways WHERE other LIKE 'law:%' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), r AS (SELECT src AS law, dst AS remedy, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges WHERE type = 'AUTHORIZES' AND src IN (SELECT law FROM top)) SELECT law, remedy, (SELECT min(src) FROM edges p WHERE p.type = 'RESULTS_IN' AND p.dst = remedy) AS procedure, (SELECT min(dst) FROM edges q WHERE q.type = 'ADDRESSES' AND q.src = law) AS evidence, CAST(0.8 AS DOUBLE) AS score FROM r WHERE k <= 5")
def _(t):
    e = edges(t)
    top = g.undirected(e).filter(F.col("other").startswith("law:")).groupBy(F.col("other").alias("id")).count().orderBy(F.desc("count"), "id").limit(3)
    return g.chains_from_laws(e, top, "AUTHORIZES", "RESULTS_IN", "ADDRESSES")


LAWS = f"{ALL} SELECT claim_type, law, name, citations FROM (SELECT c.claim_type, b.other AS law, l.name, count(*) AS citations, row_number() OVER (PARTITION BY c.claim_type ORDER BY count(*) DESC, b.other) AS r FROM both_ways b JOIN entities c ON c.id = b.node AND c.type = 'legal_claim' JOIN entities l ON l.id = b.other AND l.type = 'law' GROUP BY 1, 2, 3) WHERE r <= 8"


@query("d7_laws_for_claim_type", LAWS)
def laws_for_claim_type(t):
    return g.laws_for_claims(entities(t), edges(t, ("law", "legal_claim")))


@query("d8_remedies_for_claim_type", f"{EE}, d AS (SELECT c.claim_type, e.dst AS outcome, count(*) AS n FROM edges e JOIN entities c ON c.id = e.src AND c.type = 'legal_claim' WHERE e.type IN ('RESULTS_IN', 'ENABLES') GROUP BY 1, 2), v AS (SELECT c.claim_type, a.dst AS outcome, count(*) AS n FROM edges e JOIN entities c ON c.id = e.dst AND c.type = 'legal_claim' JOIN edges a ON a.src = e.src AND a.type = 'AUTHORIZES' WHERE e.type IN ('ADDRESSES', 'ENABLES', 'CITES') GROUP BY 1, 2), b AS (SELECT x.claim_type, trim(regexp_replace(o.name, '[$][0-9,.]+|#', '', 'g')) AS remedy, CAST(sum(n) AS BIGINT) AS citations FROM (SELECT * FROM d UNION ALL SELECT * FROM v) x JOIN entities o ON o.id = x.outcome AND o.type = 'legal_outcome' GROUP BY 1, 2) SELECT claim_type, remedy, citations FROM (SELECT *, row_number() OVER (PARTITION BY claim_type ORDER BY citations DESC, remedy) AS r FROM b) WHERE r <= 6")
def _(t):
    return g.remedies_for_claims(entities(t), edges(t, ("law", "legal_claim", "legal_outcome")), F.trim(F.regexp_replace("name", "[$][0-9,.]+|#", "")))


@query("d9_d10_claim_cases", f"{EE} SELECT dst AS claim, min(src) AS \"case\", (SELECT min(o.dst) FROM edges o WHERE o.type = 'RESULTS_IN' AND o.src = e.dst) AS outcome FROM edges e WHERE type = 'ADDRESSES' AND src LIKE 'case_document:%' GROUP BY dst")
def _(t):
    return g.claim_cases(edges(t))


@query("d11_cases_by_listed_type", f"{EE}, l AS (SELECT src AS id, string_agg(DISTINCT claim_type, ',') AS types FROM edges e JOIN entities c ON c.id = e.dst WHERE e.type = 'ADDRESSES' AND src LIKE 'case_document:%' GROUP BY 1), seen AS (SELECT DISTINCT src AS id FROM edges JOIN entities c ON c.id = dst WHERE c.status = 'P' AND src LIKE 'case_document:%') SELECT id FROM l WHERE list_contains(string_split(types, ','), '1-URGENT') AND id NOT IN (SELECT id FROM seen)")
def _(t):
    from graphloom.operators.predict import cases_listing_type

    ent, e = entities(t), edges(t)
    claims = ent.filter("type = 'legal_claim'").select(F.col("id").alias("dst"), "claim_type", "status")
    met = e.filter("type = 'ADDRESSES'").filter(F.col("src").startswith("case_document:")).join(claims, "dst")
    listed = met.groupBy(F.col("src").alias("id")).agg(F.array_join(F.collect_set("claim_type"), ",").alias("claim_types"))
    return cases_listing_type(listed, "1-URGENT", met.filter("status = 'P'").select(F.col("src").alias("id")).distinct()).select("id")


@query("d12_case_profiles", f"{ALL} SELECT c.id AS \"case\", count(DISTINCT b.other) AS n_claims, count(DISTINCT o.dst) AS n_outcomes FROM entities c LEFT JOIN both_ways b ON b.node = c.id AND b.other LIKE 'legal_claim:%' LEFT JOIN edges o ON o.type = 'RESULTS_IN' AND o.src = b.other WHERE c.type = 'case_document' GROUP BY 1")
def _(t):
    return g.case_profiles(entities(t), edges(t))


@query("d13_related_laws", f"{EE}, p AS (SELECT DISTINCT src AS law, claim_type FROM edges e JOIN entities c ON c.id = e.dst AND c.type = 'legal_claim' WHERE e.type = 'ADDRESSES' AND src LIKE 'law:%'), m AS (SELECT a.law, b.law AS related, count(*) AS shared FROM p a JOIN p b USING (claim_type) WHERE a.law <> b.law GROUP BY 1, 2) SELECT law, related, shared FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY shared DESC, related) AS r FROM m) WHERE r <= 5")
def _(t):
    return g.related_laws(edges(t), entities(t))


@query("d14_documents_naming_laws", "WITH m AS (SELECT DISTINCT p_name AS law, c.conv_id || ':' || c.turn AS id FROM (SELECT DISTINCT p_name FROM part) JOIN (SELECT o_orderkey AS conv_id, o_orderstatus AS turn, 'a ' || o_orderpriority || ' ' || p_name || ' order' AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) c ON contains(' ' || lower(c.text) || ' ', ' ' || lower(p_name) || ' ')) SELECT law, id FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY id) AS r FROM m) WHERE r <= 5")
def _(t):
    from graphloom.operators.search import texts_naming

    line = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    texts = line.select(F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("id"), F.concat(F.lit("a "), "o_orderpriority", F.lit(" "), "p_name", F.lit(" order")).alias("text"))
    return texts_naming(t.part.select(F.col("p_name").alias("name")).distinct(), texts, 5).select(F.col("name").alias("law"), "id")


@query("d15_evidence_claims", f"{EE}, e AS (SELECT 'evidence:' || p_partkey AS dst, CASE WHEN p_size % 5 = 0 THEN 'HABITABILITY_VIOLATION' WHEN p_size % 5 = 1 THEN 'HARASSMENT' WHEN p_size % 5 = 2 THEN 'HP_ACTION_REPAIRS' END AS t FROM part), c AS (SELECT 'legal_claim:' || o_orderkey AS src, CASE o_orderkey % 3 WHEN 0 THEN 'HABITABILITY_VIOLATION' WHEN 1 THEN 'HARASSMENT' ELSE 'HP_ACTION_REPAIRS' END AS t FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY 'legal_claim:' || o_orderkey) <= 3) SELECT src, dst, 'REQUIRES' AS type FROM e JOIN c USING (t)")
def _(t):
    from graphloom.dictionaries import EVIDENCE_CLAIMS
    from graphloom.operators.ingest import evidence_to_claims

    k, o = F.col("p_size") % 5, F.col("o_orderkey") % 3
    proofs = t.part.select(F.concat(F.lit("evidence:"), "p_partkey").alias("id"), F.when(k == 0, "no Heat, a repair").when(k == 1, "threatening").when(k == 2, "an inspection").otherwise("a part").alias("text"))
    claims = t.orders.select(F.concat(F.lit("legal_claim:"), "o_orderkey").alias("claim"), F.when(o == 0, "HABITABILITY_VIOLATION").when(o == 1, "HARASSMENT").otherwise("HP_ACTION_REPAIRS").alias("claim_type"))
    return evidence_to_claims(proofs, claims, EVIDENCE_CLAIMS)


@query("d16_case_edges_by_type", f"{EE} SELECT DISTINCT c.src AS src, e.dst AS dst, CASE WHEN e.dst LIKE 'evidence:%' THEN 'HAS_EVIDENCE' ELSE 'RESULTS_IN' END AS type FROM edges c JOIN edges e ON e.src = c.dst WHERE c.type = 'ADDRESSES' AND c.src LIKE 'case_document:%' AND (e.dst LIKE 'evidence:%' OR e.dst LIKE 'legal_outcome:%')")
def _(t):
    from graphloom.operators.ingest import document_edges

    e = edges(t)
    held = g.chains(e, [("document", "ADDRESSES", "claim")]).filter(F.col("document").startswith("case_document:")).join(e.select(F.col("src").alias("claim"), F.col("dst").alias("entity")), "claim")
    return document_edges(held.select("document", "entity"), {"evidence": "HAS_EVIDENCE", "legal_outcome": "RESULTS_IN"})


_RULES_SQL = "rules(a, b, rel) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in d.INFERENCE_RULES) + ")"


@query("d17_inferred_edges", f"{EE}, {_RULES_SQL}, tok AS (SELECT DISTINCT id, type, lower(jurisdiction) AS j, unnest(string_split_regex(lower(coalesce(name, '') || ' ' || coalesce(description, '')), '[^a-z0-9]+')) AS token FROM entities), k AS (SELECT * FROM tok WHERE length(token) > 2 AND token NOT IN {d.INFERENCE_STOPWORDS}), m AS (SELECT x.id AS src, y.id AS dst, rel AS type, x.j = y.j AS same, count(*) AS shared FROM k x JOIN rules r ON r.a = x.type JOIN k y ON y.token = x.token AND y.type = r.b GROUP BY 1, 2, 3, 4) SELECT src, dst, type, shared FROM m WHERE (shared >= 2 OR (shared >= 1 AND same)) AND src <> dst AND (src, dst, type) NOT IN (SELECT src, dst, type FROM edges)")
def _(t):
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")))
    held = entities(t).select("id", "type", "jurisdiction", tx.tokens(text, d.INFERENCE_STOPWORDS, shortest=3).alias("tokens"))
    rules = t._spark.createDataFrame(d.INFERENCE_RULES, "src_type string, dst_type string, rel string")
    return g.typed_pairs_by_tokens(held, held, rules, edges(t))


@query("d18_resolved_relations", "WITH d AS (SELECT o_custkey AS doc, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS short FROM orders) SELECT a.doc AS doc, a.id AS src, b.id AS dst FROM d a JOIN d b ON a.doc = b.doc AND b.short = a.short + 1")
def _(t):
    from graphloom.operators.ingest import resolve_relations

    short = F.row_number().over(g.Window.partitionBy("doc").orderBy("id"))
    named = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("id")).withColumn("n", short)
    ids = named.select("doc", F.concat(F.lit("c"), "n").alias("short_id"), "id")
    relations = named.select("doc", F.concat(F.lit("c"), "n").alias("from"), F.concat(F.lit("c"), F.col("n") + 1).alias("to"))
    return resolve_relations(relations, ids).select("doc", "src", "dst")


@query("d19_remapped_edges", f"{EE}, r AS (SELECT CASE WHEN src LIKE 'law:%' THEN 'law:' || CAST(substr(src, 5) AS BIGINT) % 64 ELSE src END AS src, CASE WHEN dst LIKE 'law:%' THEN 'law:' || CAST(substr(dst, 5) AS BIGINT) % 64 ELSE dst END AS dst, type FROM edges) SELECT DISTINCT src, dst, type FROM r WHERE src <> dst")
def _(t):
    moved = t.part.select(F.concat(F.lit("law:"), "p_partkey").alias("old"), F.concat(F.lit("law:"), F.col("p_partkey") % 64).alias("new"))
    return g.remap_edges(edges(t), moved)


CH = with_sql(CHUNKS_SQL)


@query("d20_context_windows", f"{CH} SELECT a.chunk_id, sha256(string_agg(b.text, chr(10) ORDER BY b.chunk_index)) AS digest FROM chunks a JOIN chunks b ON a.source_id = b.source_id AND b.chunk_index BETWEEN a.chunk_index - 1 AND a.chunk_index + 1 GROUP BY 1")
def _(t):
    return g.window_context(chunks(t)).select("chunk_id", F.sha2(F.col("context").cast("binary"), 256).alias("digest"))


@query("d21_adjacent_chunks", f"{CH} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunks WINDOW w AS (PARTITION BY source_id ORDER BY chunk_index)")
def _(t):
    return g.adjacent(chunks(t))


@query("d22_entities_of_chunks", f"{CH}, e AS (SELECT chunk_id, unnest(['lang:' || lang, 'source:' || source]) AS entity FROM chunks) SELECT entity, count(*) AS n, min(chunk_id) AS first_chunk FROM e GROUP BY 1")
def _(t):
    held = chunks(t).select("chunk_id", F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")).alias("entities"))
    return held.select("chunk_id", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_chunk"))


@query("d23_d24_quote_links", f"{CH}, q AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, substr(text, length(text) // 2, 60) AS quote FROM documents WHERE length(text) > 10), f AS (SELECT q.source_id, min(c.chunk_index) FILTER (WHERE contains(c.text, substr(quote, 1, 80))) AS hit, min(c.chunk_index) AS first FROM q JOIN chunks c USING (source_id) GROUP BY 1) SELECT source_id, source_id || ':' || coalesce(hit, first) AS chunk_id, hit IS NOT NULL AS found FROM f")
def _(t):
    from graphloom.operators.ingest import link_quotes

    quotes = t.documents.filter("length(text) > 10").select(F.col("doc_id").cast("string").alias("source_id"), F.expr("substring(text, cast(length(text) div 2 as int), 60)").alias("quote"))
    return link_quotes(quotes, chunks(t), ["source_id"])


@query("d25_new_and_known", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) IN (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM pages WHERE page_id % 3 = 0) AS known FROM pages")
def _(t):
    from graphloom.sources.manifest import mark_known

    pages = t.pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("locator"))
    return mark_known(pages, pages.filter("page_id % 3 = 0")).select("page_id", "known")


@query("d26_legal_basis", f"{EE} SELECT o.id AS remedy, coalesce(string_agg(x.src, '; ' ORDER BY x.src), 'none') AS basis FROM entities o LEFT JOIN (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS r FROM edges WHERE type = 'AUTHORIZES') x ON x.dst = o.id AND x.r <= 3 WHERE o.type = 'legal_outcome' GROUP BY 1")
def _(t):
    held = g.first_per(g.hop(edges(t), "AUTHORIZES", "law", "remedy"), ["remedy"], ["law"], 3).groupBy("remedy").agg(F.array_join(F.array_sort(F.collect_list("law")), "; ").alias("basis"))
    return entities(t).filter("type = 'legal_outcome'").select(F.col("id").alias("remedy")).join(held, "remedy", "left").select("remedy", F.coalesce("basis", F.lit("none")).alias("basis"))


@query("d27_cascade_delete", f"{EE} SELECT (SELECT count(*) FROM entities WHERE NOT (type = 'law' AND name LIKE 'red%')) AS entities_left, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT id FROM entities WHERE type = 'law' AND name LIKE 'red%') AND dst NOT IN (SELECT id FROM entities WHERE type = 'law' AND name LIKE 'red%')) AS edges_left")
def _(t):
    ent = entities(t)
    left, lines = g.delete_entities(ent, edges(t), ent.filter("type = 'law' and name like 'red%'"))
    return left.agg(F.count(F.lit(1)).alias("entities_left")).crossJoin(lines.agg(F.count(F.lit(1)).alias("edges_left")))


@query("d28_validated_relations", "WITH r AS (SELECT l_orderkey AS doc, 'p' || l_linenumber AS f, 'p' || (l_linenumber + 1) AS t FROM lineitem), k AS (SELECT DISTINCT l_orderkey AS doc, 'p' || l_linenumber AS id FROM lineitem) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.doc = r.doc AND k.id = r.f) THEN 'unknown source' WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.doc = r.doc AND k.id = r.t) THEN 'unknown target' ELSE 'valid' END AS reason FROM r) GROUP BY 1")
def _(t):
    from graphloom.operators.ingest import validate_relations

    named = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("p"), "l_linenumber").alias("from"), F.concat(F.lit("p"), F.col("l_linenumber") + 1).alias("to"))
    ids = named.select("doc", F.col("from").alias("short_id")).distinct()
    return validate_relations(named, ids).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
