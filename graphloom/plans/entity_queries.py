"""Queries of §2.A, §2.C, §2.G and §2.I: sources and sinks, lookups and search, dedup, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx
from graphloom.operators import candidates, dedup, graph, retrieval, search, vectors
from graphloom.operators.chunking import SENTENCE
from graphloom.sources import manifest, pages

from .catalog import query
from .projection import CHUNKS_SQL, EDGES_SQL, ENTITIES_SQL, REQUIRED_SQL, chunks, edges, entities, required, with_sql
from .sql_parts import candidates_sql

EE, CH = with_sql(ENTITIES_SQL, EDGES_SQL), with_sql(CHUNKS_SQL)


def _lines(t):
    """Manifest lines of pages: every seventh is broken, every eleventh blank."""
    good = F.to_json(F.struct(F.col("url").alias("locator"), F.lit("URL").alias("kind"), F.concat(F.lit("page "), "page_id").alias("title"), F.struct(F.lit("Civil Court").alias("court")).alias("metadata")))
    line = F.when(F.col("page_id") % 11 == 0, "  ").when(F.col("page_id") % 7 == 0, F.concat(F.lit("{broken "), "url")).when(F.col("page_id") % 13 == 0, '{"kind": "URL"}').otherwise(good)
    return t.pages.select("page_id", F.concat(F.lit("m"), F.col("page_id") % 5, F.lit(".jsonl")).alias("file"), line.alias("line"))


@query("a1_manifest_scan", "SELECT page_id, url AS locator, 'page ' || page_id AS title, 'Civil Court' AS court FROM pages WHERE page_id % 11 <> 0 AND page_id % 7 <> 0 AND page_id % 13 <> 0")
def _(t):
    return manifest.parse(_lines(t))[0].select("page_id", "locator", "title", "metadata.court")


@query("a2_a4_manifest_counts", "SELECT 'm' || page_id % 5 || '.jsonl' AS file, count(*) FILTER (WHERE page_id % 7 <> 0 AND page_id % 13 <> 0) AS valid, count(*) FILTER (WHERE page_id % 7 = 0 OR page_id % 13 = 0) AS invalid FROM pages WHERE page_id % 11 <> 0 GROUP BY 1")
def _(t):
    return manifest.counts(_lines(t))


@query("a3_manifest_order", "SELECT name, row_number() OVER (ORDER BY CASE WHEN contains(lower(name), 'statute') THEN 0 WHEN contains(lower(name), 'guide') THEN 1 WHEN contains(lower(name), 'case') THEN 2 ELSE 3 END, name) AS position FROM (SELECT n_name || CASE n_nationkey % 4 WHEN 0 THEN '_cases' WHEN 1 THEN '_Statutes' WHEN 2 THEN '_guides' ELSE '_other' END AS name FROM nation)")
def _(t):
    k = F.col("n_nationkey") % 4
    named = t.nation.select(F.concat("n_name", F.when(k == 0, "_cases").when(k == 1, "_Statutes").when(k == 2, "_guides").otherwise("_other")).alias("name"))
    return manifest.processing_order(named).withColumn("position", F.col("position").cast("long"))


@query("a5_manifest_from_stored", "WITH b AS (SELECT regexp_extract(url, '^[^?#]*') AS locator, 'source ' || page_id AS title, 0 AS p FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT regexp_extract(url, '^[^?#]*'), 'entity ' || page_id, 1 FROM pages) SELECT locator, title FROM b WHERE regexp_matches(locator, '^https?://') QUALIFY row_number() OVER (PARTITION BY locator ORDER BY p, title) = 1")
def _(t):
    named = lambda kind: t.pages.select(F.regexp_extract("url", "^([^?#]*)", 1).alias("locator"), F.concat(F.lit(f"{kind} "), "page_id").alias("title"), "page_id")
    return manifest.from_stored(named("entity"), named("source").filter("page_id % 2 = 0"))


STRIPPED = "html"
for _tag in ("script", "style", "nav", "header", "footer", "aside"):
    STRIPPED = f"regexp_replace({STRIPPED}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
STRIPPED = STRIPPED.replace("(html", "(regexp_replace(html, '(?is)<!--.*?-->', '', 'g')", 1)
STRIPPED = f"regexp_replace({STRIPPED}, '(?s)<[^>]*>', '', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
    STRIPPED = f"replace({STRIPPED}, '{_a}', '{_b}')"
_W = "[ \\t\\n\\x0B\\f\\r]"
STRIPPED = f"regexp_replace(regexp_replace(regexp_replace({STRIPPED}, '{_W}*\\n{_W}*', ' ', 'g'), ' {{2,}}', ' ', 'g'), '^{_W}+|{_W}+$', '', 'g')"


@query("a6_page_text", f"WITH s AS (SELECT page_id, {STRIPPED} AS t FROM pages) SELECT page_id, CASE WHEN length(t) > 100 THEN sha256(t) END AS digest FROM s")
def _(t):
    return t.pages.select("page_id", F.sha2(tx.html_text("html").cast("binary"), 256).alias("digest"))


@query("a8_case_page", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def _(t):
    return pages.case_fields(t.pages).select("page_id", "title", "heading", "lang", "paragraphs")


@query("a8_opinion_pages", "SELECT page_id, 'Party' || page_id || ' v Owner' AS name, CASE page_id % 4 WHEN 0 THEN 'Civil Court of the City' WHEN 1 THEN 'Housing Court' END AS court, CASE page_id % 3 WHEN 0 THEN '2021-03-0' || (page_id % 9 + 1) END AS date, CASE WHEN page_id % 2 = 0 THEN 'LT-' || page_id || '/20' END AS docket, CASE WHEN page_id % 5 = 0 THEN '2025-NY-SLIP-OP-' || page_id || '-U' END AS citation, CASE WHEN page_id % 7 = 0 THEN 'Ann Lee,Bo Chan' ELSE '' END AS judges, CASE WHEN page_id % 6 = 0 THEN 'The tenant of number ' || page_id || ' may stay in the flat; the owner has to pay.' END AS summary FROM pages")
def _(t):
    """Pages of opinions made up of the fields, some left out, some with markup that is never closed."""
    from graphloom.sources import case_pages

    k = F.col("page_id")
    some = lambda n, rest, *said: F.when(k % n == rest, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in said))).otherwise("")
    page = F.concat(
        some(5, 0, "<link rel='canonical' href='/cases/2025-ny-slip-op-", k, "-u.html'>"), F.lit("<title>A page - Site</title><body><nav>Home <a href=x>pages</nav><h1>Party"), k, F.lit(" v Owner :: 2021</h1>"),
        some(4, 0, "<p>Court: Civil Court of the City<br>"), some(4, 1, "<div>held in Housing Court, Kings"), some(3, 0, "<td>Decided: March ", k % 9 + 1, ", 2021</td>"), some(2, 0, "<p>Index No. LT-", k, "/20"), some(7, 0, "<p>Justice Ann Lee<p>Hon. Bo Chan"),
        some(6, 0, "<h3>Summary</h3><p>The tenant of number ", k, " may stay in the flat; <b>the owner</b> has to pay.</p><h3>More</h3>"),
        F.lit("<script>if (a < b) { 'Court: none' }</script><p>It is what it is, and so it was said at length by one and by the other until nobody spoke any more of it.</p>"),
    )
    return case_pages.parsed(t.pages.select("page_id", page.alias("html"))).withColumn("judges", F.array_join("judges", ",")).drop("body")


@query("a9_links", "WITH l AS (SELECT page_id, 'https://site.test' || h AS link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS h FROM pages)) SELECT DISTINCT page_id, link FROM l")
def _(t):
    return pages.links(t.pages, "https://site.test").select("page_id", "link")


@query("a10_resource_links", "SELECT page_id, href, trim(regexp_replace(label, '[ \\t\\n]+', ' ', 'g')) AS label, '' AS category FROM (SELECT page_id, regexp_extract(a, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(a, '>([^<]*)</a>', 1) AS label, i FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS l FROM pages))) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY i) = 1")
def _(t):
    return pages.resource_links(t.pages, skip=())  # these pages have links in navigation alone


@query("a11_a12_scans", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings WHERE vec_id < 10000) AS vectors")
def _(t):
    counted = t.documents.agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("k"), "n").unionByName(t.embeddings.orderBy("vec_id").limit(10000).agg(F.count_if(F.col("vec_id") < 10000).alias("n")).select(F.lit("vectors").alias("k"), "n"))
    return counted.groupBy().pivot("k", ["documents", "vectors"]).agg(F.sum("n"))


@query("a13_a14_upserts", "SELECT user_id, max_by(value, ts) AS value FROM events GROUP BY 1")
def _(t):
    return dedup.latest(t.events, "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "value")


@query("a13_bucketed_upserts", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN 'merged: ' || p_name ELSE p_name END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'patched ' || p_brand ELSE p_type END AS description FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0")
def _(t):
    """Parts stored in buckets, then changed by rows of which some are new and some give one column only."""
    from graphloom.sources.bucketed import BucketedTable
    from graphloom.storage import scratch_path

    table = BucketedTable(t._spark, scratch_path(t._spark, "bucketed"), ["id"], "id long, name string, description string", 16)
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), "p_brand")
    table.insert_absent(rows.filter("id % 3 <> 0").select("id", "name", "description"), "parts")
    table.insert_absent(rows.filter("id % 5 = 0 or id % 7 = 0").select("id", "name", "description"), "missing parts")
    table.patch(rows.filter("id % 5 = 0").select("id", F.concat(F.lit("patched "), "p_brand").alias("description")), "descriptions")
    table.patch(rows.filter("id % 7 = 0").select("id", F.concat(F.lit("merged: "), "name").alias("name")), "names")
    return table.read()


@query("a15_patched_chunks", f"{CH} SELECT chunk_id, sha256(CASE WHEN chunk_index = 0 THEN 'patched' ELSE text END) AS digest, CASE WHEN chunk_index = 0 AND lang < source THEN lang || ',' || source WHEN chunk_index = 0 THEN source || ',' || lang ELSE lang END AS entities FROM chunks")
def _(t):
    held = chunks(t).select("chunk_id", "text", F.array("lang").alias("entities"), "chunk_index", "source")
    patches = held.filter("chunk_index = 0").select("chunk_id", F.lit("patched").alias("text"), F.array("source").alias("entities"))
    return dedup.patch_chunks(held, patches).select("chunk_id", tx.sha("text").alias("digest"), F.array_join("entities", ",").alias("entities"))


@query("a16_inserted_edges", f"{EE} SELECT src, dst, type FROM edges UNION SELECT 'law:' || p_partkey, 'evidence:' || p_brand, 'REQUIRES' FROM part WHERE p_partkey % 2 = 0")
def _(t):
    new = t.part.select(F.concat(F.lit("law:"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(-1)).alias("src"), F.concat(F.lit("evidence:"), "p_brand").alias("dst"), F.lit("REQUIRES").alias("type"))
    return graph.insert_edges(edges(t), new.unionByName(new), entities(t))


@query("a20_a21_search_results", "SELECT page_id, least(1000, greatest(1, page_id * 7)) AS max_results, url AS locator, 'URL' AS kind FROM pages")
def _(t):
    from graphloom.sources.search_results import clamp, to_manifest

    held = t.pages.select("page_id", "url", F.lit("t").alias("title"))
    return to_manifest(held).select("page_id", clamp(F.col("page_id") * 7).alias("max_results"), "locator", "kind")


@query("c1_c3_point_lookups", f"{EE} SELECT id, type, name FROM entities WHERE id IN ('law:5', 'legal_claim:7') OR name = 'NATION_3' ")
def _(t):
    return entities(t).filter(F.col("id").isin("law:5", "legal_claim:7") | (F.col("name") == "NATION_3")).select("id", "type", "name")


@query("c2_c4_existing", f"{EE} SELECT DISTINCT 'law:' || l_partkey AS id FROM lineitem")
def _(t):
    wanted = t.lineitem.select(F.concat(F.lit("law:"), "l_partkey").alias("id"))
    return entities(t).select("id").join(wanted, "id", "left_semi")


@query("c5_relationships", f"{EE} SELECT src, dst, type FROM edges WHERE type = 'RESULTS_IN' AND dst IN ('legal_outcome:3', 'legal_outcome:9')")
def _(t):
    return edges(t).filter((F.col("type") == "RESULTS_IN") & F.col("dst").isin("legal_outcome:3", "legal_outcome:9"))


def _bm25(where: str, having: str, top: int) -> str:
    return f"""WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS l FROM documents),
      p AS (SELECT id, len(l) AS len, unnest(l) AS term FROM d), tf AS (SELECT id, term, len, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
      st AS (SELECT count(*) AS n, avg(len(l)) AS al FROM d),
      q AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower({where}), '[^a-z0-9]+'), lambda x: x <> ''))) AS term FROM benchmark),
      w AS (SELECT query_id, count(*) AS wanted FROM q GROUP BY 1),
      s AS (SELECT q.query_id, tf.id, count(DISTINCT q.term) AS hit, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)
      SELECT query_id, id, round(score, 6) AS score FROM s JOIN w USING (query_id) {having} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= {top}"""


@query("c6_bm25_any", _bm25("text", "", 10))
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    return search.search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), docs, ["text"], 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("c7_bm25_all", _bm25("text", "WHERE hit = wanted", 5))
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return search.search(asked, docs, ["text"], 5, all_terms=True).select("query_id", "id", F.round("score", 6).alias("score"))


def _stored_index(t):
    from graphloom.operators.text_index import TextIndex
    from graphloom.storage import scratch_path

    return TextIndex.write(t.documents.select(F.col("doc_id").alias("id"), "text"), ["text"], scratch_path(t._spark, "text-index"))


@query("c6_stored_index", _bm25("text", "", 10))
def _(t):
    return _stored_index(t).search(t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("c7_stored_index", _bm25("substr(text, 1, 40)", "WHERE hit = wanted", 5))
def _(t):
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("text"))
    return _stored_index(t).search(asked, 5, all_terms=True).select("query_id", "id", F.round("score", 6).alias("score"))


@query("c8_phrases", "SELECT DISTINCT p_name AS name FROM part WHERE contains(' ' || lower(p_name) || ' ', ' red ') ORDER BY 1 LIMIT 50")
def _(t):
    return search.phrase(t.part, "p_name", "Red")


@query("c9_like", f"{EE} SELECT id, name FROM entities WHERE contains(lower(name), 'old') OR contains(lower(description), 'old') ORDER BY id LIMIT 50")
def _(t):
    return search.like(entities(t), ["name", "description"], "Old").select("id", "name")


@query("c10_graph_slice", f"{EE}, f AS (SELECT id FROM entities WHERE type IN ('law', 'case_document') AND coalesce(jurisdiction, 'BUILDING') = 'BUILDING') SELECT id, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 50 OFFSET 50")
def _(t):
    held = entities(t).filter("type in ('law', 'case_document') and coalesce(jurisdiction, 'BUILDING') = 'BUILDING'").select("id")
    return search.page(held, 50, 50).select("id", "total")


@query("c11_c12_keyword_snippets", f"{CH} SELECT chunk_id, substr(text, 1, 600) AS snippet FROM chunks WHERE contains(lower(text), 'therinor') ORDER BY chunk_id LIMIT 20")
def _(t):
    return search.snippets(chunks(t), "Therinor")


@query("c12_quote_search", f"{CH}, q AS (SELECT doc_id AS id, doc_id || ':0' AS chunk_id, regexp_extract(text, '[^.!?\\n]+[.!?]') AS text FROM documents), f AS (SELECT * FROM q WHERE contains(lower(text), 'ing') ORDER BY id LIMIT 25) SELECT f.id, f.text AS quote, substr(c.text, 1, 600) AS snippet FROM f LEFT JOIN chunks c USING (chunk_id)")
def _(t):
    first = F.regexp_extract("text", SENTENCE, 0)
    held = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.col("doc_id").cast("string"), F.lit(":0")).alias("chunk_id"), first.alias("text"))
    return search.quotes(held, chunks(t), "ING", 25)


@query("c13_c14_chunk_lookups", f"{CH} SELECT chunk_id, chunk_index FROM chunks WHERE source_id IN ('3', '8', '21') AND lang = 'fr' ORDER BY source_id, chunk_index")
def _(t):
    return chunks(t).filter(F.col("source_id").isin("3", "8", "21") & (F.col("lang") == "fr")).orderBy("source_id", "chunk_index").select("chunk_id", "chunk_index")


@query("c15_required_evidence", f"{with_sql(REQUIRED_SQL)} SELECT claim_type, evidence_id, name, is_critical FROM required")
def _(t):
    return required(t)


@query("c16_c17_claims_by_type", f"{EE} SELECT id, status FROM entities WHERE claim_type = '2-HIGH' AND starts_with(id, 'legal_claim:1') ORDER BY id LIMIT 40")
def _(t):
    return entities(t).filter("claim_type = '2-HIGH' and startswith(id, 'legal_claim:1')").orderBy("id").limit(40).select("id", "status")


@query("c17_stored_claims", f"{EE} SELECT c.id AS claim, c.name, coalesce(string_agg(n.name, ',' ORDER BY n.id), '') AS evidence FROM entities c LEFT JOIN edges e ON e.src = c.id AND e.type = 'HAS_EVIDENCE' LEFT JOIN entities n ON n.id = e.dst WHERE c.type = 'legal_claim' AND starts_with(c.id, 'legal_claim:12') GROUP BY 1, 2")
def _(t):
    return graph.stored_claims(entities(t), edges(t), "legal_claim:12").withColumn("evidence", F.array_join("evidence", ","))


@query("c18_retrieval_types", f"{EE} SELECT type, count(*) AS n FROM entities WHERE type IN ({', '.join(repr(x) for x in d.RETRIEVAL_TYPES)}) GROUP BY 1")
def _(t):
    return entities(t).filter(F.col("type").isin(*d.RETRIEVAL_TYPES)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("c20_minimum_length", "SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 100")
def _(t):
    return t.documents.filter(F.length(tx.strip("text")) >= 100).select("doc_id")


@query("g1_priority_union", f"{EE}, a AS (SELECT id FROM entities WHERE type = 'law' AND name LIKE 'red%'), b AS (SELECT id FROM entities WHERE type = 'law' AND description = 'SMALL'), u AS (SELECT id, 0 AS priority FROM a UNION ALL SELECT id, 1 FROM b) SELECT id, CAST(min(priority) AS INT) AS priority FROM u GROUP BY 1")
def _(t):
    laws = entities(t).filter("type = 'law'")
    return retrieval.priority_union([laws.filter("name like 'red%'").select("id"), laws.filter("description = 'SMALL'").select("id")], ["id"])


@query("g2_dedup_by_name", f"{EE}, m AS (SELECT id AS old, min(id) OVER (PARTITION BY type, lower(name)) AS new FROM entities) SELECT old, new FROM m")
def _(t):
    return dedup.by_name(entities(t))[1]


@query("g2_filled_entities", f"{EE} SELECT min(id) AS id, type, min_by(name, id) AS name, min_by(description, id) FILTER (WHERE description IS NOT NULL) AS description FROM entities GROUP BY type, lower(name)")
def _(t):
    return dedup.by_name(entities(t))[0].select("id", "type", "name", "description")


@query("g4_canonical_sources", "SELECT o_custkey AS id, max_by(o_orderkey, lpad(CAST(6 - o_orderkey % 6 AS VARCHAR), 2, '0') || strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(10000000 - o_orderkey AS VARCHAR), 9, '0')) AS seq FROM orders GROUP BY 1")
def _(t):
    name = F.element_at(F.array(*map(F.lit, d.AUTHORITIES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    held = t.orders.select(F.col("o_custkey").alias("id"), name.alias("authority"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))
    return dedup.canonical_source(held, "id").select("id", "seq")


@query("g5_multi_source", "SELECT l_orderkey AS id, string_agg(x, ' ' ORDER BY n, x) AS description, max(s) AS sources FROM (SELECT l_orderkey, '[' || l_returnflag || '] ' || l_linestatus AS x, min(l_linenumber) AS n, max(sn) AS s FROM (SELECT *, (SELECT count(DISTINCT l_returnflag) FROM lineitem k WHERE k.l_orderkey = l.l_orderkey) AS sn FROM lineitem l) GROUP BY 1, 2) GROUP BY 1")
def _(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("source"), F.lit("n").alias("name"), F.col("l_linestatus").alias("description"))
    return dedup.multi_source(rows).select("id", "description", "sources")


PAIRS = "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query("g6_i2_similar_pairs", f"{PAIRS} SELECT a, b, round(score, 6) AS score FROM p WHERE score >= 0.3")
def _(t):
    held = t.embeddings.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), "embedding")
    return vectors.similar_pairs(held, 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query("g6_greedy_consolidation")
def _(t):
    held = t.embeddings.select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), "embedding")
    return vectors.greedy_merges(held, 0.3).select("kept", "dropped", F.round("score", 6).alias("score"))


@query("g7_token_pairs", "WITH e AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name || ' ' || p_brand), ' ')) AS w FROM part), x AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS score FROM e a JOIN e b ON a.id < b.id) SELECT a, b, round(score, 6) AS score FROM x WHERE score >= 0.95")
def _(t):
    held = t.part.select(F.col("p_partkey").alias("id"), F.lit("law").alias("type"), F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "#", "x")).alias("name"))
    return dedup.token_pairs(held).select("a", "b", F.round("score", 6).alias("score"))


@query("g9_source_dedup", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source || '::' || substr(text, 1, 64) ORDER BY doc_id) = 1")
def _(t):
    return dedup.first_by_key(t.documents.select("doc_id", "source", F.col("text").alias("quote")), dedup.quote_key(), ["doc_id"]).select("doc_id")


@query("g10_manifest_merge", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'new' ELSE 'old' END AS title FROM pages")
def _(t):
    old = t.pages.select(F.col("page_id").alias("locator"), F.lit("old").alias("title"))
    return manifest.merge(old, old.filter("locator % 3 = 0").withColumn("title", F.lit("new"))).select(F.col("locator").alias("page_id"), "title")


@query("g11_clean_quotes", "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, trim(unnest(x), ' ') AS q FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), f AS (SELECT doc_id, q, min(i) AS i FROM l WHERE q <> '' GROUP BY 1, 2) SELECT doc_id AS id, sha256(string_agg(q, '|' ORDER BY i)) AS digest FROM f GROUP BY 1")
def _(t):
    return dedup.clean_quotes(t.documents.filter(tx.strip("text") != "").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("quotes"))).select("id", F.sha2(F.array_join("quotes", "|").cast("binary"), 256).alias("digest"))


@query("g12_tag_unions", "SELECT c_custkey, list_aggregate(list_sort(list_distinct([lower(c_mktsegment), 'n' || (c_nationkey % 3), lower(substr(c_mktsegment, 1, 4)), 'n' || (c_nationkey % 2)])), 'string_agg', ',') AS tags FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.array_join(F.array_sort(F.array_union(F.array(F.lower("c_mktsegment"), F.concat(F.lit("n"), (F.col("c_nationkey") % 3).cast("string"))), F.array(F.lower(F.substring("c_mktsegment", 1, 4)), F.concat(F.lit("n"), (F.col("c_nationkey") % 2).cast("string"))))), ",").alias("tags"))


@query("g13_g14_provenance", "SELECT l_partkey AS id, count(DISTINCT l_suppkey || '::' || l_returnflag) AS rows, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1")
def _(t):
    from graphloom.operators.ingest import provenance_rows

    text = lambda c: F.col(c).cast("string")
    rows = t.lineitem.select(F.lit("law").alias("subject_type"), text("l_partkey").alias("subject_id"), text("l_suppkey").alias("source_id"), F.col("l_returnflag").alias("quote_id"), F.lit(None).cast("string").alias("chunk_id"))
    return provenance_rows(rows).groupBy(F.col("subject_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source_id").alias("sources"))


@query("i1_cosine_top_k", "WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0) SELECT query_id, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) <= 10")
def _(t):
    asked = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(asked, t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 10).select("query_id", "id", F.round("score", 6).alias("score"))


@query("i3_guarded_cosine", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) END AS score FROM embeddings")
def _(t):
    other = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.reverse("embedding"))
    return t.embeddings.select("vec_id", F.round(vectors.cosine(F.col("embedding"), other), 6).alias("score"))


@query("i4_nearest_type", "WITH k AS (SELECT min(vec_id) AS v, label FROM embeddings GROUP BY label), s AS (SELECT e.vec_id AS id, 'type ' || k.label AS name, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings e, k JOIN embeddings c ON c.vec_id = k.v), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, name) = 1) SELECT id, name, round(score, 6) AS score FROM b WHERE score >= 0.2")
def _(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return vectors.nearest(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), first.select(F.concat(F.lit("type "), "label").alias("name"), "embedding"), 0.2).select("id", "name", F.round("score", 6).alias("score"))


@query("g3_g8_merged_entities", "WITH m AS (SELECT p_partkey % 500 AS id, p_partkey, p_name, p_type FROM part) SELECT id, min_by(p_name, p_partkey) AS name, max_by(p_type, lpad(CAST(length(p_type) AS VARCHAR), 3, '0') || lpad(CAST(100000000 - p_partkey AS VARCHAR), 10, '0')) AS description, count(*) AS members FROM m GROUP BY 1")
def _(t):
    held = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.col("p_brand")).alias("chunk_ids"))
    moved = held.filter("id >= 500").select(F.col("id").alias("old"), (F.col("id") % 500).alias("new"))
    return dedup.merged(held, moved).select("id", "name", "description", "members")


@query("i5_canonical_types", "SELECT 'type ' || label || ' ' || s AS name, 'type ' || label || ' a' AS canonical FROM (SELECT DISTINCT label FROM embeddings), (VALUES ('a'), ('b'), ('c')) v(s)")
def _(t):
    # Every type under three names: the later ones, of the same direction, become aliases of the first.
    held = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e")).collect()  # one row for each label, a dictionary
    first = {f"type {r.label} {s}": [x * scale for x in r.e] for r in held for s, scale in (("a", 1.0), ("b", 2.0), ("c", 0.5))}
    return t._spark.createDataFrame(sorted(vectors.canonical_types(sorted(first), first, 0.8)[1].items()), "name string, canonical string")


@query("i7_embedding_cache", "SELECT sha256(text) AS text_hash, bool_or(doc_id % 2 = 0) AS cached, 32 AS size FROM documents GROUP BY 1")
def _(t):
    encode = vectors.hashing_encoder(32)
    cache = t.documents.filter("doc_id % 2 = 0").select(tx.sha("text").alias("text_hash"), encode("text").alias("embedding")).dropDuplicates(["text_hash"])
    return vectors.encode_missing(t.documents, cache, encode).select("text_hash", "cached", F.size("embedding").alias("size"))


@query("i8_approximate_pairs")
def _(t):
    return vectors.approximate_pairs(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 0.3).select("a", "b", F.round("score", 6).alias("score"))


@query("i8_inverted_file")
def _(t):
    from graphloom.operators.vector_index import InvertedFile
    from graphloom.storage import scratch_path

    held = t.embeddings.select(F.col("vec_id").alias("id"), "embedding")
    index = InvertedFile.write(held, scratch_path(t._spark, "inverted-file"))
    return index.search(held.filter("id % 20 = 0").withColumnRenamed("id", "query_id")).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_LABELLED = "e AS (SELECT vec_id AS id, label AS type, coalesce(p_name, '') AS name, embedding FROM embeddings LEFT JOIN part ON p_partkey = vec_id)"
RESOLVED = f"""WITH {_LABELLED}, {candidates_sql(["name"], 5, True)}, x AS (SELECT c.id, c.match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM c JOIN e a ON a.id = c.id JOIN e b ON b.id = c.match),
  best AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match) = 1), r AS (SELECT e.id, e.type, e.name, match, score, CASE WHEN score >= 0.4 THEN 'merge' WHEN score >= 0.3 THEN 'judge' ELSE 'new' END AS decision FROM e LEFT JOIN best USING (id))"""


def _labelled(t):
    """Vectors as entities of their label, with the name of the part of their number."""
    held = t.embeddings.join(t.part.select(F.col("p_partkey").alias("vec_id"), "p_name"), "vec_id", "left")
    return held.select(F.col("vec_id").alias("id"), F.col("label").alias("type"), F.coalesce("p_name", F.lit("")).alias("name"), "embedding")


@query("i6_resolution_cascade", f"{RESOLVED} SELECT id, match, round(score, 6) AS score, decision FROM r")
def _(t):
    return candidates.resolve(_labelled(t), _labelled(t), 5, 0.4, 0.3).withColumn("score", F.round("score", 6))


@query("g14_resolution_cache", f"{RESOLVED}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY type, name ORDER BY id) = 1) SELECT e.id, f.match, round(f.score, 6) AS score, f.decision FROM e JOIN f USING (type, name)")
def _(t):
    return candidates.resolve_once(_labelled(t), _labelled(t), k=5, merge=0.4, judge=0.3).withColumn("score", F.round("score", 6))


HYBRID = f"""{with_sql(ENTITIES_SQL, EDGES_SQL)}, q AS (SELECT p_name AS text, row_number() OVER (ORDER BY p_name) AS query_id FROM (SELECT DISTINCT p_name FROM part)),
  k AS (SELECT id, string_split(lower(name), ' ') AS w FROM entities WHERE type = 'law'), tf AS (SELECT id, len(w) AS len, unnest(w) AS term FROM k), df AS (SELECT term, count(DISTINCT id) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len(w)) AS al FROM k),
  s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / al))) AS score FROM (SELECT query_id, unnest(string_split(text, ' ')) AS term FROM q) JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
  lex AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s QUALIFY rank <= 10), linked AS (SELECT query_id, min(e.id) AS id FROM q JOIN entities e ON e.name = q.text AND e.type = 'law' GROUP BY 1),
  roots AS (SELECT query_id, id FROM linked UNION SELECT query_id, id FROM lex), both_ways AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges),
  near AS (SELECT DISTINCT query_id, other AS id FROM (SELECT query_id, node, other, row_number() OVER (PARTITION BY query_id, node ORDER BY other) AS r FROM (SELECT DISTINCT query_id, node, other FROM roots JOIN both_ways ON node = id)) WHERE r <= 10),
  u AS (SELECT query_id, id, 0 AS priority FROM linked UNION ALL SELECT query_id, id, 1 FROM lex UNION ALL SELECT query_id, id, 2 FROM near)
  SELECT query_id, id, CAST(min(priority) AS INT) AS priority FROM u WHERE id IN (SELECT id FROM entities WHERE type IN ({", ".join(repr(x) for x in d.RETRIEVAL_TYPES)})) GROUP BY 1, 2"""


@query("f6_g1_hybrid_retrieval", HYBRID)
def _(t):
    from graphloom.operators.retrieval import hybrid

    ent = entities(t)
    asked = t.part.select("p_name").distinct().withColumn("query_id", F.row_number().over(Window.orderBy("p_name")).cast("long")).select("query_id", F.col("p_name").alias("text"))
    lexical = search.search(asked, ent.filter("type = 'law'").select("id", "name"), ["name"], 10).select("query_id", "id", "rank")
    linked = asked.join(ent.filter("type = 'law'").select("id", F.col("name").alias("text")), "text").groupBy("query_id").agg(F.min("id").alias("id"))
    return hybrid(linked, lexical, edges(t), ent.filter(F.col("type").isin(*d.RETRIEVAL_TYPES)).select("id"))
