"""The driver tables as a knowledge graph: entities, edges, required evidence and chunks, as DataFrames and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Tables

#: Courts that claims and laws are dealt to.
COURTS = 1000
_NONE = lambda: F.lit(None).cast("string")


def entities(t: Tables) -> DataFrame:
    """id, type, name, description, jurisdiction, claim_type, status, outcome."""

    def rows(df: DataFrame, kind: str, key, name, **more) -> DataFrame:
        cols = {"description": _NONE(), "jurisdiction": _NONE(), "claim_type": _NONE(), "status": _NONE(), "outcome": _NONE()} | more
        return df.select(F.concat(F.lit(f"{kind}:"), key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), *(v.alias(k) for k, v in cols.items()))

    text = lambda c: F.col(c).cast("string")
    court = lambda c, word: F.concat(F.lit(f"{word} "), (F.col(c) % COURTS).cast("string"))
    outcome = F.when(F.col("c_acctbal") < 0, "defendant_win").when(F.col("c_acctbal") >= 5000, "plaintiff_win").otherwise("settlement")
    parts = [
        rows(t.orders, "legal_claim", text("o_orderkey"), F.concat(F.lit("claim "), text("o_orderkey")), description=F.concat_ws(" ", "o_orderpriority", "o_orderstatus"), jurisdiction=court("o_orderkey", "Court"), claim_type=F.col("o_orderpriority"), status=F.col("o_orderstatus")),
        rows(t.part, "law", text("p_partkey"), F.col("p_name"), description=F.col("p_type"), jurisdiction=court("p_partkey", "court")),
        rows(t.supplier, "legal_outcome", text("s_suppkey"), F.col("s_name")),
        rows(t.customer, "case_document", text("c_custkey"), F.col("c_name"), jurisdiction=F.col("c_mktsegment"), outcome=outcome),
        rows(t.part.groupBy("p_brand").agg(F.concat_ws(" ", F.min("p_type"), F.min("p_name")).alias("about")), "evidence", F.col("p_brand"), F.col("p_brand"), description=F.col("about")),
        rows(t.nation, "jurisdiction", text("n_nationkey"), F.col("n_name")),
        rows(t.region, "legal_concept", text("r_regionkey"), F.col("r_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def edges(t: Tables, ends: tuple[str, ...] | None = None) -> DataFrame:
    """src, dst, type; distinct; of ``ends``, types of entities, those between any of them alone, so that a plan reads no other tables.

    No two parts share an edge, so each is made distinct alone, on its keys as
    they are, and not at all where a key of its table is in it. Rows are hardly repeated: they are dealt
    out before, to as many tasks as Spark is told, since many millions of them lie in few bytes.
    """
    deal = int(t._spark.conf.get("spark.sql.shuffle.partitions"))
    end = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    named = lambda df, src, dst, kind: df.select(src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"))
    law_claim = F.when(F.col("l_returnflag") == "A", "ENABLES").when(F.col("l_returnflag") == "N", "ADDRESSES").otherwise("CITES")
    proofs = lambda: t.lineitem.filter("l_quantity > 25").select("l_orderkey", "l_partkey").join(t.part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").repartition(deal, "l_orderkey", "p_brand").distinct()
    parts = [
        ("case_document", "legal_claim", lambda: named(t.orders, end("case_document", "o_custkey"), end("legal_claim", "o_orderkey"), "ADDRESSES")),
        ("law", "legal_claim", lambda: named(t.lineitem.select("l_partkey", "l_orderkey", law_claim.alias("flag")).repartition(deal, "l_partkey", "l_orderkey", "flag").distinct(), end("law", "l_partkey"), end("legal_claim", "l_orderkey"), F.col("flag"))),
        ("legal_claim", "legal_outcome", lambda: named(t.lineitem.filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").repartition(deal, "l_orderkey", "l_suppkey").distinct(), end("legal_claim", "l_orderkey"), end("legal_outcome", "l_suppkey"), "RESULTS_IN")),
        ("law", "legal_outcome", lambda: named(t.lineitem.filter("l_linestatus = 'F'").select("l_partkey", "l_suppkey").repartition(deal, "l_partkey", "l_suppkey").distinct(), end("law", "l_partkey"), end("legal_outcome", "l_suppkey"), "AUTHORIZES")),
        ("legal_claim", "evidence", lambda: named(proofs(), end("legal_claim", "l_orderkey"), end("evidence", "p_brand"), "HAS_EVIDENCE")),
        ("case_document", "jurisdiction", lambda: named(t.customer, end("case_document", "c_custkey"), end("jurisdiction", "c_nationkey"), "FILED_IN")),
    ]
    return reduce(DataFrame.unionByName, (part() for src, dst, part in parts if ends is None or {src, dst} <= set(ends)))


def required(t: Tables) -> DataFrame:
    """claim_type, evidence_id, name, is_critical: required evidence by claim type."""
    number = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    brands = t.part.select("p_brand").distinct().withColumn("n", number)
    types = t.orders.select(F.col("o_orderpriority").alias("claim_type")).distinct().withColumn("d", F.substring("claim_type", 1, 1).cast("int"))
    # Both sides are dictionaries; the remainder makes the join an equi-join.
    pairs = types.withColumn("r", F.pmod(-F.col("d"), F.lit(5))).join(brands.withColumn("r", F.col("n") % 5), "r")
    return pairs.select("claim_type", F.concat(F.lit("evidence:"), "p_brand").alias("evidence_id"), F.col("p_brand").alias("name"), (F.col("n") % 3 == 0).alias("is_critical"))


def chunks(t: Tables, size: int = 1000) -> DataFrame:
    """chunk_id, source_id, chunk_index, text: pieces of documents of ``size`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    cut = t.documents.select(F.col("doc_id").cast("string").alias("source_id"), "lang", "source", "text", F.posexplode(starts).alias("chunk_index", "start"))
    return cut.select(F.concat_ws(":", "source_id", "chunk_index").alias("chunk_id"), "source_id", F.col("chunk_index").cast("long").alias("chunk_index"), "lang", "source", F.col("start").cast("long").alias("start"), F.expr(f"substring(text, start + 1, {size})").alias("text"))


ENTITIES_SQL = f"""entities AS (
  SELECT 'legal_claim:' || o_orderkey AS id, 'legal_claim' AS type, 'claim ' || o_orderkey AS name, o_orderpriority || ' ' || o_orderstatus AS description, 'Court ' || o_orderkey % {COURTS} AS jurisdiction, o_orderpriority AS claim_type, o_orderstatus AS status, NULL::VARCHAR AS outcome FROM orders
  UNION ALL SELECT 'law:' || p_partkey, 'law', p_name, p_type, 'court ' || p_partkey % {COURTS}, NULL, NULL, NULL FROM part
  UNION ALL SELECT 'legal_outcome:' || s_suppkey, 'legal_outcome', s_name, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'case_document:' || c_custkey, 'case_document', c_name, NULL, c_mktsegment, NULL, NULL, CASE WHEN c_acctbal < 0 THEN 'defendant_win' WHEN c_acctbal >= 5000 THEN 'plaintiff_win' ELSE 'settlement' END FROM customer
  UNION ALL SELECT 'evidence:' || p_brand, 'evidence', p_brand, min(p_type) || ' ' || min(p_name), NULL, NULL, NULL, NULL FROM part GROUP BY p_brand
  UNION ALL SELECT 'jurisdiction:' || n_nationkey, 'jurisdiction', n_name, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'legal_concept:' || r_regionkey, 'legal_concept', r_name, NULL, NULL, NULL, NULL, NULL FROM region)"""
EDGES_SQL = """edges AS (
  SELECT 'case_document:' || o_custkey AS src, 'legal_claim:' || o_orderkey AS dst, 'ADDRESSES' AS type FROM orders
  UNION SELECT 'law:' || l_partkey, 'legal_claim:' || l_orderkey, CASE l_returnflag WHEN 'A' THEN 'ENABLES' WHEN 'N' THEN 'ADDRESSES' ELSE 'CITES' END FROM lineitem
  UNION SELECT 'legal_claim:' || l_orderkey, 'legal_outcome:' || l_suppkey, 'RESULTS_IN' FROM lineitem WHERE l_linenumber = 1
  UNION SELECT 'law:' || l_partkey, 'legal_outcome:' || l_suppkey, 'AUTHORIZES' FROM lineitem WHERE l_linestatus = 'F'
  UNION SELECT 'legal_claim:' || l_orderkey, 'evidence:' || p_brand, 'HAS_EVIDENCE' FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25
  UNION SELECT 'case_document:' || c_custkey, 'jurisdiction:' || c_nationkey, 'FILED_IN' FROM customer)"""
BOTH_SQL = """both_ways AS (SELECT src AS node, dst AS other, type FROM edges UNION ALL SELECT dst, src, type FROM edges WHERE src <> dst)"""
REQUIRED_SQL = """required AS (SELECT claim_type, 'evidence:' || p_brand AS evidence_id, p_brand AS name, n % 3 = 0 AS is_critical
  FROM (SELECT DISTINCT o_orderpriority AS claim_type, CAST(substr(o_orderpriority, 1, 1) AS INT) AS d FROM orders), (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS n FROM part) WHERE (d + n) % 5 = 0)"""
CHUNKS_SQL = """chunks AS (SELECT doc_id || ':' || i AS chunk_id, CAST(doc_id AS VARCHAR) AS source_id, CAST(i AS BIGINT) AS chunk_index, lang, source, CAST(i * 1000 AS BIGINT) AS start, substr(text, i * 1000 + 1, 1000) AS text
  FROM (SELECT doc_id, lang, source, text, unnest(range(CAST(greatest(length(text) - 1, 0) // 1000 + 1 AS BIGINT))) AS i FROM documents))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


GRAPH_SQL = with_sql(ENTITIES_SQL, EDGES_SQL, BOTH_SQL)
