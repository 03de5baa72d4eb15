"""Counts over a graph: histograms, orphans, linkage, completeness, duplicates, richness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees, undirected


def by_type(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """type, orphans, total, percent (whole): entities without an edge."""
    held = degrees(entities, edges)
    return held.groupBy("type").agg(F.count_if(F.col("degree") == 0).alias("orphans"), F.count(F.lit(1)).alias("total")).withColumn("percent", F.floor(F.col("orphans") * 100 / F.col("total")))


def presence(df: DataFrame, flag: str, by: str = "type") -> DataFrame:
    """by, with, without, percent: how many rows have the boolean."""
    return df.groupBy(by).agg(F.count_if(F.col(flag)).alias("with"), F.count_if(~F.col(flag)).alias("without"), F.round(F.avg(F.col(flag).cast("int")) * 100, 4).alias("percent"))


def claim_completeness(entities: DataFrame, edges: DataFrame, evidence: str = "HAS_EVIDENCE") -> DataFrame:
    """has_evidence, has_law, n over claims."""
    claims = entities.filter("type = 'legal_claim'").select("id")
    proofs = edges.filter(F.col("type") == evidence).select(F.col("src").alias("id")).distinct().withColumn("e", F.lit(True))
    laws = undirected(edges).filter(F.col("other").startswith("law:")).select(F.col("node").alias("id")).distinct().withColumn("l", F.lit(True))
    met = claims.join(proofs, "id", "left").join(laws, "id", "left")
    return met.groupBy(F.coalesce("e", F.lit(False)).alias("has_evidence"), F.coalesce("l", F.lit(False)).alias("has_law")).agg(F.count(F.lit(1)).alias("n"))


def out_profile(entities: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """id, n_edges, types: outgoing edges of the entities of a type, also of those without."""
    held = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return entities.filter(F.col("type") == kind).select("id").join(held, "id", "left").select("id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("types", F.lit("")).alias("types"))


def duplicate_names(entities: DataFrame, top: int = 20) -> DataFrame:
    """name (lower case), type, n > 1, the most frequent first."""
    return entities.groupBy(F.lower("name").alias("name"), "type").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "name", "type").limit(top)


def connection_bands(entities: DataFrame, edges: DataFrame, least: int, top: int) -> tuple[DataFrame, DataFrame]:
    """(under, well): nodes with ``least`` edges at most, and the ``top`` best connected of the others."""
    held = degrees(entities, edges)
    return held.filter(F.col("degree") <= least), held.filter(F.col("degree") > least).orderBy(F.desc("degree"), "id").limit(top)


def insights(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """type, n, strong, weak: nodes with at least 1.5 times, or under half of, the mean degree."""
    # Degrees are counted once, into a histogram with a row for each type and degree; the window runs over that.
    held, every = degrees(entities, edges).groupBy("type", "degree").agg(F.count(F.lit(1)).alias("nodes")), Window.partitionBy()
    held = held.withColumn("mean", F.sum(F.col("degree") * F.col("nodes")).over(every) / F.sum("nodes").over(every))
    some = lambda condition: F.sum(F.when(condition, F.col("nodes")).otherwise(0))
    strong, weak = F.col("degree") >= 1.5 * F.col("mean"), F.col("degree") < 0.5 * F.col("mean")
    return held.groupBy("type").agg(F.sum("nodes").alias("n"), some(strong).alias("strong"), some(weak).alias("weak"))


def supporting(edges: DataFrame, names: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """src, dst, relationship, strength: the edges of supporting types (type to strength), told by the names of their ends (id, name); an end without a name is told by its key."""
    name = lambda end: names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    held = edges.filter(F.upper("type").isin(*kinds)).join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    told = lambda end: F.coalesce(f"{end}_name", F.substring_index(end, ":", -1))
    strength = F.element_at(F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair)), F.upper("type"))
    return held.select("src", "dst", F.concat_ws(" ", told("src"), "type", told("dst")).alias("relationship"), strength.alias("strength"))


def confidence(entities: DataFrame, edges: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row about a graph: mean_degree, relations, supporting, strong, types (as text) and confidence.

    Half, and more for many relations, for strongly connected nodes (1.5 times the mean degree of the connected ones) and for supporting edges; 1 at most.
    """
    degrees_ = undirected(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))
    every = Window.partitionBy()
    strong = degrees_.withColumn("mean", F.sum(F.col("degree") * F.col("nodes")).over(every) / F.sum("nodes").over(every))
    strong = strong.agg(F.first("mean").alias("mean_degree"), F.sum(F.when(F.col("degree") >= 1.5 * F.col("mean"), F.col("nodes")).otherwise(0)).alias("strong"))
    by_type = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda x: F.concat_ws("=", x["type"], x["n"].cast("string"))), ",")
    counts = by_type.agg(F.sum("n").alias("relations"), F.sum(F.when(F.upper("type").isin(*kinds), F.col("n")).otherwise(0)).alias("supporting"), told.alias("types"))
    met = counts.crossJoin(strong)  # a row each
    n, s, k = F.col("relations"), F.col("strong"), F.col("supporting")
    score = F.lit(0.5) + F.when(n > 10, 0.2).when(n > 5, 0.1).otherwise(0.0) + F.when(s > 3, 0.15).when(s > 0, 0.1).otherwise(0.0) + F.when(k > 5, 0.15).otherwise(0.0)
    return met.select("mean_degree", "relations", "supporting", "strong", "types", F.least(F.lit(1.0), score).alias("confidence"))


def hit_lists(hits: DataFrame, by: str, top: int = 10, size: int = 200) -> DataFrame:
    """by, best, n, chunk_ids, previews: groups of scored chunks with all their chunks in order of the score, and the beginnings of these; the best groups first."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "chunk_id", F.substring("text", 1, size).alias("preview"))))
    held = hits.groupBy(by).agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), ordered.alias("hits"))
    return held.orderBy(F.desc("best"), by).limit(top).select(by, "best", "n", F.col("hits.chunk_id").alias("chunk_ids"), F.col("hits.preview").alias("previews"))


def richness(entities: DataFrame) -> DataFrame:
    """kind, value, n: histograms of type, authority, claim type and context of evidence over entities; rows without the value are left out."""
    kinds = [c for c in ("type", "authority", "claim_type", "evidence_context") if c in entities.columns]
    each = entities.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds))).alias("x"))
    return each.select("x.kind", "x.value").filter("value is not null").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def strength_label(x):
    return F.when(x >= 0.7, "Strong").when(x >= 0.4, "Moderate").when(x > 0, "Weak").otherwise("Insufficient")


def best_hits(hits: DataFrame, by: str, top: int = 10, size: int = 200) -> DataFrame:
    """by, best, n, preview: groups of scored chunks, with the beginning of the best one."""
    best = F.max_by("text", F.struct("score", F.col("chunk_id")))
    return hits.groupBy(by).agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("n"), F.substring(best, 1, size).alias("preview")).orderBy(F.desc("best"), by).limit(top)
