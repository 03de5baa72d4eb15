"""Ranked lists: fusion, priority union, source index, and hybrid retrieval for a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import dictionaries as d


def ranked(df: DataFrame, order: list[Column | str], top: int, by: list[str] = ()) -> DataFrame:
    """The first ``top`` rows in order, of each group if there are any, with their rank from 1."""
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return df.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``top`` rows


def fuse(lists: DataFrame, k: int = 60, by: list[str] = ()) -> DataFrame:
    """id, score: reciprocal rank fusion of ranked lists (id, rank), for each query if ``by`` names one."""
    return lists.groupBy(*by, "id").agg(F.sum(F.lit(1.0).cast("double") / (k + F.col("rank"))).alias("score"))


def priority_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of tables in order of priority: a key that an earlier one has is dropped from the later ones. Adds priority."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("priority", F.lit(i))
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy(*keys).orderBy("priority")
    return out.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def authority_rank(name: Column) -> Column:
    out = F.lit(0)
    for a, rank in d.AUTHORITY_RANK.items():
        out = F.when(F.lower(name) == a, rank).otherwise(out)
    return out


def source_index(sources: DataFrame, tie: list[str], top: int = 20, prefix: int = 64) -> DataFrame:
    """Sources (source, quote, authority, jurisdiction) once for each source and beginning of the quote, in order of authority, labelled S1 to Sn."""
    order = [F.desc(authority_rank(F.col("authority"))), F.coalesce("jurisdiction", F.lit("")), *tie]
    first = F.row_number().over(Window.partitionBy("source", F.substring("quote", 1, prefix)).orderBy(*order))
    kept = sources.withColumn("r", first).filter("r = 1").drop("r")
    return ranked(kept, order, top).withColumn("label", F.concat(F.lit("S"), "rank"))


def hybrid(linked: DataFrame, lexical: DataFrame, edges: DataFrame, allowed: DataFrame, per_node: int = 10, seeds: int = 20) -> DataFrame:
    """query_id, id, priority: linked entities, then those found by text, then neighbours of both; only allowed ids (id).

    Tables: linked (query_id, id), lexical (query_id, id, rank).
    """
    from .graph import undirected

    first = linked.select("query_id", "id").distinct()
    found = lexical.select("query_id", "id")
    roots = first.unionByName(lexical.filter(F.col("rank") <= seeds).select("query_id", "id")).distinct()
    near = undirected(edges).join(roots.withColumnRenamed("id", "node"), "node").select("query_id", "node", F.col("other").alias("id")).distinct()
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "node").orderBy("id"))).filter(F.col("r") <= per_node).select("query_id", "id").distinct()
    return priority_union([first, found, near], ["query_id", "id"]).join(allowed.select("id"), "id", "left_semi")
