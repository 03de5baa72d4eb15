"""Metrics: quotes, linkage, retrieval, claims, outcomes, remedies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx

from .rules import is_definition


def quote_quality(entities: DataFrame) -> DataFrame:
    """coverage, completeness, length_ok, n over entities (name, quote)."""
    has = F.coalesce(F.col("quote"), F.lit("")) != ""
    named = has & F.contains(F.lower("quote"), F.lower("name"))
    share = lambda x: F.when(F.count_if(has) > 0, F.count_if(x) / F.count_if(has)).otherwise(0.0)
    return entities.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 0, F.count_if(has) / F.count(F.lit(1))).otherwise(0.0).alias("coverage"), share(named).alias("completeness"), share(has & F.length("quote").between(50, 400)).alias("length_ok"))


def quote_score(name: Column, quote: Column) -> Column:
    """0.3 for the name, 0.3 for a definition, 0.4 for a length of 50 to 400; 0 without a quote."""
    return F.when(F.coalesce(quote, F.lit("")) == "", 0.0).otherwise(F.when((name != "") & F.contains(F.lower(quote), F.lower(name)), 0.3).otherwise(0.0) + F.when(is_definition(quote), 0.3).otherwise(0.0) + F.when(F.length(quote).between(50, 400), 0.4).otherwise(0.0))


def linkage(entity_chunks: DataFrame, chunk_entities: DataFrame, n_entities: int, n_chunks: int) -> DataFrame:
    """entity_coverage, chunk_coverage, consistency: shares of linked entities and chunks, and of links known from both sides. Tables: (entity, chunk)."""
    a, b = entity_chunks.select("entity", "chunk").distinct(), chunk_entities.select("entity", "chunk").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["entity", "chunk"], "full")
    stats = both.agg(F.count_distinct(F.when(F.col("a") == 1, F.col("entity"))).alias("e"), F.count_distinct(F.when(F.col("b") == 1, F.col("chunk"))).alias("c"), F.avg(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1.0).otherwise(0.0)).alias("consistency"))
    return stats.select((F.col("e") / F.lit(float(max(1, n_entities)))).alias("entity_coverage"), (F.col("c") / F.lit(float(max(1, n_chunks)))).alias("chunk_coverage"), F.coalesce("consistency", F.lit(0.0)).alias("consistency"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """query_id, precision, recall, mrr at k. Tables: ranked (query_id, id, rank), relevant (query_id, id)."""
    truth = relevant.select("query_id", "id").distinct()
    n = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = ranked.filter(F.col("rank") <= k).join(truth, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count_distinct("id").alias("hit"), F.min("rank").alias("first"))
    hit = F.coalesce("hit", F.lit(0))
    return n.join(met, "query_id", "left").select("query_id", (hit / F.lit(float(k))).alias("precision"), (hit / F.col("n")).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def normal_claim(x: Column, aliases: Mapping[str, str] = d.CLAIM_ALIASES) -> Column:
    key = F.regexp_replace(F.lower(F.trim(x)), "[ -]", "_")
    table = F.create_map(*(F.lit(v) for pair in aliases.items() for v in pair))
    return F.coalesce(F.try_element_at(table, key), F.regexp_replace(F.upper(x), " ", "_"))


def claim_overlap(predicted: Column, actual: Column) -> Column:
    """struct<precision, recall, f1> of two arrays of claim types after normalisation; all 1 if nothing is expected."""
    p, a = F.array_distinct(F.transform(predicted, lambda x: normal_claim(x))), F.array_distinct(F.transform(actual, lambda x: normal_claim(x)))
    hit = F.size(F.array_intersect(p, a)).cast("double")
    precision, recall = F.when(F.size(p) > 0, hit / F.size(p)).otherwise(0.0), hit / F.size(a)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    one = F.lit(1.0)
    return F.when(F.size(a) == 0, F.struct(one.alias("precision"), one.alias("recall"), one.alias("f1"))).otherwise(F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1")))


def outcome_matches(predicted: Column, actual: Column, terms: Mapping[str, Sequence[str]] = d.OUTCOME_TERMS) -> Column:
    p, a = F.lower(F.trim(F.coalesce(predicted, F.lit("")))), F.lower(F.trim(actual))
    out = F.when(p == "", False).when(p == a, True)
    for name, words in terms.items():
        out = out.when((a == name) & p.isin(*words), True)
    return out.otherwise(False)


def remedy_matches(actual: Column, predicted: Column, least: float = 0.4, concepts: Mapping[str, Sequence[str]] = d.REMEDY_CONCEPTS) -> Column:
    """Whether a predicted remedy means the actual one: by words, containment or a shared concept."""
    a, p = F.lower(actual), F.lower(predicted)
    aw, pw = F.array_distinct(tx.words(a)), F.array_distinct(tx.words(p))
    out = (F.size(F.array_intersect(aw, pw)) / F.greatest(F.size(aw), F.lit(1)) >= least) | F.contains(a, p) | F.contains(p, a)
    for words in concepts.values():
        out = out | (tx.any_of(a, words) & tx.any_of(p, words))
    return out


def remedy_recall(actual: Column, predicted: Column) -> Column:
    """Share of actual remedies (array) that a predicted one (array) means; 1 if none is expected."""
    hit = F.size(F.filter(actual, lambda a: F.exists(predicted, lambda p: remedy_matches(a, p))))
    return F.when(F.size(actual) == 0, 1.0).otherwise(hit / F.size(actual))


def coverage(said: Column, expected: Column) -> Column:
    """Share of expected strings (array) that a text contains, whatever the case; 1 if none is expected."""
    hit = F.size(F.filter(expected, lambda e: F.contains(F.lower(said), F.lower(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hit / F.size(expected))


def macro(rows: DataFrame, *metrics: str) -> DataFrame:
    """Averages of metrics over rows, abstentions (predicted null) counted, accuracy where there is a prediction. Table: predicted, correct, metrics."""
    given = F.col("predicted").isNotNull()
    return rows.agg(*(F.avg(m).alias(m) for m in metrics), F.count_if(~given).alias("abstained"), F.avg(F.when(given, F.col("correct").cast("int"))).alias("accuracy_when_predicted"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def overall(*metrics: str) -> Column:
    """The mean of the metrics that are there."""
    held = F.filter(F.array(*metrics), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held))


def best_rank(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
