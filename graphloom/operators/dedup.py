"""Entities that are the same: exact keys, similar pairs, greedy consolidation, merged rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.storage import release, settled

from .retrieval import authority_rank


def by_name(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, moved): one entity for each type and lower-case name, the first id; its empty fields filled from the others in order. moved: old, new."""
    key = ["type", F.lower("name")]
    order = Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = entities.withColumn("new", F.first("id").over(order))
    fields = [c for c in entities.columns if c not in ("id", "type", "name")]
    filled = held.groupBy("new").agg(*(F.min_by(c, "id").alias(c) for c in ("type", "name")), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c) for c in fields))
    return filled.withColumnRenamed("new", "id"), held.select(F.col("id").alias("old"), "new")


def token_pairs(entities: DataFrame, least: float = 0.95) -> DataFrame:
    """a, b, score: pairs of one type whose names' words reach the Jaccard similarity.

    Entities with the same words are one class; classes are compared, and only the
    pairs that are found are spread over their members. Classes meet by a word of the
    prefix that similar sets must share: of n words, rare ones first, n - ceil(least * n) + 1.
    """
    words = F.array_sort(tx.tokens("name", distinct=True))
    members = entities.select("id", "type", words.alias("w")).filter("size(w) > 0").select("id", "type", F.array_join("w", " ").alias("key"), "w")
    classes = settled(members.select("type", "key", "w").distinct(), "word-classes")
    counts = classes.select("type", F.explode("w").alias("t")).groupBy("type", "t").agg(F.count(F.lit(1)).alias("n"))
    line = F.row_number().over(Window.partitionBy("type", "key").orderBy("n", "t"))
    ordered = classes.select("type", "key", F.size("w").alias("size"), F.explode("w").alias("t")).join(counts, ["type", "t"]).withColumn("k", line)
    prefix = ordered.filter(F.col("k") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1)
    side = lambda df, k, *more: df.select("type", F.col("key").alias(k), *more)
    a, b = side(prefix, "ka", "t", F.col("size").alias("sa")), side(prefix, "kb", "t", F.col("size").alias("sb"))
    met = a.join(b, ["type", "t"]).filter((F.col("ka") < F.col("kb")) & (F.col("sa") >= F.lit(least) * F.col("sb")) & (F.col("sb") >= F.lit(least) * F.col("sa"))).select("type", "ka", "kb").distinct()
    scored = met.join(side(classes, "ka", F.col("w").alias("wa")), ["type", "ka"]).join(side(classes, "kb", F.col("w").alias("wb")), ["type", "kb"])
    scored = scored.select("type", "ka", "kb", tx.jaccard(F.col("wa"), F.col("wb")).alias("score")).filter(F.col("score") >= least)
    near = scored.unionByName(classes.select("type", F.col("key").alias("ka"), F.col("key").alias("kb"), F.lit(1.0).alias("score")))
    spread = near.join(side(members, "ka", F.col("id").alias("x")), ["type", "ka"]).join(side(members, "kb", F.col("id").alias("y")), ["type", "kb"])
    kept = spread.filter((F.col("ka") != F.col("kb")) | (F.col("x") < F.col("y")))
    return kept.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def greedy_merges(pairs: DataFrame) -> DataFrame:
    """kept, dropped, score: pairs (a, b, score) merged from the best down, b into a, skipping pairs one of whose sides is gone.

    Decided in rounds. A side is gone only by a pair that drops it, so the best pair that could drop b does, if the best one that
    could drop its a comes later or there is none. Pairs that a dropped side keeps stay while they come before it is gone. All
    copies of one row so go in one round.
    """
    left, done = settled(pairs.select("a", "b", F.struct((-F.col("score")).alias("s"), "a", "b").alias("r")), "pairs"), None
    while not left.isEmpty():
        first = settled(left.groupBy("b").agg(F.min("r").alias("r")), "first-pairs")
        later = first.select(F.col("b").alias("a"), F.col("r").alias("gone"))
        chosen = settled(first.select(F.col("r.a").alias("a"), "b", "r").join(later, "a", "left").filter("gone is null or r < gone").select("a", "b", "r"), "merges")
        done = chosen if done is None else done.unionByName(chosen)
        gone = chosen.select(F.col("b").alias("a"), F.col("r").alias("gone"))
        rest = left.join(chosen.select("b"), "b", "left_anti").join(gone, "a", "left").filter("gone is null or r < gone").select("a", "b", "r")
        over, left = left, settled(rest, "pairs")
        release(over, first)
    out = left if done is None else done
    return out.select(F.col("a").alias("kept"), F.col("b").alias("dropped"), (-F.col("r.s")).alias("score"))


def resolved(merges: DataFrame) -> DataFrame:
    """old, new: where dropped ids end when what they joined was dropped later."""
    moved = settled(merges.select(F.col("dropped").alias("old"), F.col("kept").alias("new")), "moved")
    while True:
        step = moved.select(F.col("old").alias("new"), F.col("new").alias("next"))
        after = settled(moved.join(step, "new", "left").select("old", F.coalesce("next", "new").alias("new"), F.col("next").isNotNull().alias("went")), "moved")
        if after.filter("went").isEmpty():
            return after.select("old", "new")
        moved = after.select("old", "new")


def _once(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def merged(entities: DataFrame, moved: DataFrame) -> DataFrame:
    """Entities after a merge, with all their columns and the number of members.

    Longest description; chunk ids united; quotes once for each beginning of 100
    characters, provenance for each source and beginning of the quote; the
    source of the highest authority, then the newest; sources counted anew;
    attributes and other columns those of the kept entity, filled from the others
    in order of their ids. Columns that are missing stay away.
    """
    held = entities.join(moved.select(F.col("old").alias("id"), "new"), "id", "left").withColumn("to", F.coalesce("new", "id"))
    own = F.struct((F.col("id") != F.col("to")).alias("other"), F.col("id"))
    given = lambda c, order: F.when(F.col(c).isNotNull(), order)
    # In order of the members; maps have no order, so they are collected as entries.
    listed = lambda c, v: F.flatten(F.transform(F.array_sort(F.collect_list(given(c, F.struct(own.alias("o"), v.alias("v"))))), lambda x: x["v"]))
    text = lambda x, n: F.coalesce(x[n], F.lit(""))
    begun = lambda x: F.concat_ws("::", text(x, "source"), F.substring(text(x, "quote"), 1, 64))
    special = {
        "name": lambda c: F.min_by(c, own), "type": lambda c: F.min_by(c, own), "jurisdiction": lambda c: F.min_by(c, own),
        "description": lambda c: F.min_by(c, given(c, F.struct((-F.length(c)).alias("n"), own.alias("o")))),
        "chunk_ids": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "source_ids": lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))),
        "all_quotes": lambda c: _once(listed(c, F.col(c)), lambda q: F.substring(text(q, "text"), 1, 100)),
        "provenance": lambda c: _once(listed(c, F.col(c)), begun),
        "attributes": lambda c: F.map_from_entries(_once(listed(c, F.map_entries(c)), lambda e: e["key"])),
        "source_metadata": lambda c: F.min_by(c, given(c, F.struct((-authority_rank(F.col(c)["authority"])).alias("a"), (-F.coalesce(F.unix_micros(F.coalesce(F.col(c)["created_at"], F.col(c)["processed_at"])), F.lit(-(2**62)))).alias("at"), own.alias("o")))),
    }
    fields = [special.get(c, lambda c: F.min_by(c, given(c, own)))(c).alias(c) for c in entities.columns if c != "id"]
    out = held.groupBy("to").agg(*fields, F.count(F.lit(1)).alias("members")).withColumnRenamed("to", "id")
    if {"mentions_count", "provenance"} <= set(out.columns):
        sources = F.array_distinct(F.filter(F.transform("provenance", lambda p: text(p, "source")), lambda s: s != ""))
        out = out.withColumn("mentions_count", F.when(F.col("members") > 1, F.size(sources)).otherwise(F.col("mentions_count")))
    return out


def canonical_source(sources: DataFrame, by: str) -> DataFrame:
    """The source of each group with the highest authority, then the newest, then the first (authority, at, seq)."""
    best = F.max_by(F.struct(*sources.columns), F.struct(authority_rank(F.col("authority")), F.col("at"), -F.col("seq")))
    return sources.groupBy(by).agg(best.alias("s")).select("s.*")


def multi_source(rows: DataFrame) -> DataFrame:
    """id, name, description, sources: rows (id, seq, source, name, description) folded in order of arrival; longest name, descriptions as `[source] text` once each."""
    parts = F.array_sort(F.collect_list(F.when(F.col("description").isNotNull(), F.struct("seq", F.concat(F.lit("["), "source", F.lit("] "), "description").alias("d")))))
    return rows.groupBy("id").agg(
        F.max_by("name", F.struct(F.length("name"), -F.col("seq"))).alias("name"), F.array_join(F.array_distinct(F.transform(parts, lambda x: x["d"])), " ").alias("description"), F.count_distinct("source").alias("sources"),
    )


def first_by_key(rows: DataFrame, key: Column, order: list[Column | str], within: list[str] = ()) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*within, key).orderBy(*order))
    return rows.withColumn("r", rank).filter("r = 1").drop("r")


def quote_key(source: str = "source", quote: str = "quote", size: int = 64) -> Column:
    return F.concat_ws("::", F.col(source), F.substring(quote, 1, size))


def clean_quotes(entities: DataFrame) -> DataFrame:
    """Entities (id, quotes) whose quotes are stripped, without empty and repeated ones, in order."""
    kept = F.filter(F.transform("quotes", lambda q: tx.strip(q)), lambda q: q != "")
    return entities.select("id", F.array_distinct(kept).alias("quotes"))


def latest(rows: DataFrame, key: str, at: list[Column | str]) -> DataFrame:
    """The last version of each key: an upsert of rows in their order."""
    return first_by_key(rows, F.col(key), at)


def patch_chunks(chunks: DataFrame, patches: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, entities) after patches of the same columns: entities are united, other fields replaced where given."""
    p = patches.select("chunk_id", F.col("text").alias("p_text"), F.col("entities").alias("p_entities"))
    both = F.array_sort(F.array_union(F.coalesce("entities", F.array().cast("array<string>")), F.coalesce("p_entities", F.array().cast("array<string>"))))
    return chunks.join(p, "chunk_id", "left").select("chunk_id", F.coalesce("p_text", "text").alias("text"), both.alias("entities"))


def cascade(candidates: DataFrame, merge: float = 0.92, judge: float = 0.70, verdict: Column | None = None) -> DataFrame:
    """id, match, score, decision: the best candidate (id, match, score) of each, merged from ``merge`` on, judged from ``judge`` on, else new."""
    best = candidates.groupBy("id").agg(F.max(F.struct("score", (-F.col("match")).alias("m"))).alias("b")).select("id", (-F.col("b.m")).alias("match"), "b.score")
    judged = F.coalesce(verdict if verdict is not None else F.lit(None).cast("string"), F.lit("judge"))
    return best.withColumn("decision", F.when(F.col("score") >= merge, "merge").when(F.col("score") >= judge, judged).otherwise("new"))
