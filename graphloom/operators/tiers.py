"""Priority cascades: answers of a better source first, the next source only for the questions that are still short.

Every tier is planned and run for the questions that earlier tiers left short of
the limit; where none is left, later tiers are neither planned nor read. The
tier of each answer is part of the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.storage import settled

from .candidates import Lexicon
from .graph import first_per

#: A tier: its name and what finds (query_id, id, place) for the questions that are left (with missing: how many each still wants).
Tier = tuple[str, Callable[[DataFrame], DataFrame]]


def filled(asked: DataFrame, tiers: list[Tier], limit: int, if_none: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, tier, place: up to ``limit`` answers for each question (query_id and what the tiers need), in order of the tiers and of the places within them.

    An answer is given once, by its first tier. Tiers in ``if_none`` are for questions without any answer so far.
    """
    left, out = asked.withColumn("missing", F.lit(limit)), None
    for name, find in tiers:
        open_ = left.filter(F.col("missing") == limit) if name in if_none else left
        if open_.isEmpty():
            continue
        found = find(open_).select("query_id", "id", "place")
        if out is not None:
            found = found.join(out.select("query_id", "id"), ["query_id", "id"], "left_anti")
        once = first_per(found, ["query_id", "id"], ["place"]).drop("rank")
        ranked = first_per(once, ["query_id"], ["place", "id"], limit).join(open_.select("query_id", "missing"), "query_id").filter(F.col("rank") <= F.col("missing"))
        answers = settled(ranked.select("query_id", "id", F.lit(name).alias("tier"), F.col("rank").alias("place")), f"tier-{name}")
        out = answers if out is None else out.unionByName(answers)
        counts = answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("given"))
        short = left.join(counts, "query_id", "left").withColumn("missing", F.col("missing") - F.coalesce("given", F.lit(0))).drop("given")
        left = settled(short.filter(F.col("missing") > 0), "short-questions")
    return out if out is not None else asked.select("query_id", F.lit(None).cast("string").alias("id"), F.lit("").alias("tier"), F.lit(0).alias("place")).limit(0)


def chains_for(asked: DataFrame, claims: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, id, tier, place: claims whose proof chains answer a question (query_id, claim_type, text): those of its type, then by its words, then any where there is none yet.

    Claims: id, claim_type, name. The lexical tier looks at twice the limit of claims.
    """
    def by_type(open_: DataFrame) -> DataFrame:
        first = first_per(claims.filter("claim_type is not null"), ["claim_type"], ["id"], limit)
        return open_.join(first.select("claim_type", "id", F.col("rank").alias("place")), "claim_type")

    def by_words(open_: DataFrame) -> DataFrame:
        held = claims.select("id", F.lit("claim").alias("type"), F.coalesce("name", F.lit("")).alias("name"))
        said = open_.filter("text is not null").select(F.concat(F.lit("query "), "query_id").alias("id"), F.lit("claim").alias("type"), "text")
        found = Lexicon(held, ["name"], 2 * limit, said).candidates(said)
        return found.select(F.substring_index("id", "query ", -1).alias("query_id"), F.col("match").alias("id"), F.col("rank").alias("place"))

    def any_(open_: DataFrame) -> DataFrame:
        return open_.select("query_id").crossJoin(F.broadcast(claims.select("id").orderBy("id").limit(limit).withColumn("place", F.lit(1))))  # limit rows

    return filled(asked.select(F.col("query_id").cast("string").alias("query_id"), "claim_type", "text"), [("type", by_type), ("words", by_words), ("any", any_)], limit, ("any",))


def similar_for(asked: DataFrame, claims: DataFrame, pairs: DataFrame, cases: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, id, tier, place, case_id, outcome, score: similar cases for a question (query_id, claim_type, matched, total).

    First claims of the type with their first case, then cases with an outcome that list the type. Score: matched of the total evidence, a half without any.
    Claims: id, claim_type; pairs: claim, case, outcome (the claim's first ones); cases: id, claim_types (array), outcome.
    """
    def by_claims(open_: DataFrame) -> DataFrame:
        held = claims.join(pairs.select(F.col("claim").alias("id")), "id", "left_semi")
        first = first_per(held, ["claim_type"], ["id"], limit)
        return open_.join(first.select("claim_type", "id", F.col("rank").alias("place")), "claim_type")

    def by_lists(open_: DataFrame) -> DataFrame:
        listed = cases.filter("outcome is not null").select("id", F.explode(F.array_distinct("claim_types")).alias("claim_type"))
        first = first_per(listed.join(open_.select("claim_type").distinct(), "claim_type", "left_semi"), ["claim_type"], ["id"], limit)
        return open_.join(first.select("claim_type", "id", F.col("rank").alias("place")), "claim_type")

    found = filled(asked, [("claims", by_claims), ("listed", by_lists)], limit)
    own = pairs.select(F.col("claim").alias("id"), F.col("case").alias("case_of"), F.col("outcome").alias("of_claim"))
    met = found.join(own, "id", "left").withColumn("case_id", F.coalesce("case_of", "id"))
    told = cases.select(F.col("id").alias("case_id"), F.col("outcome").alias("of_case"))
    score = F.when(F.coalesce("total", F.lit(0)) > 0, F.col("matched") / F.col("total")).otherwise(0.5)
    return met.join(told, "case_id", "left").join(asked.select("query_id", score.alias("score")), "query_id").select("query_id", "id", "tier", "place", "case_id", F.coalesce("of_case", "of_claim").alias("outcome"), "score")


def documents_of(similar: DataFrame, documents: DataFrame, top: int = 3) -> DataFrame:
    """query_id, rank and the columns of documents (case_id, ...): the documents of the ``top`` most similar cases of each question."""
    best = first_per(similar, ["query_id"], [F.desc("score"), "place", "case_id"], top).select("query_id", "rank", "case_id")
    return best.join(documents, "case_id").select("query_id", "rank", *documents.columns)
