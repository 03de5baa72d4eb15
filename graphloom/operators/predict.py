"""Precedents: similar cases, favourability and what it predicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import settled

#: Queries of a stated set that are sent to all tasks at once.
SENT_QUERIES = 1000


def cases_listing_type(cases: DataFrame, claim_type: str, seen: DataFrame) -> DataFrame:
    """Cases whose list of claim types (comma-separated) has the type, without those seen (id)."""
    listed = F.transform(F.split("claim_types", ","), lambda x: F.trim(x))
    return cases.filter(F.array_contains(listed, claim_type)).join(seen.select("id"), "id", "left_anti")


def evidence_score(outcome: Column) -> Column:
    """A stand-in for the completeness of a case's evidence: by its outcome."""
    return F.when(outcome == "plaintiff_win", 0.8).when(outcome == "defendant_win", 0.3).when(outcome == "settlement", 0.6).otherwise(0.5)


def similarity(text: Column, issue: Column, own: Column, completeness: Column, outcome: Column, jurisdiction: Column, wanted: Column) -> Column:
    """0.4 for the issue in the text, 0.3 for evidence within 0.2, 0.2 or 0.1 for the outcome, 0.1 for the jurisdiction; doubles, added in this order."""
    point = lambda v: F.lit(v).cast("double")
    zero = point(0.0)
    score = F.when(F.contains(F.lower(text), F.lower(issue)), point(0.4)).otherwise(zero)
    score = score + F.when(F.abs(own - completeness) <= 0.2, point(0.3)).otherwise(zero)
    score = score + F.when(outcome.isin("plaintiff_win", "defendant_win"), point(0.2)).when(outcome == "settlement", point(0.1)).otherwise(zero)
    return score + F.when(F.contains(F.lower(jurisdiction), F.lower(wanted)), point(0.1)).otherwise(zero)


def similar_cases(cases: DataFrame, issues: DataFrame, top: int = 25, least: float = 0.3) -> DataFrame:
    """query_id, case_id, outcome, score: for every query of a stated set (query_id, issue, completeness, wanted) the cases above ``least``, best first.

    Cases: id, name, description, outcome, jurisdiction. The queries meet all cases: up to ``SENT_QUERIES`` of them
    where the cases are read, more in blocks of as many, for which the cases are dealt out once each.
    """
    issues, known = settled(issues, "issues"), cases.filter(F.col("outcome").isNotNull())
    blocks = -(-issues.count() // SENT_QUERIES)
    if blocks <= 1:
        met = known.crossJoin(F.broadcast(issues))
    else:
        asked = issues.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        met = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asked, "block").drop("block")
    text = F.concat_ws(" ", "name", "description")
    score = similarity(text, F.col("issue"), evidence_score(F.col("outcome")), F.col("completeness"), F.col("outcome"), F.coalesce("jurisdiction", F.lit("")), F.col("wanted"))
    kept = met.withColumn("score", score).filter(F.col("score") > F.lit(least).cast("double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("id").alias("case_id"), "outcome", "score", "rank")


def favourable(outcome: Column, disposition: Column | None = None, kind: Column | None = None, damages: Column | None = None, relief: Column | None = None) -> Column:
    """Whether a case went the claimant's way, by the first sign that says so."""
    none, nothing = F.lit(""), F.lit(None).cast("double")
    disposition, kind = F.lower(F.coalesce(disposition if disposition is not None else none, none)), F.lower(F.coalesce(kind if kind is not None else none, none))
    out = F.when(disposition.isin("granted", "favorable", "won", "successful", "awarded"), True)
    out = out.when(kind.isin("judgment", "order") & ~disposition.isin("dismissed", "denied"), True)
    out = out.when(F.lower(F.coalesce(outcome, none)).isin("plaintiff_win", "tenant_win", "favorable"), True)
    out = out.when(F.coalesce(damages if damages is not None else nothing, F.lit(0.0)) > 0, True)
    return (out if relief is None else out.when(F.size(relief) > 0, True)).otherwise(False)


def prediction(n: Column, rate: Column, strength: Column) -> tuple[Column, Column]:
    """(outcome, probability): from the share of favourable cases, moved by the strength of the evidence; too few cases abstain."""
    moved = F.when(strength == "strong", F.least(F.lit(0.95), rate + 0.15)).when(strength == "weak", F.greatest(F.lit(0.05), rate - 0.15)).otherwise(rate)
    p = F.when(n < 2, F.lit(0.5)).otherwise(moved)
    return F.when(n < 2, "insufficient_data").when(p >= 0.55, "favorable").when(p >= 0.45, "mixed").otherwise("unfavorable"), p


def win_rate(outcomes: DataFrame, *by: str) -> DataFrame:
    """Counts of outcomes and wins / (wins + losses); settlements stay out."""
    wins, losses = F.count_if(F.col("outcome") == "plaintiff_win"), F.count_if(F.col("outcome") == "defendant_win")
    return outcomes.groupBy(*by).agg(wins.alias("wins"), losses.alias("losses"), F.count_if(F.col("outcome") == "settlement").alias("settlements"), F.when(wins + losses > 0, wins / (wins + losses)).alias("win_rate"))


def remedy_score(evidence: Column, authority: Column, same_place: Column, position: Column) -> Column:
    """0.4 evidence + 0.3 authority / 6 + 0.2 (0.06 elsewhere) + 0.1 by place among the top ten chunks (half without one), within [0.1, 0.95]."""
    retrieval = F.when(position.between(1, 10), 1.0 - (position - 1) / 10.0).otherwise(0.5)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.1), 0.4 * evidence + 0.3 * authority / 6.0 + 0.2 * F.when(same_place, 1.0).otherwise(0.3) + 0.1 * retrieval))


def strength_name(x: Column) -> Column:
    return F.when(x >= 0.7, "strong").when(x >= 0.4, "moderate").otherwise("weak")


def precedent_strength(strengths: DataFrame, places: DataFrame, rates: DataFrame) -> DataFrame:
    """claim, strength, label, adjusted: strengths (claim, strength) named, and weighed by the win rate of the claim's place (claim, jurisdiction) where there is one (jurisdiction, win_rate)."""
    held = strengths.join(places, "claim", "left").join(rates.select("jurisdiction", "win_rate"), "jurisdiction", "left")
    return held.select("claim", "strength", strength_name(F.col("strength")).alias("label"), (F.col("strength") * F.coalesce("win_rate", F.lit(1.0))).alias("adjusted"))


def summaries(strengths: DataFrame, by: str) -> DataFrame:
    """by, n, strongest, strength, label: how many claims (claim, strength) there are, the strongest of them, and how strong it is."""
    best = F.min(F.struct((-F.col("strength")).alias("less"), "claim"))
    held = strengths.groupBy(by).agg(F.count(F.lit(1)).alias("n"), best.alias("b"))
    return held.select(by, "n", F.col("b.claim").alias("strongest"), (-F.col("b.less")).alias("strength"), strength_name(-F.col("b.less")).alias("label"))
