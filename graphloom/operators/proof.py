"""Proof chains: what a claim requires, what it has, what is missing and how complete it is, for all claims at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx
from graphloom.storage import settled

from .graph import first_per


#: Requirements up to which they are sent to all tasks; beyond it they are joined by shuffle.
SENT_REQUIRED = 100_000


def of_their_type(claims: DataFrame, required: DataFrame) -> DataFrame:
    """Claims with each requirement of their claim_type. Types are few and claims many, so claims stay where they are: by type a fifth of them would be one task."""
    held = settled(required, "required")
    return claims.join(F.broadcast(held) if held.count() <= SENT_REQUIRED else held, "claim_type")


def satisfied_by_name(claims: DataFrame, required: DataFrame, presented: DataFrame) -> DataFrame:
    """claim, evidence_id, is_critical, satisfied: the requirements of each claim's type, and whether the claim has that evidence.

    Tables: claims (claim, claim_type), required (claim_type, evidence_id, is_critical), presented (claim, evidence_id).
    """
    # A claim meets what it has once, and then its requirements where it is.
    have = presented.groupBy("claim").agg(F.collect_set("evidence_id").alias("held"))
    met = of_their_type(claims.select("claim", "claim_type").join(have, "claim", "left"), required.select("claim_type", "evidence_id", "is_critical"))
    return met.select("claim", "claim_type", "evidence_id", "is_critical", F.coalesce(F.array_contains("held", F.col("evidence_id")), F.lit(False)).alias("satisfied"))


def completeness(is_critical: Column, score: Column) -> Column:
    """Weighted share of scores, critical ones twice; an aggregate."""
    weight = F.when(is_critical, 2.0).otherwise(1.0)
    return F.sum(weight * score) / F.sum(weight)


def chains(matched: DataFrame) -> DataFrame:
    """claim, n_required, n_satisfied, n_missing, critical_gaps, completeness, strength."""
    done = F.col("satisfied").cast("int")
    out = matched.groupBy("claim", "claim_type").agg(
        F.count(F.lit(1)).alias("n_required"), F.sum(done).alias("n_satisfied"), F.count_if(~F.col("satisfied")).alias("n_missing"),
        F.count_if(~F.col("satisfied") & F.col("is_critical")).alias("critical_gaps"), completeness(F.col("is_critical"), done).alias("completeness"),
    )
    return out.withColumn("strength", strength(F.col("completeness")))


def strength(x: Column) -> Column:
    return F.when(x >= 0.8, "strong").when(x >= 0.5, "moderate").otherwise("weak")


def with_totals(chains_: DataFrame, claims: DataFrame, laws: DataFrame, remedies: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Chains of all claims, also those without requirements (completeness 0), with their first outcome and the numbers of laws and remedies of their type."""
    counted = laws.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n_laws")), remedies.groupBy("claim_type").agg(F.count(F.lit(1)).alias("n_remedies"))
    out = claims.join(chains_.drop("claim_type"), "claim", "left").join(counted[0], "claim_type", "left").join(counted[1], "claim_type", "left").join(outcomes.select("claim", "outcome"), "claim", "left")
    zero = {c: 0 for c in ("n_required", "n_satisfied", "n_missing", "critical_gaps", "n_laws", "n_remedies")}
    return out.fillna(zero | {"completeness": 0.0, "strength": "weak"})


def match_evidence(required: DataFrame, presented: DataFrame, satisfies: DataFrame, fallback: bool = True, least: float = 0.3) -> DataFrame:
    """claim, required_id, presented_id: stated matches (SATISFIES edges) first, then greedily the unused presented item with the largest Jaccard similarity of words above ``least``, requirement after requirement in order.

    Tables: required (claim, required_id, seq, text), presented (claim, presented_id, seq, text), satisfies (presented_id, required_id).
    The greedy pass is a fold over one claim's few candidate pairs.
    """
    stated = required.select("claim", "required_id").join(satisfies, "required_id").join(presented.select("claim", "presented_id", "seq"), ["claim", "presented_id"])
    stated = stated.groupBy("claim", "required_id").agg(F.min_by("presented_id", "seq").alias("presented_id"))
    if not fallback:
        return stated
    words = lambda df, key: df.select("claim", key, F.col("seq").alias(f"{key}_seq"), tx.words("text").alias(f"{key}_w"))
    open_required = words(required, "required_id").join(stated.select("claim", "required_id"), ["claim", "required_id"], "left_anti")
    free = words(presented, "presented_id").join(stated.select("claim", "presented_id"), ["claim", "presented_id"], "left_anti")
    scored = open_required.join(free, "claim").withColumn("score", tx.jaccard(F.array_distinct("required_id_w"), F.array_distinct("presented_id_w"))).filter(F.col("score") > least)

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        part = part.sort_values(["required_id_seq", "required_id", "score", "presented_id_seq", "presented_id"], ascending=[True, True, False, True, True])
        for (_, required_id), own in part.groupby(["required_id_seq", "required_id"], sort=True):
            best = next((p for p in own["presented_id"] if p not in used), None)
            if best is not None:
                used.add(best)
                rows.append((own["claim"].iloc[0], required_id, best))
        return pd.DataFrame(rows, columns=["claim", "required_id", "presented_id"])

    kinds = {c: dict(scored.dtypes)[c] for c in ("claim", "required_id", "presented_id")}
    greedy = scored.select("claim", "required_id", "required_id_seq", "presented_id", "presented_id_seq", "score").groupBy("claim").applyInPandas(pick, ", ".join(f"{k} {v}" for k, v in kinds.items()))
    return stated.select("claim", "required_id", "presented_id").unionByName(greedy)


def next_steps(chains_: DataFrame, gaps: DataFrame, top: int = 10) -> DataFrame:
    """claim, rank, priority, action: critical gaps first (three), then to file or gather by strength, the best remedy, aid, and documentation.

    Tables: chains (claim, completeness, strength, remedy), gaps (claim, evidence_id, is_critical).
    """
    from .graph import first_per

    critical = first_per(gaps.filter("is_critical"), ["claim"], ["evidence_id"], 3)
    row = lambda df, n, p, a: df.select("claim", F.lit(n).alias("rule"), F.coalesce(F.col("rank") if "rank" in df.columns else F.lit(0)).alias("k"), F.lit(p).alias("priority"), a.alias("action"))
    parts = [
        row(critical, 1, "critical", F.concat(F.lit("Obtain "), "evidence_id")),
        row(chains_.filter("completeness > 0.6"), 2, "high", F.lit("Rely on the chain")),
        row(chains_.filter("remedy is not null"), 3, "medium", F.concat(F.lit("Pursue "), "remedy")),
        row(chains_.filter("completeness > 0.5"), 4, "medium", F.lit("Contact legal aid")),
        row(chains_, 5, "low", F.lit("Document everything")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return first_per(out, ["claim"], ["rule", "k"], top).select("claim", "rank", "priority", "action")


#: Words of sentences that state a requirement.
REQUIREMENT_WORDS = ("require", "must", "evidence", "prove", "show")


def requirement_sentences(text: Column | str, top: int = 5, size: int = 200, least: int = 20) -> Column:
    """array<string>: the first sentences that state a requirement, in lower case."""
    ended = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(r"(?<![^.!?])[^.!?]++[.!?]"), F.lit(0))
    found = F.transform(F.filter(ended, lambda s: s.rlike("|".join(REQUIREMENT_WORDS))), lambda s: tx.strip(s))
    return F.transform(F.slice(F.filter(found, lambda s: F.length(s) > least), 1, top), lambda s: F.substring(s, 1, size))


def missing_items(present: Column, items: tuple[str, ...] = d.CRITICAL_ITEMS) -> Column:
    """The items that nothing present contains."""
    low = F.lower(F.coalesce(present, F.lit("")))
    return F.filter(F.array(*(F.when(~F.contains(low, F.lit(i.lower())), F.lit(i)) for i in items)), lambda x: x.isNotNull())


def verified(laws: DataFrame, remedies: DataFrame, entities: DataFrame, edges: DataFrame, kind: str = "AUTHORIZES") -> DataFrame:
    """key, laws_known, remedies_enabled: whether all of a row's laws exist, and every remedy is enabled by one of them. Tables: laws (key, law), remedies (key, remedy)."""
    known = entities.select(F.col("id").alias("law"), F.lit(True).alias("known"))
    by_law = laws.join(known, "law", "left").groupBy("key").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("laws_known"))
    # A row's remedies meet its own laws; by law alone all of a law's remedies would come to all of its rows.
    pairs = remedies.select("key", "remedy").distinct().join(laws.distinct(), "key")
    enabling = edges.filter(F.col("type") == kind).select(F.col("src").alias("law"), F.col("dst").alias("remedy"))
    enabled = pairs.join(enabling, ["law", "remedy"], "left_semi").select("key", "remedy").distinct().withColumn("e", F.lit(True))
    by_remedy = remedies.join(enabled, ["key", "remedy"], "left").groupBy("key").agg(F.bool_and(F.coalesce("e", F.lit(False))).alias("remedies_enabled"))
    return by_law.join(by_remedy, "key", "left").select("key", "laws_known", F.coalesce("remedies_enabled", F.lit(True)).alias("remedies_enabled"))


def rendered(nodes: Column) -> Column:
    """`type: name -> ...` of array<struct<type, name>>."""
    return F.array_join(F.transform(nodes, lambda n: F.concat_ws(": ", n["type"], n["name"])), " -> ")


def processed_matches(matches: DataFrame, known: DataFrame, required: DataFrame, cap: int = 3) -> DataFrame:
    """query_id, rank, claim_type, completeness, strength, evidence_ids: what a model matched, made to fit the graph.

    Tables: matches (query_id, raw, evidence array<struct<name, score>>), known (raw in upper case, claim_type: what the raw names
    are nearest to), required (claim_type, evidence_id, name, is_critical). A match of unknown type is dropped. A type without requirements has
    those that the match names, none critical. Assessed evidence has the id of the requirement of its name, else one made of its name.
    """
    made = lambda head, name: F.concat(head, F.replace(F.lower(name), F.lit(" "), F.lit("_")))
    held = matches.withColumn("raw", F.upper("raw")).join(known.select("raw", "claim_type"), "raw").groupBy("query_id", "claim_type").agg(F.first("evidence").alias("evidence"))
    said = held.select("query_id", "claim_type", F.explode("evidence").alias("e")).select("query_id", "claim_type", F.col("e.name").alias("name"), F.col("e.score").alias("score")).groupBy("query_id", "claim_type", "name").agg(F.max("score").alias("score"))
    asked = required.select("claim_type", "evidence_id", "name", "is_critical")
    stated = held.select("query_id", "claim_type").join(asked, "claim_type")
    bare = said.join(asked.select("claim_type").distinct(), "claim_type", "left_anti")
    own = bare.select("query_id", "claim_type", made(F.concat(F.lit("fallback_"), "claim_type", F.lit("_")), F.col("name")).alias("evidence_id"), "name", F.lit(False).alias("is_critical"))
    wanted = stated.select(*own.columns).unionByName(own)
    scored = wanted.join(said, ["query_id", "claim_type", "name"], "left").groupBy("query_id", "claim_type").agg(completeness(F.col("is_critical"), F.coalesce("score", F.lit(0.0))).alias("completeness"))
    ids = said.join(wanted.select("query_id", "claim_type", "name", "evidence_id"), ["query_id", "claim_type", "name"], "left").groupBy("query_id", "claim_type").agg(F.array_sort(F.collect_set(F.coalesce("evidence_id", made(F.lit("synthetic_"), F.col("name"))))).alias("evidence_ids"))
    met = scored.join(ids, ["query_id", "claim_type"], "left").withColumn("strength", strength(F.col("completeness")))
    return first_per(met, ["query_id"], [F.desc(F.round("completeness", 9)), "claim_type"], cap).select("query_id", "rank", "claim_type", "completeness", "strength", "evidence_ids")
