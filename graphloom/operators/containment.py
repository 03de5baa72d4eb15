"""Texts within texts: all pairs of which one contains the other, without a nested loop.

A text that contains another has all runs of ``SIZE`` characters of it. So every
sought text is known by the rarest such run that it has, and meets the texts that
have this run; only these are compared. A shorter text is its own run. Equal
texts are one, on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.storage import settled

SIZE = 3


def _runs(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters; none of a shorter text."""
    count = F.length(text) - size + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substr(text, i, size)))).otherwise(F.array().cast("array<string>"))


def contained(sought: DataFrame, texts: DataFrame) -> DataFrame:
    """part, whole: the distinct texts of ``sought`` (text) and those of ``texts`` (text) that contain them, whatever their case; empty and null texts are contained in none."""
    low = lambda df, name: df.select(F.lower("text").alias(name)).filter(F.col(name) != "").distinct()
    parts, wholes = settled(low(sought, "part"), "parts"), settled(low(texts, "whole"), "wholes")
    sizes = [r.s for r in parts.select(F.least(F.length("part"), F.lit(SIZE)).alias("s")).distinct().collect()]  # SIZE at most
    if not sizes:
        return parts.select("part", F.col("part").alias("whole")).limit(0)
    every = F.array_distinct(F.concat(*(_runs(F.col("whole"), F.lit(s)) for s in sizes)))
    runs = parts.select("part", F.explode(_runs(F.col("part"), F.least(F.length("part"), F.lit(SIZE)))).alias("run"))
    wanted = runs.select("run").distinct()
    held = settled(wholes.select("whole", F.explode(every).alias("run")).join(wanted, "run", "left_semi"), "runs-of-wholes")
    counts = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # A part with a run that no text has is in none, and has none that is rarer.
    rarest = runs.join(counts, "run", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r"))
    met = rarest.select("part", F.col("r.run").alias("run")).join(held, "run")
    return met.filter(F.contains("whole", "part")).select("part", "whole")


def related(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: distinct texts of which either contains the other (columns text), in lower case."""
    one = contained(a, b).select(F.col("part").alias("a"), F.col("whole").alias("b"))
    return one.unionByName(contained(b, a).select(F.col("whole").alias("a"), F.col("part").alias("b"))).distinct()


def title(text: Column | str) -> Column:
    """Every run of letters begins with a capital, the rest is small."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), F.initcap), "")


def elements(chains: DataFrame, present: DataFrame) -> DataFrame:
    """key, element, satisfied, evidence: the evidence that the chains of a case name (key, name), and the texts present in the case (key, text) that contain it."""
    named = chains.select("key", "name", F.lower("name").alias("part")).filter("part <> ''").distinct()
    shown = present.select("key", "text", F.lower("text").alias("whole")).filter("whole <> ''").distinct()
    pairs = contained(named.select(F.col("part").alias("text")), shown.select(F.col("whole").alias("text")))
    # A case's own texts bring the parts that they contain; by part alone every case would meet every text with it.
    found = shown.join(pairs, "whole").join(named, ["key", "part"]).groupBy("key", "name").agg(F.array_sort(F.collect_set("text")).alias("evidence"))
    held = named.select("key", "name").join(found, ["key", "name"], "left")
    return held.select("key", F.col("name").alias("element"), F.col("evidence").isNotNull().alias("satisfied"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def legal_elements(required: DataFrame, presented: DataFrame, graph: DataFrame) -> DataFrame:
    """key, element, status, is_critical, verified_in_graph, from_graph_only: what a case has to show.

    Required evidence (key, evidence_id, text, is_critical) is satisfied or missing by the presented ids (key, evidence_id), and
    verified where a text of the case's graph chains (key, name) contains it or is contained in it; null where the case has no chains. Texts of the chains that
    relate to no required one are elements of their own, of unknown status.
    """
    named = graph.select("key", F.lower("name").alias("b")).filter("b <> ''").distinct()
    wanted = required.select("key", "evidence_id", F.col("text").alias("element"), "is_critical", F.lower("text").alias("a"))
    pairs = settled(related(wanted.select(F.col("a").alias("text")), named.select(F.col("b").alias("text"))), "related-texts")
    met = settled(wanted.select("key", "a").distinct().join(pairs, "a").join(named, ["key", "b"]), "related-elements")
    has = presented.select("key", "evidence_id").distinct().withColumn("has", F.lit(True))
    chains = named.select("key").distinct().withColumn("chained", F.lit(True))
    verified = met.select("key", "a").distinct().withColumn("verified", F.lit(True))
    own = wanted.join(has, ["key", "evidence_id"], "left").join(chains, "key", "left").join(verified, ["key", "a"], "left").select(
        "key", "element", F.when(F.col("has"), "satisfied").otherwise("missing").alias("status"), "is_critical",
        F.when(F.col("chained"), F.coalesce("verified", F.lit(False))).alias("verified_in_graph"), F.lit(False).alias("from_graph_only"),
    )
    alone = named.join(met.select("key", "b").distinct(), ["key", "b"], "left_anti")
    more = alone.select("key", title("b").alias("element"), F.lit("unknown").alias("status"), F.lit(False).alias("is_critical"), F.lit(True).alias("verified_in_graph"), F.lit(True).alias("from_graph_only"))
    return own.unionByName(more)
