"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and telephone numbers;
these are the seeds. The words about a seed are its lexical patterns: the two
words before it, and the words on both sides, however far off and across a
neighbouring match, which stands as its kind. Patterns and instances form a
graph, scored in rounds: a pattern's confidence in a kind is the scored share
of the distinct instances it meets, an instance's score what the confident
patterns about it leave no doubt of; instances above a threshold are seeds of
the next round, where the contexts that they share become patterns. Instances are the seeds and other tokens that look like
identifiers: with four digits or more, an ``@``, or an "at" in brackets. Those
that reach the threshold add spans of the kind; base spans stay as they are.

The patterns are written so that matching takes linear time: a run is entered
at its start only, and gives nothing back. Runs of digits too short for a card
are passed over, since a run that fails is dropped as a whole.

Defined results: a null text is empty and has no span. Positions count code
points, ends are exclusive. Repeated rows give repeated results. An added span
that overlaps a base one is dropped, so an identifier never counts twice.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, settle
from .spans import BLANK, matches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, each with a condition that every text with a match meets and that is quick to refuse: it begins with a rare sign, so the engine passes over the rest. (?<!..)|\G: a match begins where a run begins, or where the last match ended.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
}
#: Tokens of six characters or more that hold four digits, an @ or a bracketed "at".
TOKEN = rf"(?<![^{BLANK}])(?=[^{BLANK}]*(?:@|[(\[]at[)\]]|[0-9](?:[^0-9{BLANK}]*+[0-9]){{3}}))[^{BLANK}]{{6,}}+"
TOKEN_SIGNS = rf"@|[(\[]at[)\]]|[0-9](?:[^0-9{BLANK}]*+[0-9]){{3}}"
OPENING, CLOSING = r"""\A["'(\[{<,;:=]+""", r"""["')\]}>,;:.!?]+\z"""

#: Rounds, distinct scored instances that a pattern needs, its least confidence, and the least score of a new instance.
ROUNDS, SUPPORT, CONFIDENCE, ACCEPT = 3, 3, 0.6, 0.75


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.ascii(F.substring(digits, i, F.lit(1))) - 48
    term = lambda i: F.when((n - i) % 2 == 1, F.when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + term(i)) % 10 == 0


def sound(kind: Column, match: Column) -> Column:
    """Whether a base match stands: parts of an address, count and check digit of a card, digits of a telephone number."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"\A{part}(?:\.{part}){{3}}\z"))
        .when(kind == "card", F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False))
        .when(kind == "phone", F.length(digits).between(9, 15))
        .otherwise(False)
    )


def _patterns() -> Column:
    """The lexical patterns of an occurrence, from the words before and after it."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"[{BLANK}]+", " ")))
    two, after = clean("before"), clean("after")
    last = F.substring_index(two, " ", -1)
    kept = F.filter(F.array(F.when(two != "", F.concat(F.lit("2 "), two)), F.when((last != "") & (after != ""), F.concat_ws(" _ ", F.lit("1"), last, after))), lambda x: x.isNotNull())
    return F.array_distinct(kept)


def bootstrap(seeds: DataFrame, candidates: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, accept: float = ACCEPT) -> DataFrame:
    """(instance, kind, score) of candidates that the contexts of the seeds vouch for.

    Both tables: instance, kind (null for candidates), patterns. Edges are
    distinct, so a common instance or pattern counts once for each partner.
    """
    known = seeds.select(F.explode("patterns").alias("pattern"), "instance", "kind").distinct()
    open_ = candidates.select(F.explode("patterns").alias("pattern"), "instance").distinct()
    every = known.unionByName(open_.withColumn("kind", F.lit(None).cast("string")))
    # No round can score more instances of a pattern than the seeds and candidates that it meets.
    useful = every.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).filter(F.col("n") >= support).select("pattern")
    edges = settle(every.join(useful, "pattern", "left_semi"), "pii-edges")
    scores = edges.filter("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    new = None
    for _ in range(rounds):
        held = scores if new is None else scores.unionByName(new)
        met = edges.select("pattern", "instance").distinct().join(held, "instance", "left")
        total = met.groupBy("pattern").agg(F.count_distinct("instance").alias("total"))
        own = met.filter("kind is not null").groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_distinct("instance").alias("n"))
        sure = own.filter(F.col("n") >= support).join(total, "pattern").select("pattern", "kind", F.least(F.lit(0.999), F.col("sum") / F.col("total")).alias("confidence")).filter(F.col("confidence") >= confidence)
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        found = edges.filter("kind is null").join(sure.select("pattern", F.col("kind").alias("as_kind"), "confidence"), "pattern").groupBy("instance", "as_kind").agg((1 - doubt).alias("score"))
        best = found.groupBy("instance").agg(F.max(F.struct("score", F.col("as_kind").alias("kind"))).alias("b")).select("instance", "b.kind", "b.score")
        new = settle(best.filter(F.col("score") >= accept), "pii-found")
    return new


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per span, base (added false) and discovered (added true): uid (of the row), doc_id, kind, start, end, match, score; and a row with a null kind for each document."""
    every = matches(docs, id_col, text_col, BASE | {"token": (TOKEN, lambda t: t.rlike(TOKEN_SIGNS))}, "pii")
    every = settle(every.filter(F.col("kind").isNull() | (F.col("kind") == "token") | sound(F.col("kind"), F.col("match"))), "pii-spans")
    base = every.filter("kind is null or kind <> 'token'")
    # A token overlaps a base span if one that began before ends after its start, or the next one begins before its end.
    line = Window.partitionBy("uid").orderBy("start", "end")
    is_base = F.col("kind") != "token"
    ended = F.max(F.when(is_base, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begins = F.min(F.when(is_base, F.col("start"))).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    lead = F.length(F.regexp_extract("match", OPENING, 0))
    core = F.regexp_replace(F.regexp_replace("match", OPENING, ""), CLOSING, "")
    tokens = every.filter("kind is not null").withColumn("ended", ended).withColumn("begins", begins).filter("kind = 'token' and (ended is null or ended <= start) and (begins is null or begins >= end)")
    tokens = tokens.select("uid", "doc_id", (F.col("start") + lead).alias("start"), core.alias("match"), "before", "after")
    tokens = tokens.filter(F.col("match").rlike(r"[0-9](?:[^0-9]*[0-9]){3}") | F.col("match").rlike(r"@|[(\[]at[)\]]")).withColumn("end", F.col("start") + F.length("match"))
    new = bootstrap(base.filter("kind is not null").select(F.lower("match").alias("instance"), "kind", _patterns().alias("patterns")), tokens.select(F.lower("match").alias("instance"), F.lit(None).cast("string").alias("kind"), _patterns().alias("patterns")), **options)
    added = tokens.join(new, F.lower("match") == F.col("instance")).select("uid", "doc_id", "kind", "start", "end", "match", F.lit(True).alias("added"), "score")
    return base.select("uid", "doc_id", "kind", "start", "end", "match", F.lit(False).alias("added"), F.lit(1.0).alias("score")).unionByName(added)


def digest(spans: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans, and the counts of added and of all spans."""
    place = F.expr("array_position(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), kind)")
    item = F.struct("start", place.alias("place"), "end", "kind")
    listed = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    own = F.col("kind").isNotNull() & ~F.col("added")
    counts = [F.count_if(own & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS]
    grouped = spans.groupBy("uid", "doc_id").agg(*counts, F.count_if("added").alias("n_added"), F.count("kind").alias("n_spans"), F.collect_list(F.when(own, item)).alias("base"), F.collect_list(F.when(F.col("kind").isNotNull(), item)).alias("every"))
    return grouped.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"), "n_added", "n_spans")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(documents(spark, sf_dir)))
