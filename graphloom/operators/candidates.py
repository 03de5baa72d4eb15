"""Candidates of a resolution: for every row the k stored rows of its type that BM25 ranks first, then a closer look at those alone.

All rows are asked at once, so what they share is done once. Stored rows with
the same words are one class, and so are rows that ask with the same words (a
cache by name and type). Of a question's words, rare ones come first:

- where all words must occur, the postings of the rarest hold every answer;
- where any will do, the k best of a question lie among the postings of its
  rarest word and the k best of the question without that word: whoever is in
  neither has k classes before it that lose nothing by the word. So questions are answered from their
  most frequent word up, a word at a time; for that one alone the first k of its postings
  by weight are enough, so a word that all rows have brings k of them and not all.

Words are taken off up to ``LEVELS`` of a question; one with more of them meets the postings of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.storage import settled

from . import graph, rules, vectors
from .dedup import cascade
from .search import SENT_TERMS, bm25

#: Words of a question that are taken off one at a time.
LEVELS = 8
#: Questions' answers (k each) that are sent to all tasks; beyond it they are joined by shuffle.
SENT_ANSWERS = 50_000


def _classes(docs: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """(members: id, cls; classes: cls, type, n and the sorted words of each field). A class is named by its least id."""
    words = lambda f: F.array_join(F.array_sort(tx.tokens(f)), " ").alias(f)
    held = docs.select("id", "type", *map(words, fields))
    classes = held.groupBy("type", *fields).agg(F.min("id").alias("cls"), F.count(F.lit(1)).alias("n"))
    return held, classes


class Lexicon:
    """Stored rows (id, type and text fields) as classes with their words' weights."""

    def __init__(self, docs: DataFrame, fields: list[str], k: int, asked: DataFrame | None = None) -> None:
        """``asked`` (text): what will be asked. Rows with none of its words count in the statistics alone, and other words of rows are left out."""
        words = lambda f: F.filter(F.split(f, " "), lambda w: w != "")
        said = lambda df, *more: df.select(*more, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), words(f).alias("words")) for f in fields))).alias("f")).select(*more, "f.field", "f.words")
        held, classes = _classes(docs, fields)
        stats = said(held).groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.avg(F.size("words")).alias("avg_length"))
        wanted = None
        if asked is not None:
            wanted = settled(asked.select(F.explode(tx.tokens("text", distinct=True)).alias("term")).distinct(), "lexicon-wanted")
            wanted = F.broadcast(wanted) if wanted.count() <= SENT_TERMS else wanted
            every = F.array_distinct(F.concat(*map(words, fields)))
            matched = settled(held.withColumn("term", F.explode(every)).join(wanted, "term", "left_semi"), "lexicon-matched")
            held = matched.drop("term").distinct()
            # The rows of a class have the same words, so each is met equally often.
            classes = matched.groupBy("type", *fields).agg(F.min("id").alias("cls"), (F.count(F.lit(1)) / F.count_distinct("term")).cast("long").alias("n"))
        classes = settled(classes, "lexicon-classes")
        each = said(classes, "cls", "type", "n")
        terms = each.select("cls", "type", "n", "field", F.size("words").alias("length"), F.explode("words").alias("term"))
        if wanted is not None:
            terms = terms.join(wanted, "term", "left_semi")
        terms = settled(terms.groupBy("cls", "type", "n", "field", "length", "term").agg(F.count(F.lit(1)).alias("tf")), "lexicon-terms")
        df = terms.groupBy("field", "term").agg(F.sum("n").alias("df"))
        weight = bm25(F.col("tf"), F.col("length"), F.col("avg_length"), F.col("df"), F.col("total"))
        weighed = terms.join(df, ["field", "term"]).join(F.broadcast(stats), "field")  # one row for each field
        #: type, term, cls, weight.
        self.postings = settled(weighed.groupBy("type", "term", "cls").agg(F.sum(weight).alias("weight")), "lexicon-postings")
        #: cls with its words and weights.
        self.words = settled(self.postings.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("words")), "lexicon-words")
        #: type, term and how many classes have it.
        self.counts = settled(self.postings.groupBy("type", "term").agg(F.count(F.lit(1)).alias("held")), "lexicon-counts")
        #: Of each class the first members.
        self.firsts = settled(graph.first_per(held.join(classes.drop("n"), ["type", *fields]).select("id", "cls"), ["cls"], ["id"], k + 1).drop("rank"), "lexicon-firsts")
        self.k = k

    def _scored(self, met: DataFrame, all_words: bool) -> DataFrame:
        """The k + 1 best classes of each question: type, ask, cls, score."""
        held = met.join(self.words, "cls")
        if all_words:
            has = F.transform("words", lambda x: x["term"])
            held = held.filter(F.forall("ask", lambda w: F.array_contains(has, w)))
        score = F.aggregate(F.filter("words", lambda x: F.array_contains("ask", x["term"])), F.lit(0.0), lambda a, x: a + x["weight"])
        best = graph.first_per(held.select("type", "ask", "cls", F.round(score, 9).alias("score")), ["type", "ask"], [F.desc("score"), "cls"], self.k + 1)
        return settled(best.drop("rank"), "lexicon-best")

    def _meet(self, asks: DataFrame, words: Column) -> DataFrame:
        return asks.withColumn("term", words).join(self.postings.drop("weight"), ["type", "term"]).drop("term")

    def _any(self, asks: DataFrame) -> DataFrame:
        """The best classes of questions (type, ask: words, rare ones first)."""
        short = asks.filter(F.size("ask") <= LEVELS)
        ends = short.select("type", F.explode(F.transform(F.sequence(F.lit(1), F.size("ask")), lambda i: F.slice("ask", i, F.size("ask")))).alias("ask")).distinct()
        ends = settled(ends, "lexicon-questions")
        most = ends.agg(F.max(F.size("ask"))).first()[0] or 0  # LEVELS at most
        heads = self.postings.join(ends.filter(F.size("ask") == 1).select("type", F.col("ask")[0].alias("term")), ["type", "term"], "left_semi")
        first = graph.first_per(heads.withColumn("score", F.round("weight", 9)), ["type", "term"], [F.desc("score"), "cls"], self.k + 1)
        best = settled(first.select("type", F.array("term").alias("ask"), "cls", "score"), "lexicon-best")
        every = best
        for size in range(2, most + 1):
            own = ends.filter(F.size("ask") == size)
            rest = own.withColumn("rest", F.slice("ask", 2, size)).join(best.select("type", F.col("ask").alias("rest"), "cls"), ["type", "rest"]).select("type", "ask", "cls")
            best = self._scored(self._meet(own, F.col("ask")[0]).unionByName(rest).distinct(), False)
            every = every.unionByName(best)
        long = asks.filter(F.size("ask") > LEVELS)
        if not long.isEmpty():
            every = every.unionByName(self._scored(self._meet(long, F.explode("ask")).distinct(), False))
        return every.join(asks, ["type", "ask"], "left_semi")

    def candidates(self, queries: DataFrame, all_words: bool = False) -> DataFrame:
        """id, match, score, rank: the k best stored rows for each query (id, type, text), itself left out."""
        asked = queries.select("id", "type", F.array_sort(tx.tokens("text", distinct=True)).alias("words"))
        sets = settled(asked.select("type", "words").distinct(), "lexicon-asked")
        known = sets.select("type", "words", F.explode("words").alias("term")).join(self.counts, ["type", "term"])
        ordered = known.groupBy("type", "words").agg(F.transform(F.array_sort(F.collect_list(F.struct("held", "term"))), lambda x: x["term"]).alias("ask"))
        if all_words:  # a word that no row has leaves no answer
            ordered = ordered.filter(F.size("ask") == F.size("words"))
        ordered = settled(ordered, "lexicon-ordered")
        asks = ordered.select("type", "ask")
        best = self._scored(self._meet(asks, F.col("ask")[0]), True) if all_words else self._any(asks)
        ids = graph.first_per(best.join(self.firsts, "cls").select("type", "ask", F.col("id").alias("match"), "score"), ["type", "ask"], [F.desc("score"), "match"], self.k + 1)
        answers = ordered.join(ids.drop("rank"), ["type", "ask"]).groupBy("type", "words").agg(F.collect_list(F.struct("match", "score")).alias("found"))
        answers = settled(answers, "lexicon-answers")
        # Millions of questions lie in a few MB of files: they are dealt out, and the answers come to them.
        met = _dealt(asked, "id").join(F.broadcast(answers) if answers.count() <= SENT_ANSWERS else answers.hint("merge"), ["type", "words"])
        found = met.select("id", F.explode("found").alias("f")).select("id", "f.match", "f.score").filter("id <> match")
        return graph.first_per(found, ["id"], [F.desc("score"), "match"], self.k)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """To as many tasks as Spark is told, by key."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _paired(near: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (id, match) with the columns of ``a`` (id) and ``b`` (match), joined by shuffle: rows of either are many in few bytes, and pairs more."""
    return _dealt(_dealt(near, "match").join(b.hint("merge"), "match"), "id").join(a.hint("merge"), "id")


def resolve(entities: DataFrame, stored: DataFrame, k: int = 5, merge: float = 0.92, judge: float = 0.70, verdict: Column | None = None) -> DataFrame:
    """id, match, score, decision: entities (id, type, name, embedding) against the stored ones that have all words of their name, the first ``k`` by BM25; the best of them by cosine decides.

    An entity without candidates is new, with neither match nor score.
    """
    lexicon = Lexicon(stored.select("id", "type", "name"), ["name"], k, entities.select(F.col("name").alias("text")))
    near = settled(lexicon.candidates(entities.select("id", "type", F.col("name").alias("text")), all_words=True).select("id", "match"), "candidates")
    a, b = entities.select("id", F.col("embedding").alias("x")), stored.select(F.col("id").alias("match"), F.col("embedding").alias("y"))
    scored = _paired(near, a, b).select("id", "match", F.round(vectors.cosine("x", "y"), 9).alias("score"))
    decided = cascade(scored, merge, judge, verdict)
    return entities.select("id").join(decided, "id", "left").withColumn("decision", F.coalesce("decision", F.lit("new")))


def resolve_once(entities: DataFrame, stored: DataFrame, **options) -> DataFrame:
    """id, match, score, decision as ``resolve`` gives them, with a cache by (name, type): the first entity of each is resolved, the others take what it got."""
    first = entities.groupBy("type", "name").agg(F.min("id").alias("id"))
    found = resolve(entities.join(first.select("id"), "id", "left_semi"), stored, **options)
    known = first.join(found, "id").drop("id")
    return entities.select("id", "type", "name").join(known, ["type", "name"]).select("id", "match", "score", "decision")


def links(entities: DataFrame, stored: DataFrame, k: int = 20, least: float = 0.85) -> DataFrame:
    """id, best, score: entities (id, type, name, description, jurisdiction) linked to the most similar of the ``k`` stored ones that BM25 ranks first for their name, from ``least`` on."""
    lexicon = Lexicon(stored.select("id", "type", "name", "description"), ["name", "description"], k, entities.select(F.col("name").alias("text")))
    near = settled(lexicon.candidates(entities.select("id", "type", F.col("name").alias("text"))).select("id", "match"), "candidates")
    row = F.struct("name", "description", "jurisdiction", "type")
    a, b = entities.select("id", row.alias("x")), stored.select(F.col("id").alias("match"), row.alias("y"))
    scored = _paired(near, a, b).withColumn("score", F.round(rules.entity_similarity("x", "y"), 6)).filter(F.col("score") >= least)
    return graph.first_per(scored, ["id"], [F.desc("score"), "match"]).select("id", F.col("match").alias("best"), "score")
