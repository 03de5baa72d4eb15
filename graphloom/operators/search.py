"""Lexical search over postings: BM25, all tokens, phrases, substrings.

BM25 in the form of Robertson and Spärck Jones with k1 = 1.2 and b = 0.75. The
postings are a table (term, id, field, tf) with the lengths and frequencies of
terms beside it; a batch of queries meets them by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.storage import settled

from .graph import first_per

K1, B = 1.2, 0.75
#: Distinct terms of a batch of queries up to which they are sent to all tasks; beyond it they are joined by shuffle.
SENT_TERMS = 100_000
NO_TERM = ""


def postings(docs: DataFrame, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """id, field, term, tf, length (tokens of the field); of the given terms (term) only, if there are any."""
    each = docs.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tx.tokens(f).alias("tokens")) for f in fields))).alias("f")).select("id", "f.field", "f.tokens")
    # Every field has the empty term once, which no text has, for the statistics of its length.
    each = each.select("id", "field", F.size("tokens").alias("length"), F.explode(F.concat(F.array(F.lit(NO_TERM)), "tokens")).alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy("id", "field", "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def field_stats(held: DataFrame) -> DataFrame:
    """field, n (documents), avg_length, from postings."""
    return held.filter(F.col("term") == NO_TERM).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"))


def idf(df: Column, n: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def tf_part(tf: Column, length: Column, avg_length: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


def bm25(tf: Column, length: Column, avg_length: Column, df: Column, n: Column) -> Column:
    return idf(df, n) * tf_part(tf, length, avg_length)


def search(queries: DataFrame, docs: DataFrame, fields: list[str], top: int = 10, all_terms: bool = False) -> DataFrame:
    """query_id, id, score, rank: the best documents of each query (query_id, text) by BM25 summed over its distinct terms and the fields.

    With ``all_terms`` every term has to occur. Filters of documents belong before the call: statistics are those of the table given.
    """
    terms = settled(query_terms(queries), "query-terms")
    asked = terms.select("term").unionByName(queries.sparkSession.range(1).select(F.lit(NO_TERM).alias("term"))).distinct()
    few = asked.count() <= SENT_TERMS
    held = settled(postings(docs, fields, F.broadcast(asked) if few else asked), "postings")  # counted and scored, tokenised once
    df = held.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(field_stats(held))  # one row for each field
    held = held.filter(F.col("term") != NO_TERM).join(F.broadcast(df) if few else df, ["field", "term"]).join(stats, "field")
    scored = held.select("term", "id", bm25(F.col("tf"), F.col("length"), F.col("avg_length"), F.col("df"), F.col("n")).alias("s"))
    return best(terms, scored, top, all_terms, len(fields) == 1)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, wanted, term: the distinct terms of each query (query_id, text) and how many it has."""
    return queries.select("query_id", tx.tokens("text", distinct=True).alias("terms")).select("query_id", F.size("terms").alias("wanted"), F.explode("terms").alias("term"))


def best(terms: DataFrame, scored: DataFrame, top: int, all_terms: bool = False, once: bool = False) -> DataFrame:
    """query_id, id, score, rank: the best documents of each query (``query_terms``, settled) by weights (term, id, s), which are added up. ``once``: a term has one weight of a document at most.

    Weights are dealt out by document and the queries' terms sent to them, so the sums of a document are
    made where it lies and only the best of every part are shuffled: a frequent term brings its weights once, not once for each query with it.
    """
    if terms.count() <= SENT_TERMS:
        parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        scored, terms = scored.repartition(parts, "id"), F.broadcast(terms)
    if not once:
        scored = scored.groupBy("id", "term").agg(F.sum("s").alias("s"))
    found = scored.join(terms, "term").groupBy("query_id", "id", "wanted").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("hit"))
    if all_terms:
        found = found.filter("hit = wanted")
    return first_per(found, ["query_id"], [F.desc(F.round("score", 9)), "id"], top).select("query_id", "id", "score", "rank")


def phrase(docs: DataFrame, field: str, text: str, top: int = 50) -> DataFrame:
    """Distinct values of the field that hold the tokens of the phrase in a row."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tx.tokens(c), " "), F.lit(" "))
    return docs.filter(F.contains(padded(F.col(field)), padded(F.lit(text)))).select(F.col(field).alias("name")).distinct().orderBy("name").limit(top)


def like(docs: DataFrame, fields: list[str], text: str, top: int = 50) -> DataFrame:
    """Documents one of whose fields contains the text, whatever the case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
    return docs.filter(hit).orderBy("id").limit(top)


def snippets(chunks: DataFrame, word: str, size: int = 600, top: int = 20) -> DataFrame:
    """chunk_id and the beginning of chunks that contain the word."""
    return chunks.filter(F.lower("text").contains(word.lower())).select("chunk_id", F.substring("text", 1, size).alias("snippet")).orderBy("chunk_id").limit(top)


def quotes(rows: DataFrame, chunks: DataFrame, word: str, top: int = 10, size: int = 600) -> DataFrame:
    """id, quote, snippet: the first quotes (id, chunk_id, text) that contain the word, whatever its case, with the beginning of their chunks (chunk_id, text)."""
    found = rows.filter(F.lower("text").contains(word.lower())).orderBy("id").limit(top).select("id", "chunk_id", F.col("text").alias("quote"))
    return found.join(chunks.select("chunk_id", F.substring("text", 1, size).alias("snippet")), "chunk_id", "left").select("id", "quote", "snippet")


def texts_naming(names: DataFrame, texts: DataFrame, per_name: int = 5) -> DataFrame:
    """name, id: texts that contain a name as a run of whole words, up to ``per_name`` of each.

    Names of n words meet the n-word runs of the texts by equality, so this is no theta join.
    """
    keyed = names.select("name", F.array_join(tx.words("name"), " ").alias("run"), F.size(tx.words("name")).alias("n")).filter("n > 0")
    sizes = [r.n for r in keyed.select("n").distinct().collect()]  # the few lengths that names have
    held = texts.select("id", tx.words("text").alias("w"))
    runs = None
    for n in sorted(sizes):
        count = F.greatest(F.size("w") - (n - 1), F.lit(0))
        own = held.filter(count > 0).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), count), _run(n)))).alias("run"))
        runs = own if runs is None else runs.unionByName(own)
    met = keyed.join(runs if runs is not None else texts.select("id", F.lit("").alias("run")).limit(0), "run").select("name", "id").distinct()
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= per_name).drop("rank")


def texts_with_passages(passages: DataFrame, docs: DataFrame, n: int = 8) -> DataFrame:
    """query_id, id: texts that hold a passage (query_id, text) whole. They meet by the passage's first ``n`` words, or all of a shorter one, and are then compared."""
    keyed = passages.select("query_id", F.col("text").alias("passage"), F.slice(tx.words("text"), 1, n).alias("w")).filter(F.size("w") > 0).select("query_id", "passage", F.size("w").alias("size"), F.array_join("w", " ").alias("run"))
    held, met = docs.select("id", tx.words("text").alias("w")), None
    for size in sorted(r["size"] for r in keyed.select("size").distinct().collect()):  # n at most
        count = F.greatest(F.size("w") - (size - 1), F.lit(0))
        runs = held.filter(count > 0).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), count), _run(size)))).alias("run"))
        own = runs.join(keyed.filter(F.col("size") == size), "run").select("id", "query_id", "passage").distinct()
        met = own if met is None else met.unionByName(own)
    if met is None:
        return passages.select("query_id").crossJoin(docs.select("id").limit(0))
    return met.join(docs.select("id", F.col("text").alias("whole")), "id").filter(F.contains("whole", "passage")).select("query_id", "id").distinct()


def _run(n: int):
    return lambda i: F.array_join(F.slice(F.col("w"), i, n), " ")


def page(docs: DataFrame, offset: int, limit: int, order: str = "id") -> DataFrame:
    """Rows of a page in order, with total and next_cursor (null on the last page)."""
    total = docs.count()
    rows = docs.orderBy(order).offset(offset).limit(limit)
    return rows.withColumn("total", F.lit(total).cast("long")).withColumn("next_cursor", F.lit(offset + limit if total >= offset + limit else None).cast("long"))
