"""A stored index for BM25: postings with their weights, by bucket of the term, in blocks that fall in weight.

A search reads the buckets of its terms and no others. The first block of each
term gives a threshold for each query: the k-th best of what these blocks add
up to, which no true k-th score is below. A further block of a term is read only if
it can matter to a query: its largest weight and the largest weights of the query's other
terms reach the threshold together. A document of a block that is left out
is below the threshold, so it is not missed; those that count have all their blocks.
Blocks meet the queries document by document, as in ``search.best``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.storage import settled

from .search import NO_TERM, best, field_stats, idf, postings, query_terms, tf_part

#: Folders of terms, postings of a block, and distinct terms up to which the scan itself is told them.
BUCKETS, BLOCK, TOLD_TERMS = 64, 512, 1000
#: Postings of a term in one part, and those that a task writes.
LONG, TASK_ROWS = 32_768, 1_000_000


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    """Postings at a path: bucket (folder), term, block, first, most (the largest weight of the block), ids and weights."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(docs: DataFrame, fields: list[str], path: str) -> TextIndex:
        """Of documents (id and the fields). Weights of the fields are added up; the index holds for the table as it is."""
        # Documents are dealt out whole, so the terms of each are counted where it lies.
        deal = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = settled(postings(docs.repartition(deal, "id"), fields), "postings")
        df = settled(held.filter(F.col("term") != NO_TERM).groupBy("term").agg(F.count(F.lit(1)).alias("held"), *(F.count_if(F.col("field") == f).alias(f"df_{i}") for i, f in enumerate(fields))), "frequencies")
        stats = {r.field: r for r in field_stats(held).collect()}  # one row for each field
        of = lambda f: (F.lit(stats[f].n), F.lit(stats[f].avg_length)) if f in stats else (F.lit(0), F.lit(1.0))
        # A term in many texts is dealt to parts, and its frequency told; one part in LONG of all postings is such a term at most. A rarer term's list tells its own.
        often = F.broadcast(df.filter(F.col("held") > LONG).select("term", F.ceil(F.col("held") / F.lit(LONG)).alias("parts"), *(f"df_{i}" for i in range(len(fields)))))
        share = F.coalesce(*(F.when(F.col("field") == f, tf_part(F.col("tf"), F.col("length"), of(f)[1])) for f in fields))
        each = held.filter(F.col("term") != NO_TERM).select("term", "id", *(F.when(F.col("field") == f, share).alias(f"x_{i}") for i, f in enumerate(fields)))
        if len(fields) > 1:
            each = each.groupBy("term", "id").agg(*(F.max(f"x_{i}").alias(f"x_{i}") for i in range(len(fields))))
        part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0))
        dealt = each.join(often, "term", "left").withColumn("part", part).withColumn("bucket", _bucket())
        total = df.agg(F.sum("held")).first()[0] or 0
        spread = max(1, -(-total // (BUCKETS * TASK_ROWS)))
        dealt = dealt.withColumn("share", F.pmod(F.xxhash64("term", "part"), F.lit(spread))).repartition(BUCKETS * spread, "bucket", "share")
        lists = dealt.groupBy("bucket", "share", "term", "part").agg(*(F.first(f"df_{i}").alias(f"df_{i}") for i in range(len(fields))), F.collect_list(F.struct("id", *(f"x_{i}" for i in range(len(fields))))).alias("held"))
        has = lambda name: lambda x: x[name].isNotNull()
        known = lists.select("bucket", "term", "part", "held", *(F.coalesce(f"df_{i}", F.size(F.filter("held", has(f"x_{i}")))).alias(f"df_{i}") for i in range(len(fields))))
        factors = known.select("bucket", "term", "part", "held", F.array(*(idf(F.col(f"df_{i}"), of(f)[0]) for i, f in enumerate(fields))).alias("idf"))
        weight = lambda x: reduce(Column.__add__, (F.coalesce(F.col("idf")[i] * x[f"x_{i}"], F.lit(0.0)) for i in range(len(fields))))
        sorted_ = factors.select("bucket", "term", "part", F.array_sort(F.transform("held", lambda x: F.struct((-weight(x)).alias("less"), x["id"].alias("id")))).alias("held"))
        turns = F.sequence(F.lit(0), F.floor((F.size("held") - 1) / F.lit(BLOCK)).cast("int"))
        blocks = sorted_.select("bucket", "term", "part", F.posexplode(F.transform(turns, lambda i: F.slice("held", i * BLOCK + 1, BLOCK))).alias("turn", "held"))
        rows = blocks.select("bucket", "term", F.concat_ws("-", "turn", "part").alias("block"), (F.col("turn") == 0).alias("first"), (-F.col("held")[0]["less"]).alias("most"), F.col("held.id").alias("ids"), F.transform("held", lambda x: -x["less"]).alias("weights"))
        rows.sortWithinPartitions("bucket", "term", F.desc("most")).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        return TextIndex(docs.sparkSession, path)

    def read(self, terms: DataFrame) -> DataFrame:
        """The blocks of the terms (term): only their folders are listed, and a short list of terms goes to the scan as a filter."""
        held = self.spark.read.parquet(self.path)
        asked = settled(terms.select("term").distinct(), "asked-terms")
        buckets = [r.b for r in asked.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
        held = held.filter(F.col("bucket").isin(buckets)) if buckets else held.filter("false")
        few = asked.limit(TOLD_TERMS + 1).collect()
        if len(few) <= TOLD_TERMS:
            return held.filter(F.col("term").isin([r.term for r in few])) if few else held.filter("false")
        return held.join(asked, "term", "left_semi")

    def search(self, queries: DataFrame, top: int = 10, all_terms: bool = False) -> DataFrame:
        """query_id, id, score, rank: the best documents of each query (query_id, text), as ``search.search`` over the same table gives them."""
        terms = settled(query_terms(queries), "query-terms")
        blocks = self.read(terms)
        weights = lambda held: held.select("term", F.explode(F.arrays_zip("ids", "weights")).alias("p")).select("term", F.col("p.ids").alias("id"), F.col("p.weights").alias("s"))
        if not all_terms:  # partial sums are no bound where every term has to occur
            start = best(terms, weights(blocks.filter("first")), top, once=True)
            bound = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == top, F.min("score")).otherwise(0.0).alias("least"))
            each = terms.join(blocks.groupBy("term").agg(F.max("most").alias("best")), "term")
            others = each.withColumn("rest", F.sum("best").over(Window.partitionBy("query_id")) - F.col("best")).select("query_id", "term", "rest")
            # A block comes once, if any query needs it.
            need = others.join(settled(bound, "thresholds"), "query_id").groupBy("term").agg(F.min(F.col("least") - F.col("rest") - 1e-9).alias("enough"))
            blocks = blocks.join(need, "term").filter("most >= enough")
        return best(terms, weights(blocks), top, all_terms, once=True)
