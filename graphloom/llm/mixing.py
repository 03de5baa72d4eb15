"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; sorted
by key within its source, prefix sums of sizes decide what a token budget
takes. A budget of several times the source's size takes complete epochs first
and then a fraction by key. Documents are taken whole: one at the edge of the
budget is taken if more than half of it lies within.

A source is never sorted in one task: keys fall into ranges, as many as the
source's rows ask for, the sums of the ranges are added up, and each range is
sorted alone. Targets are shared out over a table of one row a source in one
task, so sources may be many thousands but not as many as documents.

What the fraction takes of a source is all up to an edge, the last key taken. The
rows themselves are therefore emitted where they are read, against one edge for
each source, and texts are not dealt out.

Defined results: a null text has size 0 and is taken 0 words; so is a source of
size 0, whose target is 0. A null source is a source of its own, the last; an
empty string is not null. A null, zero or negative quality counts as the least
one, a non-finite one as 1. Ties in key go to the smaller id, then the text's
hash; equal rows are interchangeable. The draw depends on seed, id and text
alone, so reruns agree. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, documents, few, fresh, named, settle, text_of

#: A quality weight below this counts as this.
LEAST_QUALITY = 1e-3
#: Rows of a key range, about.
RANGE_ROWS = 4_000


def prose_quality(text_col: str = "text", size_col: str = "size") -> Column:
    """A weight from 0.1 to 1: how near the mean word length is to prose, and how long the text is."""
    mean = F.length(text_of(text_col)) / F.greatest(F.col(size_col), F.lit(1))
    return F.greatest(F.lit(0.1), F.when(mean.between(3, 12), 1.0).otherwise(0.4) * F.col(size_col) / (F.col(size_col) + 50))


def targets(sizes: DataFrame, share: float = 1.0, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """Adds target to a table with a row per source (source, source_size): shares by weight, capped, the excess reshared.

    The end of resharing has a closed form: with sources ordered by cap over
    weight, the first ones are capped and the rest share what remains. The
    table has one row for each source.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    caps = (
        caps.withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("place", F.row_number().over(rising))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # The first source that stays under its cap sets the level for itself and all after it.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("place"), F.col("level")))).over(everything)
    return caps.withColumn("at", level["level"]).select("source", "source_size", "rows", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int) -> DataFrame:
    """Adds to ``docs`` (any columns): the doc_id, code, source, size and draw; the names must be free."""
    sized = docs.withColumns({"doc_id": named(id_col), "source": named(source_col), "code": F.xxhash64(text_of(text_col)), "size": F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")})
    own = prose_quality(text_col) if quality is None else quality.cast("double")
    weight = F.when(own.isNull() | (own < LEAST_QUALITY), F.lit(LEAST_QUALITY)).when(F.isnan(own) | (own == float("inf")), F.lit(1.0)).otherwise(own)
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "code"), 11).cast("double") + 0.5) / float(1 << 53)
    return sized.withColumn("draw", -F.log(draw) / weight)


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None, seed: int, share: float, most: float, weights: tuple[float, ...], range_rows: int) -> DataFrame:
    """One row per document: doc_id, code, source, size, draw, source_size, target, epochs, extra (whether the fraction takes it)."""
    rows = settle(_drawn(docs.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), named(text_col).alias("text"), *([] if quality is None else [quality.cast("double").alias("quality")])), "doc_id", "text", "source", None if quality is None else F.col("quality"), seed).select("doc_id", "code", "source", "size", "draw"), "mix")
    per_source = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.avg("draw").alias("mean")), "mix-sources")
    goals = targets(per_source.select("source", "source_size", "rows"), share, most, weights).join(per_source.select(F.col("source").alias("s"), "mean"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = goals.select(F.col("source").alias("s"), "source_size", "target", "mean", F.ceil(F.col("rows") / F.lit(range_rows)).alias("ranges"))
    # The range rises with the key: 1 - exp(-key / mean) is near uniform.
    spread = F.least(F.col("ranges") - 1, F.floor((1 - F.exp(-F.col("draw") / F.greatest("mean", F.lit(1e-12)))) * F.col("ranges")))
    dealt = rows.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("range", spread)
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    rising = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(rising), F.lit(0)).alias("start"))
    dealt = dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    inside = Window.partitionBy("source", "range").orderBy("draw", F.col("doc_id").isNull(), "doc_id", "code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("start") + F.sum("size").over(inside) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    out = dealt.withColumn("before", before).withColumn("epochs", epochs.cast("int"))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    return out.select("doc_id", "code", "source", "size", "draw", "source_size", "target", "epochs", ((F.col("size") > 0) & (F.col("before") + F.col("size") / 2.0 < rest)).alias("extra"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 2, share: float = 1.0, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, code (hash of the text), source, size, source_size, target, times, taken."""
    times = F.col("epochs") + F.col("extra").cast("int")
    out = _placed(docs, id_col, text_col, source_col, quality, seed, share, most, weights, range_rows).withColumn("times", times)
    return out.select("doc_id", "code", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: Column | None = None, seed: int = 2, share: float = 1.0, most: float = 3.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.

    Of equal rows at a source's edge, of which the fraction takes some, as many are taken.
    """
    place = F.struct("draw", F.col("doc_id").isNull().alias("none"), "doc_id", "code")
    placed = settle(_placed(docs, id_col, text_col, source_col, quality, seed, share, most, weights, range_rows), "mix-placed")
    edges = placed.groupBy("source").agg(F.first("epochs").alias("epochs"), F.max(F.when(F.col("extra"), place)).alias("edge"))
    edges = few(edges.select(F.col("source").alias("s"), "epochs", "edge"))
    at_edge = placed.join(edges, F.col("source").eqNullSafe(F.col("s")) & (place == F.col("edge")))
    split = settle(at_edge.groupBy(F.col("source").alias("at_source")).agg(F.count_if("extra").cast("int").alias("open"), F.count(F.lit(1)).alias("copies")).filter("open < copies"), "mix-split")
    (row,) = fresh(docs, "the row")
    drawn = _drawn(docs.select(F.struct(*map(named, docs.columns)).alias(row), named(id_col).alias("own id"), named(text_col).alias("own text"), named(source_col).alias("own source"), *([] if quality is None else [quality.cast("double").alias("own quality")])), "own id", "own text", "own source", None if quality is None else F.col("own quality"), seed)
    met = drawn.join(edges, F.col("source").eqNullSafe(F.col("s"))).withColumn("extra", F.coalesce((F.col("size") > 0) & (place <= F.col("edge")), F.lit(False)))
    at_turn = lambda df: df.select(row, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn")).select(f"{row}.*")
    if split.isEmpty():
        return at_turn(met.withColumn("times", F.col("epochs") + F.col("extra").cast("int")).filter("times > 0"))
    # Equal rows at an edge are numbered part by part, so no task holds a group as a whole.
    met = met.join(split, F.col("source").eqNullSafe(F.col("at_source")), "left").withColumn("shared", F.coalesce(F.col("open").isNotNull() & (place == F.col("edge")), F.lit(False)))
    rest = met.filter(~F.col("shared")).withColumn("times", F.col("epochs") + F.col("extra").cast("int")).select(row, "times")
    copies = settle(met.filter("shared").select(row, "epochs", "source", "open", F.spark_partition_id().alias("part")), "mix-copies")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = copies.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("source", "part").orderBy(F.lit(0))
    shared = copies.withColumn("place", F.row_number().over(own)).join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    shared = shared.select(row, (F.col("epochs") + (F.col("before") + F.col("place") <= F.col("open")).cast("int")).alias("times"))
    return at_turn(rest.unionByName(shared).filter("times > 0"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
