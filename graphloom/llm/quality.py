"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model.

The model counts n-grams of characters (16-bit units; a character beyond the
basic plane is two) over all trusted texts: documents with a label of quality 1
and none of 0, one in five held back to set thresholds. Counts are folded in each
task and added up by n-gram; the counts of lower orders are those of distinct
continuations, the discounts those of modified Kneser-Ney, and every probability
and backoff weight comes from joins of these count tables by context.

The tables are sharded by the last unit of the context, which all orders of a
position share, into as many shards of ``SHARD_ENTRIES`` as they need. Shards are
met one after the other: a shard's entries go to the tasks, each document's counts
are joined with them, the partial sums are written, and the shard is released
before the next. Driver and workers therefore hold one shard, whatever the corpus;
the price is a pass over the texts for each shard, and the number of shards grows
with the variety of writing, not with the number of documents.

A document is kept if its perplexity is at most the quantile of held-back trusted
documents in its language. The logarithm of perplexity is put on a grid of
1 / ``GRID``, so the quantile is exact on a histogram of bounded size. A language
with h held-back documents has a threshold of its own and of all languages in the
proportion of h to ``PRIOR``, so that few documents decide little.

Texts are lower-cased and runs of white space count as one space. Defined
results: a null or blank text has no perplexity and is not kept; without trusted
text nothing has a perplexity and everything but blank texts is kept; without
held-back text there is no threshold and everything with a perplexity is kept. A
null language is a language of its own. Repeated rows give repeated results;
labels of unknown documents, repeated and null labels do no harm. Empty tables
give no rows, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, few, lean, settle

ORDER = 4
#: Entries of a shard at most; 16 bytes each.
SHARD_ENTRIES = 4_000_000
#: The quantile of held-back trusted documents, the steps of the grid in a unit of log perplexity, and the weight, in documents, of all languages.
QUANTILE, GRID, PRIOR = 0.999, 1000, 50
#: Trusted ids, 8 bytes each, that may be broadcast; more of them meet the texts by shuffle.
FEW_TRUSTED = 4_000_000
#: Characters that are counted or scored together.
TOGETHER = 400_000


@lru_cache(1)
def _signs() -> np.ndarray:
    """16-bit units: themselves, but a space for white space and for zero."""
    table = np.arange(1 << 16, dtype=np.uint64)
    table[[c for c in range(1 << 16) if chr(c).isspace()] + [0]] = 32
    return table


def codes(text: str | None) -> np.ndarray:
    """The n-gram that ends at each unit, the last four units in 64 bits; the text is preceded by spaces."""
    held = _signs()[np.frombuffer((text or "").lower().encode("utf-16-le", "surrogatepass"), np.uint16)]
    blank = held == 32
    if blank.all():
        return np.empty(0, np.uint64)
    held = held[~(blank & np.concatenate([[True], blank[:-1]]))]
    held = np.concatenate([np.full(ORDER - 1, 32, np.uint64), held])
    n = len(held) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out |= held[ORDER - 1 - k : ORDER - 1 - k + n] << np.uint64(16 * k)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, seen = [], 0
    sums_c, sums_n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def fold() -> None:
        nonlocal sums_c, sums_n, held, seen
        c, n = np.unique(np.concatenate(held), return_counts=True)
        c, n = np.concatenate([sums_c, c]), np.concatenate([sums_n, n])
        sums_c, where = np.unique(c, return_inverse=True)
        sums_n = np.bincount(where, n, len(sums_c)).astype(np.int64)
        held, seen = [], 0

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sums_c.view(np.int64)), pa.array(sums_n)], names=["g", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.append(codes(text))
            seen += len(held[-1])
            if seen > TOGETHER:
                fold()
        if len(sums_c) > SHARD_ENTRIES:
            yield passed()
            sums_c, sums_n = np.empty(0, np.uint64), np.empty(0, np.int64)
    if held:
        fold()
    if len(sums_c):
        yield passed()


def _low(order: int) -> Column:
    mask = (1 << (16 * order)) - 1
    return F.col("g") if order == ORDER else F.col("g").bitwiseAND(F.lit(mask))


def _context(order: int) -> Column:
    return F.shiftrightunsigned("g", 16)


def counts(texts: DataFrame) -> list[DataFrame]:
    """Tables (g, n) by order, from 1: plain counts of the highest, of distinct continuations below."""
    top = settle(texts.mapInArrow(lean(_count), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")), "kn-counts")
    out = [top]
    for order in range(ORDER - 1, 0, -1):
        out.append(settle(out[-1].select(_low(order).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")), "kn-counts"))
    return out[::-1]


def model(tables: list[DataFrame]) -> tuple[DataFrame, float]:
    """Entries (kind, g, value): log probabilities by order, log backoff weights by order + 10; and the log probability of an unknown sign."""
    entries, lower, floor = [], None, 0.0
    for order, table in enumerate(tables, 1):
        of = {int(r.n): r.c for r in table.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        # Where a count of counts is missing the discounts fall back to half of the count, at most one.
        d = [min(max(i - (i + 1) * y * more / own, 0.05), float(i)) if own and more and n1 else 0.5 * min(i, 2) for i, own, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        own = table.withColumn("h", _context(order)).withColumn("cut", cut)
        contexts = settle(own.groupBy("h").agg(F.sum("n").alias("all"), F.sum("cut").alias("cuts")), "kn-contexts")
        if order == 1:
            whole = contexts.agg(F.sum("all").alias("all"), F.sum("cuts").alias("cuts"), F.lit(0)).first()
            signs = table.count() + 1
            floor = whole.cuts / whole.all / signs
            p = own.select("g", ((F.col("n") - F.col("cut")) / whole.all + floor).alias("p"))
        else:
            joined = own.join(contexts, "h").withColumn("low", _low(order - 1)).join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
            p = joined.select("g", ((F.col("n") - F.col("cut")) / F.col("all") + F.col("cuts") / F.col("all") * F.col("q")).alias("p"))
            entries.append(contexts.select(F.lit(order + 10).alias("kind"), F.col("h").alias("g"), F.log(F.col("cuts") / F.col("all")).alias("value"), F.col("h").bitwiseAND(F.lit(0xFFFF)).alias("last")))
        lower = settle(p, "kn-order")
        entries.append(lower.select(F.lit(order).alias("kind"), "g", F.log("p").alias("value"), _context(order).bitwiseAND(F.lit(0xFFFF)).alias("last")))
    out = entries[0]
    for more in entries[1:]:
        out = out.unionByName(more)
    return settle(out, "kn-model"), float(np.log(floor))


class Scorer:
    """Log probabilities of n-grams from the entries of a shard."""

    def __init__(self, kind: np.ndarray, g: np.ndarray, value: np.ndarray, floor: float) -> None:
        self.floor, self.tables = floor, {}
        for k in np.unique(kind).tolist():
            own = kind == k
            order = np.argsort(g[own])
            self.tables[k] = (g[own][order], value[own][order])

    def _get(self, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if kind not in self.tables:
            return np.zeros(len(grams), bool), np.zeros(len(grams))
        keys, values = self.tables[kind]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        hit = keys[at] == grams
        return hit, np.where(hit, values[at], 0.0)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for order in range(ORDER, 0, -1):
            own = grams[open_] & np.uint64((1 << (16 * order)) - 1)
            hit, value = self._get(order, own)
            out[open_] += value
            open_, own = open_[~hit], own[~hit]
            if order > 1:
                out[open_] += self._get(order + 10, own >> np.uint64(16))[1]
            else:
                out[open_] += self.floor
        return out


def _scoring(arrays, floor: float, mine: np.ndarray | None):
    """Adds n (scored units) and logp under one shard to rows that end in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            if scorer is None:
                scorer = Scorer(*arrays.value, floor)
            logp, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            held, rows, seen = [], [], 0

            def add() -> None:
                distinct, where = np.unique(np.concatenate(held), return_inverse=True)
                np.add.at(logp, rows, np.add.reduceat(np.append(scorer(distinct)[where], 0.0), np.cumsum([0, *map(len, held[:-1])])))

            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                grams = codes(text)
                if mine is not None:
                    grams = grams[mine[((grams >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]]
                n[i] = len(grams)
                for a in range(0, len(grams), TOGETHER):
                    held.append(grams[a : a + TOGETHER])
                    rows.append(i)
                    seen += len(held[-1])
                    if seen > TOGETHER:
                        add()
                        held, rows, seen = [], [], 0
            if held:
                add()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), pa.array(logp)], names=[*batch.schema.names[:-1], "n", "logp"])

    return lean(run)


def score(docs: DataFrame, entries: DataFrame, floor: float, carry: tuple[str, ...], text_col: str, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """The columns ``carry`` with n (scored units) and logp: one row per document. With more than one shard, ``carry`` must tell rows apart; equal ones are added up."""
    shards = max(1, -(-entries.count() // shard_entries))
    if shards > 1:  # the parts of a document are added up by row, so rows are fixed first
        docs = settle(docs.select(*carry, text_col), "kn-documents")
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    spark, out = docs.sparkSession, None
    of = F.pmod(F.xxhash64("last"), F.lit(shards))
    for shard in range(shards):
        table = (entries if shards == 1 else entries.filter((F.col("kind") == 1) | (of == shard))).select("kind", "g", "value").toArrow()  # SHARD_ENTRIES rows or so
        arrays = spark.sparkContext.broadcast((table["kind"].to_numpy(), table["g"].to_numpy().view(np.uint64), table["value"].to_numpy()))
        del table
        mine = None
        if shards > 1:
            lasts = [r.last for r in spark.range(1 << 16).select(F.col("id").alias("last")).filter(of == shard).collect()]
            mine = np.isin(np.arange(1 << 16), np.array(lasts, np.int64))
        own = docs.select(*carry, F.col(text_col).alias("the text")).mapInArrow(_scoring(arrays, floor, mine), f"{fields}, n long, logp double")
        own = settle(own, "kn-scores")
        arrays.destroy()
        out = own if out is None else out.unionByName(own)
    return out if shards == 1 else out.groupBy(*carry).agg(F.sum("n").alias("n"), F.sum("logp").alias("logp"))


def thresholds(judges: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR) -> tuple[DataFrame, float | None]:
    """Of scored held-back documents (lang, step): (lang, own) with the last step that is kept, and that of all languages.

    The step of a quantile is the least one under or at which that share of documents lies.
    """
    bins = settle(judges.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n")), "kn-bins")
    reach = lambda held, by: held.withColumn("upto", F.sum("n").over(Window.partitionBy(*by).orderBy("step"))).withColumn("all", F.sum("n").over(Window.partitionBy(*by))).filter(F.col("upto") >= F.lit(quantile) * F.col("all"))
    overall = reach(bins.groupBy("step").agg(F.sum("n").alias("n")), []).agg(F.min("step").alias("s")).first().s
    own = reach(bins, ["lang"]).groupBy("lang").agg(F.min("step").alias("step"), F.first("all").alias("held"))
    return own.select("lang", ((F.col("step") * F.col("held") + F.lit(overall or 0) * prior) / (F.col("held") + prior)).alias("own")), overall


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, prior: int = PRIOR, shard_entries: int = SHARD_ENTRIES, few_trusted: int = FEW_TRUSTED) -> DataFrame:
    """One row per document: doc_id, lang, n, perplexity, threshold, kept."""
    good = settle(labels.groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min("quality").alias("least"), F.max("quality").alias("most")).filter("least = 1 and most = 1 and trusted_id is not null").select("trusted_id"), "kn-trusted")
    held_back = F.pmod(F.xxhash64("trusted_id", F.lit(7)), F.lit(5)) == 0
    met = F.broadcast if good.count() <= few_trusted else lambda df: df
    trusted = docs.select(F.col(id_col).alias("trusted_id"), F.col(text_col).alias("text")).join(met(good.filter(~held_back)), "trusted_id", "left_semi").select("text")
    tables = counts(trusted)
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    if tables[0].isEmpty():
        blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
        return named.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (~blank).alias("kept"))
    entries, floor = model(tables)
    scored = score(named, entries, floor, ("uid", "doc_id", "lang"), "text", shard_entries)
    mean = -F.col("logp") / F.col("n")
    scored = scored.select("doc_id", "lang", "n", F.when(F.col("n") > 0, F.exp(mean)).alias("perplexity"), F.when(F.col("n") > 0, F.ceil(mean * GRID)).alias("step"))
    judges = scored.join(met(good.filter(held_back)), F.col("doc_id") == F.col("trusted_id"), "left_semi").filter("step is not null")
    own, overall = thresholds(judges, quantile, prior)
    out = scored.join(few(own.select(F.col("lang").alias("own_lang"), "own")), F.col("lang").eqNullSafe(F.col("own_lang")), "left")
    most = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.col("step").isNotNull() & F.coalesce(F.col("step") <= most, F.lit(True))
    return out.select("doc_id", "lang", "n", "perplexity", F.exp(most / GRID).alias("threshold"), kept.alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
