"""Exact top-k by integer inner product with pivot-table elimination.

Distances of every vector to a set of pivots are computed once. For a query q
and a candidate c the triangle inequality gives, over all pivots p,
|q - c| >= max |d(q, p) - d(c, p)|, and so an upper bound of their inner product
(|q|^2 + |c|^2 - |q - c|^2) / 2. Candidates are evaluated in the order of this
bound until it falls under the k-th best score found, which is exact.

The table is cut into blocks of bounded size, each of vectors near the same pivot
and at a like distance from it, so a block has narrow ranges of pivot distances,
and these bound all its members at once. A query first searches one block, that
of its own place; its k-th best score there is a threshold that no later one can
fall under. It is then sent to those blocks alone whose bound reaches the
threshold, the rest being eliminated before any vector moves, and there the
search by bound begins with the threshold. A block is sent once for each
``QUERIES`` queries that need it. ``search`` also says how many candidates were
evaluated.

Components become floor(1024 x), x as double. Defined results: vectors that are
null, hold a null or a non-finite component, or have no id take no part; vectors
of different dimension have no score. Rows are told apart by position among
those of their id, so a repeated id can be found by its other rows, and repeated
query rows give repeated results. Scores are exact integers for all finite
doubles; beyond 64 bits they stop at their bounds, and there ties go by id like
all others. What overflows in a bound counts as infinite and eliminates nobody.
Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import FEW, settle

K, SCALE, PIVOTS = 10, 1024, 32
#: Pivots that make cells; all of them make bounds.
CELLS = 8
#: Rows of a block, queries that meet it together, queries whose bounds are made together, and block ranges that are looked through together.
CANDIDATES, QUERIES, TOGETHER, RANGES = 8192, 4096, 32, 20_000
#: Quantiles of the distance to its pivot that cut a cell.
SHELLS = 64
#: Components up to this give sums that doubles hold exactly for up to 512 dimensions.
EXACT = 1 << 21
#: The least score, as a threshold that eliminates nobody.
NONE = -(1 << 63)
#: What a search gives; evaluated is the number of candidates of the block, at the query's first row there.
FOUND = "query_id long, query_turn long, vec_id long, turn long, score long, evaluated long"


def _floor(x: Column, scale: int) -> Column:
    """floor(scale * x) / scale for a power of two: exact, and it doesn't overflow; large doubles have no fraction."""
    return F.when(F.abs(x) < float(1 << 42), F.floor(F.lit(float(scale)) * x).cast("double") / float(scale)).otherwise(x)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to pivots, from differences, so that their relative error is that of a sum however far a pivot lies."""
    with np.errstate(all="ignore"):
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def pivot_table(rows: DataFrame, pivots: int, size: int) -> DataFrame:
    """Adds to (vec_id, turn, dim, v) the distances to the pivots, d, and the block; v and d become packed doubles.

    A block has about ``size`` vectors nearest to one of the first pivots, at a like
    distance from it. A pivot may be nearest to a third of all rows, so they are not sorted:
    quantiles of the distance cut them into shells, and a shell that is too large,
    or consists of equal distances, is dealt out by hash.
    """
    draw = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "turn"), "vec_id", "turn"))
    chosen = rows.select("vec_id", "turn", "dim").withColumn("draw", draw).filter(F.col("draw") <= pivots)
    held = {}
    for r in rows.join(chosen, ["vec_id", "turn", "dim"]).select("dim", "v").collect():
        held.setdefault(r.dim, []).append(r.v)
    held = {d: np.array(sorted(v), np.float64).reshape(len(v), d) for d, v in held.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = [np.asarray(x, np.float64) for x in part["v"]]
            d = [_distances(x[None, :], held[len(x)])[0] for x in v] if len(held) != 1 else list(_distances(np.array(v), next(iter(held.values()))))
            near = [int(np.argmin(np.nan_to_num(x[:CELLS], nan=np.inf))) for x in d]
            yield pd.DataFrame({"vec_id": part["vec_id"], "turn": part["turn"], "dim": part["dim"], "v": [x.tobytes() for x in v], "d": [x.tobytes() for x in d], "cell": near, "far": [float(x[i]) for x, i in zip(d, near, strict=True)]})

    table = settle(rows.mapInPandas(run, "vec_id long, turn int, dim int, v binary, d binary, cell int, far double"), "distances")
    steps = F.array(*(F.lit(i / SHELLS) for i in range(1, SHELLS)))
    cells = table.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", steps, 1000).alias("cuts"))
    if sum(map(len, held.values())) <= FEW:  # one row for each pivot
        cells = F.broadcast(cells)
    # As many steps of the quantiles make a shell as it takes to fill a block.
    steps_each = F.greatest(F.lit(1), F.floor(F.lit(SHELLS * size) / F.col("n")))
    shell = F.when(F.col("n") <= size, 0).otherwise(F.floor(F.size(F.filter("cuts", lambda c: c < F.col("far"))) / steps_each))
    equal = F.when(F.col("n") <= size, 0).otherwise(F.size(F.filter("cuts", lambda c: c == F.col("far"))))
    parts = F.ceil(F.col("n") * F.when(F.col("n") <= size, 1.0).otherwise((F.col("equal") + 1) / float(SHELLS)) / size)
    part = F.pmod(F.xxhash64("vec_id", "turn"), F.greatest(parts, F.lit(1)))
    placed = table.join(cells, ["dim", "cell"]).withColumn("shell", shell).withColumn("equal", equal)
    return settle(placed.select("vec_id", "turn", "dim", "v", "d", F.concat_ws("-", "dim", "cell", "shell", "equal", part).alias("block")), "pivots")


def _ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For parts of blocks: the least and largest distance to each pivot, and the largest norm squared."""
    for part in parts:
        rows = []
        for (dim, block), own in part.groupby(["dim", "block"]):
            d, v = _matrix(own["d"]), _matrix(own["v"])
            with np.errstate(all="ignore"):
                rows.append((dim, block, d.min(axis=0).tolist(), d.max(axis=0).tolist(), float((v**2).sum(axis=1).max(initial=0))))
        yield pd.DataFrame(rows, columns=["dim", "block", "low", "high", "norm"])


def block_ranges(table: DataFrame) -> DataFrame:
    """One row for each block: dim, block, low and high by pivot, norm."""
    parts = table.select("dim", "block", "v", "d").mapInPandas(_ranges, "dim int, block string, low array<double>, high array<double>, norm double")
    pick = lambda best: lambda a, b: F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: best(z["a"], z["b"]))
    fold = lambda rows, best: F.reduce(F.slice(rows, 2, F.size(rows)), rows[0], pick(best))
    # A block has one row for each Arrow batch that held some of it, and it is bounded in rows.
    listed = parts.groupBy("dim", "block").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"), F.max("norm").alias("norm"))
    return listed.select("dim", "block", fold(F.col("low"), F.least).alias("low"), fold(F.col("high"), F.greatest).alias("high"), "norm")


def _bounds(qq: np.ndarray | float, cc: np.ndarray | float, apart: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products of vectors at least ``apart`` from each other; infinite where something overflows."""
    with np.errstate(all="ignore"):
        bound = (qq + cc - apart**2) / 2 + 1e-6 * (1 + qq + cc)  # what rounding may have taken
    return np.where(np.isnan(bound), np.inf, bound)


class Scores:
    """Inner products of the vectors of a block, times ``scale``, as integers stopped at 64 bits."""

    def __init__(self, vectors: np.ndarray, scale: int) -> None:
        self.vectors, self.scale = vectors, scale
        self.small = bool(np.abs(vectors).max(initial=0) <= EXACT / scale and vectors.shape[1] <= 512)
        self.scaled = vectors * scale if self.small else None

    def __call__(self, part: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.small and np.abs(query).max(initial=0) <= EXACT / self.scale:
            return (self.scaled.take(part, axis=0) @ (query * self.scale)).astype(np.int64)
        whole = lambda row: [int(x * self.scale) if abs(x) < 1 << 42 else int(x) * self.scale for x in row.tolist()]
        q = whole(query)
        return np.array([min(max(sum(a * b for a, b in zip(whole(row), q, strict=True)), NONE), -1 - NONE) for row in self.vectors[part]], np.int64)


def _block_bounds(q: np.ndarray, c: np.ndarray, dq: np.ndarray, dc: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of some queries with all candidates of a block, from pivot distances."""
    with np.errstate(all="ignore"):
        apart = np.zeros((len(q), len(c)))
        known = bool(np.isfinite(dq).all() and np.isfinite(dc).all())
        for own, other in zip(dq.T, np.ascontiguousarray(dc.T), strict=True):
            gap = np.abs(own[:, None] - other[None, :])
            # A pivot out of range tells nothing.
            np.maximum(apart, gap if known else np.where(np.isfinite(gap), gap, 0), out=apart)
        # What rounding may have added to a difference of distances is taken off.
        slack = (dq.max(axis=1, initial=0)[:, None] + dc.max(axis=1, initial=0)[None, :]) * q.shape[1] * 2.0**-50
        apart = np.maximum(apart - slack, 0) if known else np.where(np.isfinite(slack), np.maximum(apart - slack, 0), 0)
        return _bounds((q**2).sum(axis=1)[:, None], (c**2).sum(axis=1)[None, :], apart)


def search_block(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int = SCALE) -> pd.DataFrame:
    """The k best candidates of a block for every query of a block, of those that reach the query's threshold (column least)."""
    found = []
    if len(queries) and len(candidates):
        q, c, dq, dc = _matrix(queries["v"]), _matrix(candidates["v"]), _matrix(queries["d"]), _matrix(candidates["d"])
        ids, turns = candidates["vec_id"].to_numpy(np.int64), candidates["turn"].to_numpy(np.int64)
        own_ids, own_turns = queries["vec_id"].to_numpy(np.int64), queries["turn"].to_numpy(np.int64)
        scores = Scores(c, scale)
        least, place = queries["least"].to_numpy(np.int64), {x: i for i, x in enumerate(zip(ids.tolist(), turns.tolist(), strict=True))}
        for i in range(len(q)):
            if i % TOGETHER == 0:
                bounds = _block_bounds(q[i : i + TOGETHER], c, dq[i : i + TOGETHER], dc) * scale * scale
            bound = bounds[i % TOGETHER]
            own = place.get((int(own_ids[i]), int(own_turns[i])))
            if own is not None:
                bound[own] = -np.inf
            live = np.flatnonzero(bound >= float(least[i]))
            order = live[np.argsort(-bound[live], kind="stable")]
            best_s, best_i, best_t = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            at, step = 0, 4 * k
            while at < len(order) and (len(best_s) < k or bound[order[at]] >= float(best_s[-1])):
                part = order[at : at + step]
                at, step = at + len(part), 4 * step
                score = scores(part, q[i])
                hit = score >= max(int(least[i]), int(best_s[-1]) if len(best_s) == k else NONE)
                best_s, best_i, best_t = np.concatenate([best_s, score[hit]]), np.concatenate([best_i, ids[part[hit]]]), np.concatenate([best_t, turns[part[hit]]])
                top = np.lexsort((best_t, best_i, ~best_s))[:k]
                best_s, best_i, best_t = best_s[top], best_i[top], best_t[top]
            found.append((own_ids[i], own_turns[i], best_i, best_t, best_s, at))
    sizes = [len(f[2]) for f in found]
    column = lambda j: np.repeat(np.array([f[j] for f in found], np.int64), sizes)
    joined = lambda j: np.concatenate([np.empty(0, np.int64), *(f[j] for f in found)])
    first = np.concatenate([np.empty(0, bool), *(np.arange(n) == 0 for n in sizes)]).astype(np.int64)
    return pd.DataFrame({"query_id": column(0), "query_turn": column(1), "vec_id": joined(2), "turn": joined(3), "score": joined(4), "evaluated": column(5) * first})


def _reached(ranges: DataFrame, scale: int):
    """For queries (dim, v, d, block, least): the other blocks whose bound reaches the threshold."""
    held = {}
    for r in ranges.collect():  # RANGES rows at most
        held.setdefault(r["dim"], []).append(r)
    held = {d: ([r["block"] for r in rows], np.array([r["low"] for r in rows], np.float64), np.array([r["high"] for r in rows], np.float64), np.array([r["norm"] for r in rows], np.float64)) for d, rows in held.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at, to = [], []
            for i, (dim, v, d, own, least) in enumerate(zip(part["dim"], part["v"], part["d"], part["block"], part["least"], strict=True)):
                if dim not in held:
                    continue
                names, low, high, norm = held[dim]
                dq, q = np.frombuffer(d, np.float64), np.frombuffer(v, np.float64)
                with np.errstate(all="ignore"):
                    apart = np.maximum(low - dq, dq - high) - (high + dq) * len(q) * 2.0**-50
                    apart = np.where(np.isfinite(apart), np.maximum(apart, 0), 0).max(axis=1, initial=0)
                    bound = _bounds(float((q**2).sum()), norm, apart) * scale * scale
                    # |q||c| is a bound as well.
                    bound = np.fmin(bound, np.sqrt((q**2).sum()) * np.sqrt(norm) * scale * scale * (1 + 1e-6) + 1e-6)
                for j in np.flatnonzero(bound >= float(least)):
                    if names[j] != own:
                        at.append(i)
                        to.append(names[j])
            sent = part.iloc[at].drop(columns="block")
            sent["block"] = to
            yield sent[["vec_id", "turn", "dim", "v", "d", "block", "least"]]

    return run


def _met(asked: DataFrame, table: DataFrame, k: int, scale: int, together: int) -> DataFrame:
    """Queries (with block and least) searched in their blocks; a block is sent once for each ``together`` queries or so."""
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
    loads = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(together)).cast("int").alias("parts"))
    left = asked.join(loads, "block").withColumn("part", F.pmod(F.xxhash64("vec_id", "turn"), F.col("parts")).cast("int")).drop("parts")
    right = table.join(loads, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ("block", "part")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: search_block(a, b, k, scale), FOUND)


def search(vectors: DataFrame, queries: str, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, candidate_block: int = CANDIDATES, query_block: int = QUERIES, ranges_block: int = RANGES) -> DataFrame:
    """For each row that the condition ``queries`` on vec_id selects, the candidates that may be among its k best: query_id, query_turn, vec_id, turn, score, evaluated (in the search that the row came from, at its first row)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("x")).filter("vec_id is not null and x is not null")
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(sound).select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda x: _floor(x, scale)).alias("v"))
    turn = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    table = pivot_table(settle(rows.withColumn("turn", turn), "vectors"), pivots, candidate_block)
    columns = ["vec_id", "turn", "dim", "v", "d", "block", "least"]
    asked = table.filter(queries).withColumn("least", F.lit(NONE)).select(columns)
    near = settle(_met(asked, table, k, scale, query_block), "nearest-blocks")
    # The k-th best score of a query's own block; a query with fewer candidates there has no threshold yet.
    least = near.groupBy("query_id", "query_turn").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least"))
    asked = asked.drop("least").join(least, (F.col("vec_id") == F.col("query_id")) & (F.col("turn") == F.col("query_turn")), "left").withColumn("least", F.coalesce("least", F.lit(NONE))).select(columns)
    ranges = settle(block_ranges(table), "block-ranges")
    parts, found = max(1, -(-ranges.count() // ranges_block)), near
    for part in range(parts):  # ranges are looked through so many at a time
        own = ranges if parts == 1 else ranges.filter(F.pmod(F.xxhash64("block"), F.lit(parts)) == part)
        sent = settle(asked.mapInPandas(_reached(own, scale), "vec_id long, turn int, dim int, v binary, d binary, block string, least long"), "sent-queries")
        found = found.unionByName(_met(sent, table, k, scale, query_block))
    return found


def top_k(vectors: DataFrame, queries: str, k: int = K, **options) -> DataFrame:
    """For each row that the condition ``queries`` on vec_id selects, its k best other rows: query_id, query_turn, rank, vec_id, score. ``options`` are those of ``search``."""
    found = search(vectors, queries, k, **options)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_turn").orderBy(F.desc("score"), "vec_id", "turn"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "query_turn", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 100 = 0").select("query_id", "rank", "vec_id", "score")


SQL = {
    "op3_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
}
