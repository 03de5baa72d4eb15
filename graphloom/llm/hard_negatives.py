"""Hard negatives by a Voronoi-partition distributed kNN join on integer inner products.

Vectors get one more component, the root of what their squared norm lacks of the largest
one, and an anchor gets a zero there; then |a - c|^2 = |a|^2 + M^2 - 2 a.c, so
the largest inner products are the smallest distances. Vectors are assigned to
the nearest pivot; a cell is cut into shells by distance, and by parts of the
labels, into blocks of bounded size, each with its range of distances to every pivot.
These give bounds of the inner products of an anchor with all members of a
block, from above and from below.

Positives, then negatives, are found in two passes. Each anchor first meets the
block of highest bound; what it finds there is a threshold. Then blocks are
replicated to the anchor groups (anchors of neighbouring cells) of which some
anchor they might serve: blocks that can reach an anchor's threshold, and for negatives don't
lie wholly beyond its window of scores. There a local join is exact.
Positives are looked for in blocks of the anchor's part of the labels only, negatives not in
blocks of its label alone.

A positive of score p has negatives with low * p <= 100 * score <= high * p, so a
positive below zero has none, and one of zero those of score zero.

Components become floor(scale * x), x as double. Defined results: rows without id or
label, and vectors that are null or hold a null or a non-finite component take no
part; vectors of different dimension have no score. Rows are told apart by
place, so other rows of an anchor's id are candidates, and repeated
anchor rows give repeated results. Scores are exact for all finite doubles and stop at 64
bits. Ties go to the smaller id. An anchor without positives, or a positive without negatives,
gives no rows; nor do empty tables. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import FEW, few, named, settle
from .exact_topk import EXACT, NONE, SHELLS, Scores, _floor, _matrix

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Pivots for each dimension, a bounded sample by hash; the first of them make cells.
PIVOTS, CELLS = 32, 8
#: Parts of the labels; rows of a block; anchors of a group; anchors whose scores are made together; block ranges looked through together.
PARTS, BLOCK, GROUP, TOGETHER, RANGES = 16, 8192, 4096, 256, 20_000
_ANCHOR = "uid long, vec_id long, label string, part int, dim int, v binary, d binary, group string, least array<long>, most array<long>"


def _rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    x = F.transform(named(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(label_col).cast("string").alias("label"), x.alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and x is not null").filter(sound)
    v = F.transform("x", lambda x: _floor(x, scale))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.pmod(F.xxhash64("label"), F.lit(PARTS)).cast("int").alias("part"), F.size("x").alias("dim"), v.alias("v"))


class Pivots:
    """Pivots of one dimension with their added component, and the largest squared norm."""

    def __init__(self, vectors: list[list[float]], dim: int, largest: float) -> None:
        self.vectors = np.array(sorted(vectors), np.float64).reshape(len(vectors), dim)
        self.largest = largest
        self.added = self._lacking(self.vectors)

    def _lacking(self, v: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.sqrt(np.maximum(self.largest - (v**2).sum(axis=1), 0))

    def distances(self, v: np.ndarray, anchors: bool) -> np.ndarray:
        """To every pivot, from differences; the added component of an anchor is zero."""
        own = np.zeros(len(v)) if anchors else self._lacking(v)
        with np.errstate(all="ignore"):
            return np.stack([np.sqrt(((v - p) ** 2).sum(axis=1) + (own - a) ** 2) for p, a in zip(self.vectors, self.added, strict=True)], axis=1)


def _pivots(rows: DataFrame, pivots: int) -> dict[int, Pivots]:
    """By dimension; ``pivots`` vectors of each."""
    draw = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("uid"), "uid"))
    chosen = rows.select("uid", "dim").withColumn("draw", draw).filter(F.col("draw") <= pivots).select("uid")
    held: dict[int, list[list[float]]] = {}
    for r in rows.join(F.broadcast(chosen), "uid").select("dim", "v").collect():  # ``pivots`` for each dimension
        held.setdefault(r.dim, []).append(r.v)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    largest = {r.dim: r.m for r in rows.groupBy("dim").agg(F.max(norm).alias("m")).collect()}
    return {dim: Pivots(v, dim, largest[dim]) for dim, v in held.items()}


def _measured(held: dict[int, Pivots], anchors: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds distances to pivots, the cell and the distance to its pivot; vectors become packed doubles."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, own in part.groupby("dim"):
                v = np.array(own["v"].tolist(), np.float64).reshape(len(own), int(dim))
                d = held[int(dim)].distances(v, anchors)
                near = np.argmin(np.nan_to_num(d[:, :CELLS], nan=np.inf), axis=1)
                yield own.assign(v=[x.tobytes() for x in v], d=[x.tobytes() for x in d], cell=near.astype(np.int32), far=d[np.arange(len(d)), near])

    return run


_MEASURED = "uid long, vec_id long, label string, part int, dim int, v binary, d binary, cell int, far double"


def voronoi(rows: DataFrame, held: dict[int, Pivots], block: int = BLOCK) -> DataFrame:
    """Rows with their block: vectors of one part of the labels, of one cell, and of like distance to its pivot.

    A cell may hold a third of all rows: quantiles of the distance cut it into shells, and equal distances are dealt out by hash.
    """
    table = settle(rows.mapInPandas(_measured(held, False), _MEASURED), "voronoi-distances")
    keys = ["dim", "part", "cell"]
    steps = F.array(*(F.lit(i / SHELLS) for i in range(1, SHELLS)))
    cells = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", steps, 1000).alias("cuts"))
    if len(held) * PARTS * CELLS <= FEW:
        cells = F.broadcast(cells)
    whole = F.col("n") <= block
    each = F.greatest(F.lit(1), F.floor(F.lit(SHELLS * block) / F.col("n")))  # quantiles that fill a block
    shell = F.when(whole, 0).otherwise(F.floor(F.size(F.filter("cuts", lambda c: c < F.col("far"))) / each))
    equal = F.when(whole, 0).otherwise(F.size(F.filter("cuts", lambda c: c == F.col("far"))))
    pieces = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") * (F.col("equal") + 1) / SHELLS / block)))
    placed = table.join(cells, keys).withColumn("shell", shell).withColumn("equal", equal)
    name = F.concat_ws("-", *keys, "shell", "equal", F.pmod(F.xxhash64("uid"), pieces))
    return settle(placed.select("uid", "vec_id", "label", "part", "dim", "v", "d", name.alias("block")), "voronoi-blocks")


def _ranges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for (dim, label_part, block), own in part.groupby(["dim", "part", "block"]):
            d, v = _matrix(own["d"]), _matrix(own["v"])
            with np.errstate(all="ignore"):
                rows.append((dim, label_part, block, d.min(axis=0).tolist(), d.max(axis=0).tolist(), float((v**2).sum(axis=1).max(initial=0)), own["label"].min(), own["label"].max()))
        yield pd.DataFrame(rows, columns=["dim", "part", "block", "low", "high", "norm", "first", "last"])


def partition_bounds(table: DataFrame) -> DataFrame:
    """One row for each block: dim, part, block, least and largest distances to the pivots, largest squared norm, first and last label."""
    parts = table.select("dim", "part", "block", "v", "d", "label").mapInPandas(_ranges, "dim int, part int, block string, low array<double>, high array<double>, norm double, first string, last string")
    at = F.posexplode(F.arrays_zip("low", "high")).alias("i", "z")
    # The ranges of a block come in as many rows as Arrow batches held some of it.
    each = parts.select("dim", "part", "block", at).groupBy("dim", "part", "block", "i").agg(F.min("z.low").alias("low"), F.max("z.high").alias("high"))
    bounds = each.groupBy("dim", "part", "block").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("z"))
    rest = parts.groupBy("dim", "part", "block").agg(F.max("norm").alias("norm"), F.min("first").alias("first"), F.max("last").alias("last"))
    return bounds.select("dim", "part", "block", F.col("z.low").alias("low"), F.col("z.high").alias("high")).join(rest, ["dim", "part", "block"])


def anchor_groups(rows: DataFrame, held: dict[int, Pivots], anchors: str, size: int = GROUP) -> DataFrame:
    """The anchors with the group of about ``size`` in which they are served: cells next to each other in the order of pivots, large cells in pieces."""
    table = settle(rows.filter(anchors).mapInPandas(_measured(held, True), _MEASURED), "anchors")
    counts = sorted((r["dim"], r["cell"], r["n"]) for r in table.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).collect())  # CELLS for each dimension
    names, pieces, turn, filled, at = {}, {}, 0, 0, None
    for dim, cell, n in counts:
        if dim != at or filled + n > size:
            turn, filled, at = turn + 1, 0, dim
        filled += n
        names[dim, cell], pieces[dim, cell] = turn, -(-n // size)
    key = lambda kept: F.element_at(F.create_map(*(F.lit(x) for (d, c), v in kept.items() for x in (f"{d}-{c}", v))), F.concat_ws("-", "dim", "cell")) if kept else F.lit(1)
    return table.withColumn("group", F.concat_ws("-", key(names), F.pmod(F.xxhash64("uid"), key(pieces)))).drop("cell", "far")


def _wanted(ranges: DataFrame, held: dict[int, Pivots], scale: int, positives: bool, home: bool):
    """For anchors (``_ANCHOR``): the blocks that might serve them, or the one of highest bound alone (home)."""
    by_dim: dict[int, list] = {}
    for r in ranges.collect():  # RANGES rows at most
        by_dim.setdefault(r["dim"], []).append(r)
    column = lambda rows, name, kind=np.float64: np.array([r[name] for r in rows], kind)
    known = {d: ([r["block"] for r in rows], column(rows, "low"), column(rows, "high"), column(rows, "norm"), column(rows, "part", np.int64), column(rows, "first", object), column(rows, "last", object), held[d].largest) for d, rows in by_dim.items()}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at, to, upper = [], [], []
            for i, r in enumerate(part.itertuples(index=False)):
                if r.dim not in known:
                    continue
                names, low, high, norm, label_part, first, last, largest = known[r.dim]
                dq, q = np.frombuffer(r.d, np.float64), np.frombuffer(r.v, np.float64)
                with np.errstate(all="ignore"):
                    qq = float((q**2).sum())
                    slack = (high + dq) * (len(q) + 1) * 2.0**-50
                    near, far = np.maximum(low - dq, dq - high) - slack, high + dq + slack
                    near = np.where(np.isfinite(near), np.maximum(near, 0), 0).max(axis=1, initial=0)
                    far = np.where(np.isfinite(far), far, np.inf).min(axis=1, initial=np.inf)
                    spare = 1e-6 * (1 + qq + largest)  # what rounding may have taken
                    most, least = (qq + largest - near**2) / 2 + spare, (qq + largest - far**2) / 2 - spare
                    size = np.sqrt(qq) * np.sqrt(norm) * (1 + 1e-6) + 1e-6
                    most = np.where(np.isnan(most), np.inf, np.fmin(most, size)) * scale * scale
                    least = np.where(np.isnan(least), -np.inf, np.fmax(least, -size)) * scale * scale
                    most, least = (np.clip(x, float(NONE), -float(NONE)) for x in (most, least))  # as scores stop
                ok = label_part == r.part if positives else (first != r.label) | (last != r.label)
                window = np.zeros(len(names), bool)
                for a, b in zip(r.least, r.most, strict=True):
                    window |= (most >= float(a)) & (least <= float(b))
                found = np.flatnonzero(ok & window)
                if home and len(found):
                    found = found[[np.argmax(most[found])]]
                at.extend([i] * len(found))
                to.extend(names[j] for j in found)
                upper.extend(most[found].tolist())
            sent = part.iloc[at].copy()
            sent["block"], sent["bound"] = to, np.array(upper, np.float64)
            yield sent

    return run


def _scores(q: np.ndarray, c: np.ndarray, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the anchor, its scores with all candidates as integers)."""
    if q.shape[1] <= 512 and max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) <= EXACT / scale:
        scaled = np.ascontiguousarray((c * scale).T)
        for at in range(0, len(q), TOGETHER):
            for i, row in enumerate((q[at : at + TOGETHER] * scale) @ scaled):
                yield at + i, row.astype(np.int64)
    else:
        exact, everyone = Scores(c, scale), np.arange(len(c))
        for i in range(len(q)):
            yield i, exact(everyone, q[i])


_FOUND = "uid long, turn int, vec_id long, score long"


def join_block(anchors: pd.DataFrame, candidates: pd.DataFrame, k: int, scale: int, positives: bool) -> pd.DataFrame:
    """For each anchor and each of its windows [least, most] the k best candidates of a block: of the same label and not itself, or of another label."""
    out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    if len(anchors) and len(candidates):
        candidates = candidates.sort_values("vec_id", kind="stable")
        ids, uids = candidates["vec_id"].to_numpy(np.int64), candidates["uid"].to_numpy(np.int64)
        codes = pd.factorize(pd.concat([anchors["label"], candidates["label"]], ignore_index=True))[0]
        own_codes, codes = codes[: len(anchors)], codes[len(anchors) :]
        own_uids, least, most = anchors["uid"].to_numpy(np.int64), anchors["least"].tolist(), anchors["most"].tolist()
        for i, score in _scores(_matrix(anchors["v"]), _matrix(candidates["v"]), scale):
            live = (codes == own_codes[i]) & (uids != own_uids[i]) if positives else codes != own_codes[i]
            live = np.flatnonzero(live & (score >= min(least[i])) & (score <= max(most[i])))
            order = live[np.argsort(~score[live], kind="stable")]  # ids ascend already
            falling = ~score[order]
            for turn, (a, b) in enumerate(zip(least[i], most[i], strict=True)):
                first, end = np.searchsorted(falling, ~np.int64(b), "left"), np.searchsorted(falling, ~np.int64(a), "right")
                part = order[first : min(end, first + k)]
                if len(part):
                    out.append((own_uids[i], turn, ids[part], score[part]))
    sizes = [len(x[2]) for x in out]
    joined = lambda j: np.concatenate([np.empty(0, np.int64), *(x[j] for x in out)])
    repeated = lambda j: np.repeat(np.array([x[j] for x in out], np.int64), sizes)
    return pd.DataFrame({"uid": repeated(0), "turn": repeated(1).astype(np.int32), "vec_id": joined(2), "score": joined(3)})


class Join:
    """The blocks and the bounds that both searches use."""

    def __init__(self, table: DataFrame, held: dict[int, Pivots], scale: int, ranges_block: int = RANGES) -> None:
        self.table, self.held, self.scale = table, held, scale
        self.ranges = settle(partition_bounds(table), "partition-bounds")
        self.parts, self.ranges_block = max(1, -(-self.ranges.count() // ranges_block)), ranges_block

    def _sent(self, anchors: DataFrame, positives: bool, home: bool) -> Iterator[DataFrame]:
        for part in range(self.parts):
            own = self.ranges if self.parts == 1 else self.ranges.filter(F.pmod(F.xxhash64("block"), F.lit(self.parts)) == part)
            yield settle(anchors.mapInPandas(_wanted(own, self.held, self.scale, positives, home), f"{_ANCHOR}, block string, bound double"), "sent-anchors")

    def _met(self, sent: DataFrame, k: int, positives: bool) -> DataFrame:
        """Blocks are replicated to the groups that wait for them, and searched there."""
        keys, scale = ("block", "group"), self.scale
        serves = few(sent.select(*keys).distinct())
        right = self.table.join(serves, "block").select("uid", "vec_id", "label", "v", *keys)
        left = sent.select("uid", "label", "v", "least", "most", *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: join_block(a, b, k, scale, positives), _FOUND)

    def search(self, anchors: DataFrame, k: int, positives: bool) -> DataFrame:
        """For each anchor and window the k best of all candidates: uid, turn, rank, vec_id, score."""
        names = [x.split(" ")[0] for x in _ANCHOR.split(", ")]
        anchors = settle(anchors.select(*names), "asking-anchors")
        homes = [*self._sent(anchors, positives, True)]
        first = homes[0]
        for more in homes[1:]:
            first = first.unionByName(more)
        best = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("bound"), "block"))
        home = settle(first.withColumn("rank", best).filter(F.col("rank") == 1).drop("rank", "bound"), "home-blocks")
        near = settle(self._met(home, k, positives), "home-found")
        # A window with k candidates at home takes no score below the last of them any more.
        full = near.groupBy("uid", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).filter(F.col("n") == k)
        raised = full.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("turn", "score"))).alias("raised"))
        own = home.select("uid", F.col("block").alias("home"))
        to = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.element_at("raised", i), F.lit(NONE))))
        again = settle(anchors.join(raised, "uid", "left").withColumn("least", F.when(F.col("raised").isNull(), F.col("least")).otherwise(to)).select(*names), "asking-again")
        found = near
        for sent in self._sent(again, positives, False):
            rest = sent.join(own, "uid", "left").filter(~F.col("block").eqNullSafe(F.col("home"))).drop("home", "bound")
            found = found.unionByName(self._met(settle(rest, "replicated"), k, positives))
        rank = F.row_number().over(Window.partitionBy("uid", "turn").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("uid", "turn", "rank", "vec_id", "score")


def _share(score: str, percent: int, more: int) -> Column:
    """floor((percent * score + more) / 100): hundreds and the rest are taken apart, so nothing goes beyond 64 bits."""
    return F.expr(f"{percent} * ({score} div 100 - if({score} % 100 < 0, 1, 0)) + ({percent} * pmod({score}, 100) + {more}) div 100")


def mine(
    vectors: DataFrame, anchors: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP, ranges_block: int = RANGES,
) -> DataFrame:
    """For the rows that the condition ``anchors`` on vec_id selects: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = settle(_rows(vectors, id_col, vector_col, label_col, scale), "labelled-vectors")
    held = _pivots(rows, pivots)
    join = Join(voronoi(rows, held, block), held, scale, ranges_block)
    asking = settle(anchor_groups(rows, held, anchors, group), "anchor-groups")
    every = lambda x: F.array(F.lit(x).cast("long"))
    best = settle(join.search(asking.withColumns({"least": every(NONE), "most": every(-1 - NONE)}), positives, True), "positives")
    bounded = best.withColumns({"least": _share("score", low, 99), "most": _share("score", high, 0)})
    windows = bounded.filter("least <= most").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "least", "most"))).alias("w"))
    windows = windows.select("uid", F.col("w.rank").alias("turns"), F.col("w.least").alias("least"), F.col("w.most").alias("most"))
    found = join.search(asking.join(windows, "uid"), negatives, False)
    turned = found.join(windows.select("uid", "turns"), "uid").select("uid", F.element_at("turns", F.col("turn") + 1).alias("turn"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    told = best.select("uid", F.col("rank").alias("turn"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = asking.select("uid", F.col("vec_id").alias("anchor_id"))
    return turned.join(told, ["uid", "turn"]).join(names, "uid").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(vectors.withColumn("label", label), "vec_id % 100 = 0")


SQL = {
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id),
             p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
    """
}
