"""A stored inverted file over vectors: cells, codes of residuals, and an exact second look.

Cells are trained on a bounded sample. Every vector goes to the cell of its nearest centre
and keeps what it differs by, as one byte a component. A query looks into the cells
nearest to it, ranks what is there by the codes, and ranks the best of that anew
by the vectors themselves. Files lie by cell, so cells that no query wants are not read, and
vectors are read for the short list only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import settled

from . import vectors as vec
from .graph import first_per

#: Rows that cells are trained on, rounds of the training, most cells; rows of a cell and queries that meet, queries that are scored together.
SAMPLE, ROUNDS, CELLS, PIECE, QUERIES, TOGETHER = 20_000, 12, 4096, 50_000, 4096, 256
#: The share of the cells that a query looks into, and how many times k are ranked anew.
PROBED, AGAIN = 0.6, 6


def _unit(rows) -> np.ndarray:
    matrix = np.array([np.asarray(r, np.float64) for r in rows])
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def trained_centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of unit vectors by their cosine, from the sample's own first rows; an empty cell takes the row that lies worst."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = sample @ centres.T
        own, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
    return centres


@dataclass
class InvertedFile:
    spark: SparkSession
    path: str
    centres: np.ndarray
    #: The size of a residual's component that a code of 127 stands for.
    step: np.ndarray

    @staticmethod
    def write(rows: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> InvertedFile:
        """Of vectors (id, embedding) of one dimension; rows without a vector are left out. Every row is indexed."""
        rows = rows.select("id", "embedding").filter("embedding is not null and size(embedding) > 0")
        total = rows.count()
        some = [r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]  # bounded
        cells = max(1, min(cells or round(total**0.5), CELLS, len(some)))
        unit = _unit(some) if some else np.zeros((1, 1))
        centres = trained_centres(unit, cells)
        apart = np.abs(unit - centres[(unit @ centres.T).argmax(axis=1)])
        step = np.maximum(np.quantile(apart, 0.995, axis=0), 1e-9) / 127

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                held = _unit(part["embedding"]) if len(part) else np.zeros((0, centres.shape[1]))
                own = (held @ centres.T).argmax(axis=1)
                codes = np.clip(np.rint((held - centres[own]) / step), -127, 127).astype(np.int8)
                yield pd.DataFrame({"id": part["id"], "cell": own.astype(np.int32), "code": [c.tobytes() for c in codes], "embedding": part["embedding"]})

        kind = {f.name: f.dataType.simpleString() for f in rows.schema}
        coded = rows.mapInPandas(run, f"id {kind['id']}, cell int, code binary, embedding {kind['embedding']}")
        # A cell may hold a third of all rows: pieces by id.
        dealt = settled(coded, "coded-vectors")
        sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE)).cast("int").alias("pieces"))
        placed = dealt.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
        placed.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "id").write.mode("overwrite").partitionBy("cell", "piece").parquet(f"{path}/cells")
        about = json.dumps({"centres": centres.tolist(), "step": step.tolist()})
        rows.sparkSession.range(1).select(F.lit(about).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return InvertedFile(rows.sparkSession, path, centres, step)

    @staticmethod
    def open(spark: SparkSession, path: str) -> InvertedFile:
        about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first().value)
        return InvertedFile(spark, path, np.array(about["centres"]), np.array(about["step"]))

    def probes(self, queries: DataFrame, probed: float) -> DataFrame:
        """query_id, q (the unit vector, packed), cell: the cells that each query (query_id, embedding) looks into."""
        centres, n = self.centres, max(1, round(probed * len(self.centres)))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    held = _unit(part["embedding"])
                    near = np.argsort(-(held @ centres.T), axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), n), "q": [q.tobytes() for q in held for _ in range(n)], "cell": near.reshape(-1).astype(np.int32)})

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", "embedding").filter("embedding is not null and size(embedding) > 0")
        return asked.mapInPandas(run, f"query_id {kind}, q binary, cell int")

    def candidates(self, queries: DataFrame, n: int, probed: float = PROBED) -> DataFrame:
        """query_id, id, cell, piece, scored: the ``n`` that the codes rank first of each query; scored is how many the codes were read of, at one of them in each piece."""
        centres, step = self.centres, self.step
        asked = settled(self.probes(queries, probed), "probes")
        cells = [r.cell for r in asked.select("cell").distinct().collect()]  # CELLS at most
        held = self.spark.read.parquet(f"{self.path}/cells")
        held = held.filter(F.col("cell").isin(cells)).select("id", "code", "cell", "piece") if cells else held.filter("false").select("id", "code", "cell", "piece")
        pieces = F.broadcast(settled(held.select("cell", "piece").distinct(), "pieces"))  # folders, CELLS and a few more
        loads = F.broadcast(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("parts")))
        left = asked.join(loads, "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts").join(pieces, "cell")
        right = held.join(loads, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out: list[tuple] = []
            if len(a) and len(b):
                q = np.frombuffer(b"".join(a["q"]), np.float64).reshape(len(a), -1)
                codes = np.frombuffer(b"".join(b["code"]), np.int8).reshape(len(b), -1).astype(np.float32)
                own, scaled = q @ centres[int(key[0])], (q * step).astype(np.float32)
                for at in range(0, len(q), TOGETHER):
                    for i, score in enumerate(scaled[at : at + TOGETHER] @ codes.T, at):
                        top = np.argpartition(-score, n - 1)[:n] if len(score) > n else np.arange(len(score))
                        out.append((np.full(len(top), i), top, own[i] + score[top], np.where(np.arange(len(top)) == 0, len(score), 0)))
            joined = lambda j, kind: np.concatenate([np.empty(0, kind), *(x[j].astype(kind) for x in out)])
            found = pd.DataFrame({"query_id": a["query_id"].to_numpy()[joined(0, int)], "id": b["id"].to_numpy()[joined(1, int)], "score": joined(2, float), "scored": joined(3, int)})
            return found.assign(cell=int(key[0]), piece=int(key[1]))

        kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *held.schema)}
        keys = ("cell", "piece", "part")
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double, scored long, cell int, piece int")
        return settled(found, "coded-candidates")

    def search(self, queries: DataFrame, k: int = 10, probed: float = PROBED, again: int = AGAIN) -> DataFrame:
        """query_id, id, score, rank: the ``k`` of highest cosine found for each query (query_id, embedding), ties to the smaller id."""
        near = first_per(self.candidates(queries, k * again, probed), ["query_id"], [F.desc("score"), "id"], k * again).select("query_id", "id", "cell", "piece")
        held = self.spark.read.parquet(f"{self.path}/cells").select("id", "cell", "piece", F.col("embedding").alias("y"))
        met = near.join(held, ["cell", "piece", "id"]).join(queries.select("query_id", F.col("embedding").alias("x")), "query_id")
        scored = met.select("query_id", "id", vec.cosine("x", "y").alias("score"))
        return first_per(scored, ["query_id"], [F.desc(F.round("score", 9)), "id"], k)
