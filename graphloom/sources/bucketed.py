"""Tables that grow by small changes: rows in buckets by the hash of their key, of which a change rewrites its own alone.

A version is a manifest: which folder holds each bucket. A change reads the buckets
that its keys fall in, writes their new contents to a folder of its own, and
then adds the next manifest, which is what readers look for. Until that stands they see the old
version, whatever has been written; files of other buckets are never touched. A change with
a name (batch) is applied once, however often it is run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.operators import dedup
from graphloom.operators.graph import first_per
from graphloom.storage import settled

#: Names of changes that a manifest remembers.
REMEMBERED = 1000


class BucketedTable:
    """A table (``schema`` as DDL) with a unique key of some columns, in a folder; ``buckets`` must stay as it was made with."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schemas.struct(schema), buckets

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        place, fs = self._place(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def manifest(self) -> dict:
        """The newest one that is whole: version, buckets (number to folder), batches."""
        for name in reversed([n for n in self._names("manifests") if n.endswith(".json")]):
            text = self.spark.read.text(f"{self.path}/manifests/{name}", wholetext=True).first()
            try:
                return json.loads(text.value) if text else {}
            except ValueError:  # its writer died over it
                continue
        return {"version": 0, "buckets": {}, "batches": []}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        held = self.manifest()["buckets"]
        places = [f"{self.path}/{place}" for b, place in held.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        keys = settled(keys.select(*self.key).distinct(), "looked-up-keys")
        return self.read(self._touched(keys)).join(keys, self.key, "left_semi")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` at most

    def rewrite(self, keys: DataFrame, how: Callable[[DataFrame], DataFrame], batch: str | None = None) -> int:
        """The buckets of ``keys`` become ``how`` of what they hold; its rows must fall in the same buckets. Gives the version."""
        held = self.manifest()
        if batch is not None and batch in held["batches"]:
            return held["version"]
        touched = self._touched(keys)
        if not touched:
            return held["version"]
        taken = [int(n[1:]) for n in self._names("data")]
        version, folder = held["version"] + 1, f"data/v{max([held['version'], *taken]) + 1:08}"
        rows = how(self.read(touched)).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        rows = rows.withColumn("the bucket", self._bucket())
        rows.repartition(len(touched), "the bucket").sortWithinPartitions("the bucket", *self.key).write.partitionBy("the bucket").parquet(f"{self.path}/{folder}")
        written = {n.split("=")[1]: f"{folder}/{n}" for n in self._names(folder) if n.startswith("the bucket=")}
        if not {int(b) for b in written} <= set(touched):
            raise ValueError("a change may not move rows to buckets that it didn't read")
        left = {b: place for b, place in held["buckets"].items() if int(b) not in touched}
        told = {"version": version, "buckets": left | written, "batches": [*held["batches"], *([batch] if batch is not None else [])][-REMEMBERED:]}
        place, fs = self._place(f"{self.path}/manifests/{version:08}.json")
        out = fs.create(place, False)  # another writer's manifest of this version is an error
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        return version

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: str | None = None) -> int:
        """Changes (rows of the table) merged into what their buckets hold."""
        names = [F.col(f"`{f.name}`") if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        changes = settled(changes.select(*names), "changes")
        return self.rewrite(changes, lambda held: how(held, changes), batch)

    def insert_absent(self, rows: DataFrame, batch: str | None = None) -> int:
        """Rows whose key the table doesn't have, the first of each key in the order of its other columns."""
        return self.merge(rows, lambda held, new: held.unionByName(self._first(new).join(held, self.key, "left_anti")), batch)

    def patch(self, rows: DataFrame, batch: str | None = None) -> int:
        """Rows whose key the table has change the columns that they give; the others are added."""

        def how(held: DataFrame, new: DataFrame) -> DataFrame:
            fields = [f.name for f in self.schema if f.name not in self.key]
            named = self._first(new).select(*self.key, *(F.col(f"`{c}`").alias(f"new {c}") for c in fields), F.lit(True).alias("the change"))
            met = held.withColumn("the row", F.lit(True)).join(named, self.key, "full")
            return met.select(*self.key, *(F.coalesce(f"`new {c}`", f"`{c}`").alias(c) for c in fields))

        return self.merge(rows, how, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> int:
        keys = settled(keys.select(*self.key).distinct(), "deleted-keys")
        return self.rewrite(keys, lambda held: held.join(keys, self.key, "left_anti"), batch)

    def merge_entities(self, moved: DataFrame, batch: str | None = None) -> int:
        """Entities that are the same become one (moved: old, new), as ``dedup.merged`` makes them of all their columns; only buckets of either end are rewritten."""
        moved = settled(moved.select("old", "new"), "moved")
        ends = moved.select(F.explode(F.array("old", "new")).alias("id")).distinct()

        def how(held: DataFrame) -> DataFrame:
            return held.join(ends, "id", "left_anti").unionByName(dedup.merged(held.join(ends, "id", "left_semi"), moved).drop("members"))

        return self.rewrite(ends, how, batch)

    def _first(self, rows: DataFrame) -> DataFrame:
        others = [F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in self.schema if f.name not in self.key)))] if len(self.schema) > len(self.key) else [F.lit(0)]
        return first_per(rows, self.key, others).drop("rank")


def insert_edges(edges: BucketedTable, entities: BucketedTable, new: DataFrame, batch: str | None = None) -> int:
    """Edges (src, dst, type) whose ends the entities have, where they are absent; of the entities only the buckets of these ends are read."""
    new = settled(new.select("src", "dst", "type").dropDuplicates(), "new-edges")
    known = settled(entities.lookup(new.select(F.explode(F.array("src", "dst")).alias("id"))).select("id"), "known-ends")
    sound = new.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.insert_absent(sound, batch)
