"""The graph's tables in a folder: creation, reading, rewriting, reset, statistics, migrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom import schemas
from graphloom.functions import text as tx


#: How tables lie: folders by a column that queries fix (few values), and the order within a file, whose statistics let a scan for one value skip the rest.
LAYOUT = {"entities": ("type", ("id",)), "edges": ("type", ("src", "dst")), "chunks": (None, ("source_id", "chunk_index")), "provenance": ("subject_type", ("subject_id",)), "quotes": (None, ("source_id", "start_offset")), "sources": (None, ("locator",))}


class Store:
    """Parquet tables under a path, laid out for their lookups; a rewrite goes to a new version, so that a table may be rewritten from itself."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        # A version counts once its writer has left the mark of success.
        names = [s.getPath().getName() for s in fs.listStatus(root) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(n[1:]) for n in names if n.startswith("v"))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], schemas.struct(schemas.TABLES[name]))
        return self.spark.read.schema(schemas.struct(schemas.TABLES[name])).parquet(f"{self.path}/{name}/v{versions[-1]}")

    def write(self, name: str, rows: DataFrame) -> None:
        """The table's new contents; columns that are missing are null."""
        fields = schemas.struct(schemas.TABLES[name])
        held = rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        folder, order = LAYOUT.get(name, (None, ()))
        if order:  # ranges, so that a frequent value takes several files and a rare one few
            keys = [*([folder] if folder else []), *order]
            held = held.repartitionByRange(*keys).sortWithinPartitions(*keys)
        writer = held.write.mode("overwrite")
        (writer.partitionBy(folder) if folder else writer).parquet(f"{self.path}/{name}/v{(self._versions(name) or [0])[-1] + 1}")

    def reset(self, *names: str) -> None:
        for name in names or schemas.TABLES:
            root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            root.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(root, True)

    def statistics(self) -> DataFrame:
        from graphloom.operators.audit import table_counts

        return table_counts({name: self.read(name) for name in schemas.TABLES})


def migrate_types(entities: DataFrame) -> DataFrame:
    """Types by value where they are stored by name; unknown ones stay."""
    return entities.withColumn("type", F.coalesce(tx.by_name("type", d.ENTITY_TYPES), F.col("type")))


def prune_attributes(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes without the given keys and without empty values."""
    return entities.withColumn("attributes", F.map_filter("attributes", lambda k, v: ~k.isin(*keys) & (F.coalesce(v, F.lit("")) != "")))


def backfill(cases: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Case documents with the outcome of linked outcomes (id, outcome) where they have none."""
    first = outcomes.groupBy("id").agg(F.min("outcome").alias("found"))
    return cases.join(first, "id", "left").withColumn("outcome", F.coalesce(F.nullif("outcome", F.lit("")), "found")).drop("found")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file: nodes with a map of their data, edges with theirs."""
    lines = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("x"))

    def data(body: Column) -> Column:
        each = F.regexp_extract_all(body, F.lit(r"(?s)<data key=\"[^\"]+\">.*?</data>"), F.lit(0))
        return F.map_from_entries(F.transform(each, lambda e: F.struct(F.regexp_extract(e, 'key="([^"]+)"', 1), F.regexp_extract(e, r"(?s)>(.*)</data>", 1))))

    nodes = lines.select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<node id=\"[^\"]+\".*?</node>"), F.lit(0))).alias("n"))
    links = lines.select(F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<edge [^>]*>.*?</edge>"), F.lit(0))).alias("e"))
    return (
        nodes.select(F.regexp_extract("n", 'id="([^"]+)"', 1).alias("id"), data(F.col("n")).alias("data")),
        links.select(F.regexp_extract("e", 'source="([^"]+)"', 1).alias("src"), F.regexp_extract("e", 'target="([^"]+)"', 1).alias("dst"), data(F.col("e")).alias("data")),
    )
