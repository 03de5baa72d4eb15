"""Manifests: lists of sources as JSON lines, their checks, metadata, order and merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx

SCHEMA = "locator string, kind string, title string, jurisdiction string, authority string, document_type string, organization string, tags string, notes string, metadata struct<court:string,decision_date:string,citation:string,case_number:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file and number of every line of a file or folder."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("number"))


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected): blank lines are skipped; malformed JSON and entries without a locator are rejected."""
    kept = lines.filter(tx.strip("line") != "").withColumn("sound", F.try_parse_json("line").isNotNull()).withColumn("e", F.when(F.col("sound"), F.from_json("line", SCHEMA)))
    good = F.coalesce(F.col("sound") & (F.coalesce(F.col("e.locator"), F.lit("")) != ""), F.lit(False))
    carried = [c for c in lines.columns if c != "line"]
    return kept.filter(good).select(*carried, "e.*"), kept.filter(~good).select(*carried, "line", F.when(F.col("sound"), "no locator").otherwise("malformed").alias("reason"))


def counts(lines: DataFrame) -> DataFrame:
    """file, valid, invalid."""
    entries, rejected = parse(lines)
    both = entries.select("file", F.lit(1).alias("v"), F.lit(0).alias("i")).unionByName(rejected.select("file", F.lit(0).alias("v"), F.lit(1).alias("i")))
    return both.groupBy("file").agg(F.sum("v").alias("valid"), F.sum("i").alias("invalid"))


def processing_order(manifests: DataFrame) -> DataFrame:
    """Adds position: statutes, guides, cases, others; then by name."""
    low = F.lower("name")
    group = F.when(low.contains("statute"), 0).when(low.contains("guide"), 1).when(low.contains("case"), 2).otherwise(3)
    return manifests.withColumn("position", F.row_number().over(Window.orderBy(group, "name")))


def from_stored(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """locator, title: URLs of stored sources and of entities, the former first, http(s) only, once each."""
    both = sources.select("locator", "title", F.lit(0).alias("p")).unionByName(entities.select("locator", "title", F.lit(1).alias("p"))).filter(F.col("locator").rlike("^https?://"))
    first = F.row_number().over(Window.partitionBy("locator").orderBy("p", "title"))
    return both.withColumn("r", first).filter("r = 1").select("locator", "title")


def enrich(entries: DataFrame, patterns: Sequence[tuple[str, Mapping]] = d.URL_PATTERNS) -> DataFrame:
    """Missing fields from the URL; tags of both, sorted, once each (tags: array)."""
    out = entries
    for field in ("authority", "document_type", "jurisdiction", "organization"):
        out = out.withColumn(field, F.coalesce(F.nullif(F.col(field), F.lit("")), tx.url_metadata("locator", field, patterns)))
    found = F.coalesce(tx.url_metadata("locator", "tags", patterns), F.array().cast("array<string>"))
    return out.withColumn("tags", F.array_sort(F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), found))))


def warnings(entries: DataFrame, *fields: str) -> DataFrame:
    """Adds warnings: the fields that are missing."""
    return entries.withColumn("warnings", F.filter(F.array(*(F.when(F.coalesce(F.col(f), F.lit("")) == "", F.lit(f"missing {f}")) for f in fields)), lambda x: x.isNotNull()))


def mark_known(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Adds known: whether the locator is there already."""
    held = known.select("locator").distinct().withColumn("held", F.lit(True))
    return entries.join(held, "locator", "left").withColumn("known", F.coalesce("held", F.lit(False))).drop("held")


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """A manifest with new entries in place of old ones of the same locator."""
    return old.join(new.select("locator").distinct(), "locator", "left_anti").unionByName(new.dropDuplicates(["locator"]))


def source_metadata(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, rejected): authorities by name, source type by kind; entries without a known document type are rejected."""
    kind = F.lower("kind")
    held = entries.select("locator", F.when(kind == "url", "url").when(kind.isin("file", "local_file"), "file").when(kind == "internal", "internal").otherwise("manual").alias("source_type"), F.coalesce(tx.by_name("authority", d.AUTHORITIES), F.lit("informational_only")).alias("authority"), tx.by_name("document_type", d.DOCUMENT_TYPES).alias("document_type"))
    return held.filter("document_type is not null"), held.filter("document_type is null")
