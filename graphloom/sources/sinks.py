"""Where results go: tables, reports as JSON, CSV or HTML, an archive of texts by hash."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def write_report(report: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines, or CSV with a header and nested columns as JSON."""
    if form == "csv":
        nested = [f.name for f in report.schema if f.dataType.typeName() in ("array", "struct", "map")]
        report = report.withColumns({c: F.to_json(c) for c in nested}) if nested else report
        report.write.mode("overwrite").option("header", "true").csv(path)
    elif form == "json":
        report.write.mode("overwrite").json(path)
    elif form == "html":
        _html(report).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no report of form {form}")


def _html(report: DataFrame) -> DataFrame:
    """The lines of a page with one table, escaped: head, a line for each row, end; one file, as a report is made to be read."""
    shown = lambda f: F.to_json(f"`{f.name}`") if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`").cast("string")
    cells = [F.concat(F.lit("<td>"), tx.escape_html(F.coalesce(shown(f), F.lit(""))), F.lit("</td>")) for f in report.schema]
    names = "".join(f"<th>{escape(f.name)}</th>" for f in report.schema)
    line = lambda at, text: report.sparkSession.range(1).select(F.lit(at).alias("at"), F.lit(text).alias("value"))
    body = report.select(F.lit(1).alias("at"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))
    lines = line(0, f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body><table><tr>{names}</tr>").unionByName(body).unionByName(line(2, "</table></body></html>"))
    return lines.coalesce(1).sortWithinPartitions("at", "value").select("value")


def write_entities_and_vectors(entities: DataFrame, path: str) -> None:
    """Entities, and their vectors under `entity:id`, as two tables."""
    entities.drop("embedding").write.mode("overwrite").parquet(f"{path}/entities")
    entities.filter("embedding is not null").select(F.concat(F.lit("entity:"), "id").alias("id"), "embedding").write.mode("overwrite").parquet(f"{path}/entity_vectors")


def archive(texts: DataFrame, path: str) -> None:
    """Canonical texts by hash, once each, partitioned by its first two digits."""
    held = texts.select(tx.sha(tx.canonical("text")).alias("sha256"), tx.canonical("text").alias("text")).dropDuplicates(["sha256"])
    held.withColumn("part", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("part").parquet(path)
