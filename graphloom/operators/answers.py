"""Answers of a model in sections: headers switch the section, marked lines are items, others run on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.functions import text as tx

ITEM = r"^\s*(?:[-*•]|[0-9]+\.|\([0-9]+\)|[0-9]+\))\s+(.*)$"


def sections(answers: DataFrame, headers: Sequence[tuple[str, Sequence[str]]] = d.SECTION_HEADERS) -> DataFrame:
    """key, section, items, text: the items of each section in order, and its other lines as one text. Table: key, text."""
    lines = answers.select("key", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(tx.strip("line") != "")
    named = lines.withColumn("header", tx.section_of(F.col("line"), headers))
    current = F.last("header", ignorenulls=True).over(Window.partitionBy("key").orderBy("i"))
    held = named.withColumn("section", current).filter("header is null and section is not null").withColumn("item", F.nullif(F.regexp_extract("line", ITEM, 1), F.lit("")))
    ordered = lambda v: F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("i", v.alias("v"))))), lambda x: x["v"])
    return held.groupBy("key", "section").agg(ordered(F.col("item")).alias("items"), F.array_join(ordered(F.when(F.col("item").isNull(), tx.strip("line"))), " ").alias("text"))
