"""Results of outside searches as rows: limits, filters, and their form as manifest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx


def clamp(n: Column, low: int = 1, high: int = 1000) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), n))


def within_years(results: DataFrame, first: int | None, last: int | None, url: str = "url") -> DataFrame:
    """Results whose URL names a year in the range, or none."""
    year, kept = tx.url_year(url), F.lit(True)
    if first is not None:
        kept = kept & (year >= first)
    if last is not None:
        kept = kept & (year <= last)
    return results.filter(F.coalesce(kept, F.lit(True)))


def to_manifest(results: DataFrame) -> DataFrame:
    """Results (url, title) with the columns of a manifest entry."""
    return results.withColumns({"locator": F.col("url"), "kind": F.lit("URL"), "document_type": F.lit("COURT_OPINION"), "authority": F.lit("BINDING_LEGAL_AUTHORITY")})
