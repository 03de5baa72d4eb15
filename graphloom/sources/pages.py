"""Web pages: fields of case pages, links, and links to resources with the heading they stand under."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, heading, lang, paragraphs and body (the article's markup)."""
    one = lambda p: F.regexp_extract(html, p, 1)
    return pages.withColumns({"title": one(r"(?s)<title>(.*?)</title>"), "heading": one(r"(?s)<h1>(.*?)</h1>"), "lang": one(r'lang="([a-z]+)"'), "paragraphs": F.regexp_count(html, F.lit("<p>")).cast("long"), "body": one(r"(?s)<article>(.*?)</article>")})


def links(pages: DataFrame, base: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, link, place: links of a page made absolute, once each, with the place of the first."""
    each = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit('href="(/[^"]*)"'), F.lit(1))).alias("pos", "href"))
    return each.groupBy(key, F.concat(F.lit(base), "href").alias("link")).agg(F.min("pos").alias("place"))


class _Links(HTMLParser):
    """Links with the last heading before them; those in navigation do not count."""

    def __init__(self, skip: tuple[str, ...]) -> None:
        super().__init__()
        self.skip = skip
        self.inside, self.heading, self.open, self.href, self.said, self.found = 0, "", False, None, [], []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.skip:
            self.inside += 1
        elif tag in ("h1", "h2", "h3", "h4"):
            self.open, self.said = True, []
        elif tag == "a":
            self.href, self.said = dict(attrs).get("href"), []

    def handle_endtag(self, tag) -> None:
        text = " ".join("".join(self.said).split())
        if tag in self.skip:
            self.inside = max(0, self.inside - 1)
        elif tag in ("h1", "h2", "h3", "h4") and self.open:
            self.open, self.heading = False, text
        elif tag == "a" and self.href is not None:
            if not self.inside and not self.href.startswith(("mailto:", "javascript:", "#")):
                self.found.append((self.href, text, self.heading))
            self.href = None

    def handle_data(self, data) -> None:
        self.said.append(data)


def resource_links(pages: DataFrame, key: str = "page_id", html: str = "html", skip: tuple[str, ...] = ("nav", "header", "footer", "aside")) -> DataFrame:
    """key, href, label, category: links outside the elements to skip, the heading above them as category, the first of each address."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, text in zip(batch[key], batch[html], strict=True):
                parser = _Links(skip)
                parser.feed(text or "")
                seen = set()
                for href, label, category in parser.found:
                    if href not in seen:
                        seen.add(href)
                        rows.append((page, href, label, category))
            yield pd.DataFrame(rows, columns=[key, "href", "label", "category"])

    return pages.select(key, html).mapInPandas(run, f"{key} long, href string, label string, category string")
