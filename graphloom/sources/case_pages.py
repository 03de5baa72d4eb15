"""Fields of the pages of court opinions, from one pass over a page's markup, whatever its form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from graphloom import dictionaries as d
from graphloom.functions import text as tx

_BLOCKS = frozenset(("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "br", "section", "article", "main", "body", "title", "ul", "ol", "table", "blockquote", "dt", "dd"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4"))
_UNSEEN, _ASIDE = frozenset(("script", "style")), frozenset(("script", "style", "nav", "header", "footer", "aside", "form"))
_VOID = frozenset(("br", "meta", "link", "img", "hr", "input", "area", "base", "col", "embed", "source", "track", "wbr"))


class _Reader(HTMLParser):
    """Blocks of text in order, each with its tag, whether it lies aside, and whether in the main part; open elements are the context. An end tag closes what was left open within it."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, bool]] = []
        self.said: list[str] = []
        self.blocks: list[tuple[str, str, bool, bool]] = []
        self.titles: dict[str, str] = {}
        self.canonical = ""

    def flush(self) -> None:
        text = " ".join("".join(self.said).split())
        self.said = []
        if text:
            tags = [t for t, _ in self.open]
            tag = next((t for t in reversed(tags) if t in _BLOCKS), "")
            self.titles.setdefault(tag, text)
            if tag != "title":
                self.blocks.append((tag, text, any(t in _ASIDE for t in tags), any(m for _, m in self.open)))

    def handle_starttag(self, tag, attrs) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in _BLOCKS:
            self.flush()
        if tag == "meta" and given.get("property") == "og:title":
            self.titles.setdefault("meta", given.get("content", "").strip())
        elif tag == "link" and "canonical" in given.get("rel", "").split():
            self.canonical = self.canonical or given.get("href", "")
        if tag not in _VOID:
            main = tag in ("div", "article", "main") and bool(re.search(r"case-text|opinion-text|case-content", given.get("class", "")) or re.search(r"case-text|opinion|content", given.get("id", "")) or given.get("role") == "main")
            self.open.append((tag, main))

    def handle_endtag(self, tag) -> None:
        if tag in _BLOCKS:
            self.flush()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data) -> None:
        if not any(t in _UNSEEN for t, _ in self.open):
            self.said.append(data)


def _first(patterns, text: str) -> str | None:
    for pattern in patterns:
        found = re.search(pattern, text)
        if found:
            return " ".join(found[1].split())
    return None


def case_page(html: str | None, least: int = 100) -> dict | None:
    """name, court, date (as it stands), docket, citation, judges, summary, body; None for a page whose text is shorter than ``least``."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    blocks = reader.blocks
    text = "\n".join(t for _, t, _, _ in blocks)
    main = [b for b in blocks if b[3]] or blocks
    body = "\n\n".join(t for _, t, aside, _ in main if not aside and len(t) > 10)
    if len(body) < least:
        return None
    heading = re.sub(r"\s*(?:::|\|).*$", "", reader.titles.get("h1", ""))
    title = re.sub(r"\s*[-|].*$", "", reader.titles.get("title", ""))
    name = heading if len(heading) > 5 else reader.titles.get("meta") or (title if len(title) > 5 else None)
    docket = next((x for x in (_first([p], text[:3000]) for p in d.PAGE_DOCKETS) if x and re.fullmatch(r"(?i)[A-Z0-9\-/]{3,}", x)), None)
    cited = re.search(d.PAGE_CITATION, reader.canonical)
    citation = cited[1].upper() if cited else _first([r"(?i)\b(\d{4}\s+NY\s+Slip\s+Op\s+\d+)"], text)
    judges = list(dict.fromkeys(m[1].strip() for p in d.PAGE_JUDGES for m in re.finditer(p, text[:5000])))
    return {"name": name, "court": _first(d.PAGE_COURTS, text), "date": _first(d.PAGE_DATES[:1], text) or _first(d.PAGE_DATES[1:], text[:2000]), "docket": docket, "citation": citation, "judges": judges, "summary": _summary(blocks), "body": body}


def _summary(blocks: list[tuple[str, str, bool, bool]]) -> str | None:
    """What follows a heading of summaries up to the next heading, some thousand characters of it."""
    for i, (_, text, _, _) in enumerate(blocks):
        if re.search(d.PAGE_SUMMARIES, text):
            said: list[str] = []
            for tag, more, _, _ in blocks[i + 1 :]:
                if tag in _HEADINGS or len(" ".join(said)) > 1000:
                    break
                said.append(more)
            if len(" ".join(said)) > 50:
                return " ".join(said)
    return None


_FIELDS = "name string, court string, date string, docket string, citation string, judges array<string>, summary string, body string"


def parsed(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, name, court, date (ISO where it can be read), docket, citation, judges, summary, body: one row for each page with a text."""
    kind = pages.schema[key].dataType.simpleString()
    names = [f.split(" ")[0] for f in _FIELDS.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, x) for k, x in zip(part[key], map(case_page, part[html]), strict=True) if x is not None]
            yield pd.DataFrame({key: pd.Series([k for k, _ in found], dtype=part[key].dtype), **{n: pd.Series([x[n] for _, x in found], dtype="object") for n in names}})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, {_FIELDS}").withColumn("date", tx.normal_date("date"))
