"""Text as column expressions: normal forms, identifiers, tokens, parsers of names, dates, amounts and lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import dictionaries as d

#: ASCII white space, as all engines read it.
WS = r"[ \t\n\x0B\f\r]"
#: Words that do not count in comparisons of names.
STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "this", "that")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), rf"^{WS}+|{WS}+$", "")


def canonical(x: Column | str) -> Column:
    """Stripped, runs of white space as one space."""
    return strip(F.regexp_replace(_c(x), rf"{WS}+", " "))


def sha(x: Column | str) -> Column:
    return F.sha2(F.coalesce(_c(x), F.lit("")).cast("binary"), 256)


def content_uuid(x: Column | str) -> Column:
    """8-4-4-4-12 of the hash of the canonical text; the nil UUID for an empty one."""
    text = canonical(F.coalesce(_c(x), F.lit("")))
    code = F.regexp_replace(F.substring(sha(text), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(text == "", "00000000-0000-0000-0000-000000000000").otherwise(code)


def entity_id(kind: Column | str, name: Column | str) -> Column:
    """type:hash8 of the lower-cased type and name."""
    kind = _c(kind)
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.lower(F.concat(kind, F.lit(":"), _c(name))).cast("binary"), 256), 1, 8))


def law_id(citation: Column | str, name: Column | str) -> Column:
    return entity_id(F.lit("law"), F.coalesce(F.nullif(_c(citation), F.lit("")), _c(name)))


def slug(url: Column | str, size: int = 40) -> Column:
    """The last part of a path without its extension, in [a-z0-9_-]."""
    last = F.regexp_extract(F.regexp_replace(_c(url), r"[?#].*$", ""), r"([^/]*)/*$", 1)
    return F.substring(F.regexp_replace(F.lower(F.regexp_replace(last, r"\.[A-Za-z0-9]+$", "")), "[^a-z0-9_-]", "_"), 1, size)


def document_id(title: Column | str, text: Column | str) -> Column:
    """doc:slug_hash12 of the first thousand characters."""
    name = F.substring(F.regexp_replace(F.lower(_c(title)), "[^a-z0-9]+", "_"), 1, 30)
    return F.concat(F.lit("doc:"), name, F.lit("_"), F.substring(sha(F.substring(_c(text), 1, 1000)), 1, 12))


def token_estimate(x: Column | str) -> Column:
    x = F.coalesce(_c(x), F.lit(""))
    return F.when(x == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(x) / 4))).cast("long")


def tokens(x: Column | str, stop: Sequence[str] = (), shortest: int = 1, distinct: bool = False) -> Column:
    """Lower-case runs of letters and digits, without stop words; once each if ``distinct``."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(f"[a-z0-9]{{{shortest},}}"), F.lit(0))
    return F.array_except(parts, F.array(*map(F.lit, stop))) if distinct and stop else F.array_distinct(parts) if distinct else F.filter(parts, lambda p: ~p.isin(*stop)) if stop else parts


def words(x: Column | str) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(_c(x), F.lit(""))), rf"{WS}+"), lambda p: p != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def any_of(x: Column | str, needles: Sequence[str]) -> Column:
    """Whether the text contains one of the strings, whatever the case."""
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    out = F.lit(False)
    for n in needles:
        out = out | low.contains(n.lower())
    return out


def keys_present(x: Column | str, dictionary: Mapping[str, Sequence[str]]) -> Column:
    """The keys of a dictionary one of whose words occurs in the text, in order."""
    return F.filter(F.array(*(F.when(any_of(x, needles), F.lit(k)) for k, needles in dictionary.items())), lambda k: k.isNotNull())


def sample_of(x: Column | str, head: int = 2000, middle: int = 1000) -> Column:
    """The beginning and as much from the middle as a quick judgement reads."""
    x = _c(x)
    return F.concat_ws(" ", F.substring(x, 1, head), F.substring(x, F.floor(F.length(x) / 2).cast("int") + 1, F.lit(middle)))


def clean_remedy(x: Column | str) -> Column:
    """A remedy's name without amounts, percentages and edge punctuation; the name itself if nothing is left."""
    x = _c(x)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\$[0-9,]+(\.[0-9]+)?", ""), r"[0-9]+(\.[0-9]+)?%", ""), r" {2,}", " ")
    return F.coalesce(F.nullif(F.regexp_replace(out, r"^[ ,;:.-]+|[ ,;:.-]+$", ""), F.lit("")), x)


def party(x: Column | str) -> Column:
    """A party's name without its legal form."""
    out = F.regexp_replace(_c(x), r"(?i),?\s*\b(LLC|L\.L\.C\.|Inc\.?|Corp\.?|L\.P\.|LLP|et al\.?)(?![A-Za-z])", "")
    return F.regexp_replace(canonical(out), r"[,. ]+$", "")


def parties(x: Column | str, within: int = 2000) -> Column:
    """struct<plaintiff, defendant> of `X v. Y` near the beginning; empty strings if there is none."""
    head = F.substring(_c(x), 1, within)
    pattern = r"([A-Z][A-Za-z0-9#&.'_ -]{1,80}?) (?:v\.|vs\.|v|against) ([A-Z][A-Za-z0-9#&.'_ -]{1,80})"
    return F.struct(party(F.regexp_extract(head, pattern, 1)).alias("plaintiff"), party(F.regexp_extract(head, pattern, 2)).alias("defendant"))


def first_match(x: Column | str, patterns: Sequence[str], group: int = 1) -> Column:
    """What the first of the patterns that matches captures, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(_c(x), p, group), F.lit("")) for p in patterns))


def docket(x: Column | str) -> Column:
    """The number of the first form of a docket that the text has, whatever its case."""
    return F.nullif(strip(first_match(x, [f"(?i){p}" for p in d.DOCKETS])), F.lit(""))


def court(x: Column | str) -> Column:
    """The first court that the text names, whatever its case."""
    return strip(first_match(x, [f"(?i){p}" for p in d.COURTS]))


def case_name(title: Column | str) -> Column:
    """`X v. Y` in a title whose connective is v, vs or against; else null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(title), r"(?i)^ *(.+? (?:v\.?|vs\.?|against) .+?) *(?:[|(].*)?$", 1), r"(?i) (?:vs\.?|against|v) ", " v. "), F.lit(""))


def procedural_history(x: Column | str) -> Column:
    """array<struct<date, event, description>> of `filed on January 5, 2020` and the like, in order of date, then of the kinds of events, then of the text."""
    parts = []
    for k, (event, words, before) in enumerate(d.EVENTS):
        pattern = rf"(?i)((?:{words})\s+(?:{before})\s*({d.EVENT_DATE}))"
        both = F.arrays_zip(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(1)).alias("said"), F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(2)).alias("on"))
        parts.append(F.transform(both, _event(k, event)))
    known = F.filter(F.array_sort(F.concat(*parts)), lambda e: e["date"].isNotNull())
    return F.transform(known, lambda e: F.struct(e["date"].alias("date"), e["event"].alias("event"), e["description"].alias("description")))


def _event(k: int, name: str):
    # A date may lack its comma.
    return lambda z, i: F.struct(parse_date(F.regexp_replace(z["on"], r"(\d),?\s+(\d{4})$", "$1, $2")).alias("date"), F.lit(k).alias("k"), i.alias("i"), F.lit(name).alias("event"), z["said"].alias("description"))


def parse_date(x: Column | str) -> Column:
    """A date in the first of the known forms that fits, months in any case; else a year, month and day within the text, then the first of January of a year in it; else null."""
    x = canonical(_c(x))
    named = F.initcap(F.regexp_replace(x, r"^([A-Za-z]{3})\. ", "$1 "))
    tried = [F.try_to_timestamp(named if "MMM" in f else x, F.lit(f)).cast("date") for f in d.DATE_FORMATS]
    whole = [F.regexp_extract(x, r"\b((?:19|20)\d{2})[-/](\d{1,2})[-/](\d{1,2})\b", i) for i in (1, 2, 3)]
    within = F.try_to_timestamp(F.concat_ws("-", *whole), F.lit("yyyy-M-d")).cast("date")
    year = F.nullif(F.regexp_extract(x, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit(""))
    return F.coalesce(*tried, within, F.to_date(F.concat(year, F.lit("-01-01"))))


def normal_date(x: Column | str) -> Column:
    """ISO form of a date in one of four formats, else the text itself."""
    tried = [F.date_format(F.try_to_timestamp(_c(x), F.lit(f)), "yyyy-MM-dd") for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")]
    return F.coalesce(*tried, _c(x))


def amount(x: Column | str) -> Column:
    """The first number of a text as a double."""
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(x), ",", ""), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def claim_type(x: Column | str, known: Sequence[str], fragments: Sequence[tuple[str, str]]) -> Column:
    """A known type by name, or by the first fragment that contains or is contained in the text; else OTHER."""
    name = F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "[ -]", "_")
    out = F.when(name == "", "OTHER").when(name.isin(*known), name)
    for fragment, kind in fragments:
        out = out.when(name.contains(fragment) | F.lit(fragment).contains(name), kind)
    return out.otherwise("OTHER")


def described_claim_type(name: Column | str, description: Column | str, known: Sequence[str], fragments: Sequence[tuple[str, str]], size: int = 60) -> Column:
    """A claim's type from its name, then its description, else its name in upper snake case."""
    own, other = claim_type(name, known, fragments), claim_type(description, known, fragments)
    fallback = F.substring(F.regexp_replace(F.upper(canonical(name)), "[^A-Z0-9]+", "_"), 1, size)
    return F.when(own != "OTHER", own).when(other != "OTHER", other).otherwise(fallback)


def by_name(x: Column | str, values: Sequence[str]) -> Column:
    """The value of an enumeration by its name or value, whatever the case; null if it has none."""
    low = F.lower(_c(x))
    return F.when(low.isin(*(v.lower() for v in values)), low)


def id_type(x: Column | str, values: Sequence[str]) -> Column:
    """The type that an id's prefix names."""
    return by_name(F.split_part(_c(x), F.lit(":"), F.lit(1)), values)


def url_metadata(url: Column | str, field: str, patterns: Sequence[tuple[str, Mapping]]) -> Column:
    """A field of the metadata that the first matching pattern suggests, or null; tags as an array."""
    low, out = F.lower(_c(url)), None
    for pattern, data in patterns:
        value = data.get(field)
        value = F.lit(None).cast("array<string>" if field == "tags" else "string") if value is None else F.array(*map(F.lit, value)) if field == "tags" else F.lit(value)
        out = F.when(low.rlike(pattern), value) if out is None else out.when(low.rlike(pattern), value)
    return out


def tag_list(x: Column | str) -> Column:
    """Tags of a comma-separated string: trimmed, empty ones dropped, sorted, once each."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), ","), lambda p: F.trim(p))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: p != "")))


def string_list(x: Column | str) -> Column:
    """An array from a JSON list, or from the scalar itself; null stays null."""
    x = _c(x)
    return F.when(x.isNull(), None).otherwise(F.coalesce(F.when(F.ltrim(x).startswith("["), F.from_json(x, "array<string>")), F.array(x)))


def stringified(x: Column, kind: str) -> Column:
    """An attribute as a string: lists joined, booleans in lower case, structs as JSON, null empty."""
    out = F.array_join(x, ", ") if kind.startswith("array") else F.to_json(x) if kind.startswith(("struct", "map")) else F.lower(x.cast("string")) if kind == "boolean" else x.cast("string")
    return F.coalesce(out, F.lit(""))


def parsed_json(x: Column | str, schema: str) -> Column:
    """A struct from JSON as models write it: as it is, fenced, cut out between braces, or with trailing commas; null if none works.

    Every form that parses has its braces; a form without the first field counts as not parsed.
    """
    x = _c(x)
    fenced = F.regexp_extract(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    repaired = F.regexp_replace(braced, r",\s*([}\]])", "$1")
    sound = lambda s: F.when(F.try_parse_json(F.nullif(s, F.lit(""))).isNotNull(), F.from_json(s, schema))
    return F.coalesce(sound(x), sound(fenced), sound(braced), sound(repaired))


def escape_html(x: Column | str) -> Column:
    out = _c(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sanitize(x: Column | str, injections: Sequence[str], size: int = 50_000) -> Column:
    """Cut at ``size`` with a marker, injected instructions removed, white space canonical."""
    x = _c(x)
    out = F.when(F.length(x) > size, F.concat(F.substring(x, 1, size), F.lit("... [truncated]"))).otherwise(x)
    for p in injections:
        out = F.regexp_replace(out, f"(?i){p}", "")
    return canonical(out)


def matches_any(x: Column | str, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(_c(x), F.lit("")).rlike(f"(?i){p}" if ignore_case else p)
    return out


def anonymized(x: Column | str, patterns: Sequence[tuple[str, str]]) -> Column:
    """Personal data replaced by [KIND], kind after kind."""
    out = _c(x)
    for kind, p in patterns:
        out = F.regexp_replace(out, p, f"[{kind}]")
    return out


def detected(x: Column | str, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(f"({pattern})"), F.lit(1)))


def url_year(x: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(x), r"/((?:19|20)[0-9]{2})(?:/|$)", 1), F.lit("")).cast("int")


def citation(url: Column | str, text: Column | str) -> Column:
    return F.coalesce(F.nullif(F.upper(F.regexp_replace(F.regexp_extract(_c(url), r"([0-9]{4}-ny-slip-op-[0-9a-z-]+)", 1), "-", " ")), F.lit("")), first_match(text, (r"([0-9]{4} NY Slip Op [0-9]+(?:\([A-Z]\))?)",)))


def judges(x: Column | str, within: int = 5000) -> Column:
    head = F.substring(_c(x), 1, within)
    found = [F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in (r"(?:Hon\.|Judge|Justice) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)", r"([A-Z][A-Za-z]+), J\.")]
    return F.array_distinct(F.concat(*found))


def html_text(x: Column | str, least: int = 100) -> Column:
    """The visible text of a page: elements without content dropped, lines trimmed, joined by spaces; null if it is short."""
    out = F.regexp_replace(_c(x), r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "header", "footer", "aside"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = strip(F.regexp_replace(F.regexp_replace(out, rf"{WS}*\n{WS}*", " "), " {2,}", " "))
    return F.when(F.length(out) > least, out)


def sections(x: Column | str) -> Column:
    """array<struct<title, body>>: what lies between lines that are headings (capitals, or numbered), empty ones dropped; none of a text of headings alone."""
    pattern = r"(?s)\A\s*(?:[A-Z][A-Z\s\-]{3,}|[0-9]+\.[0-9.]*\s+.+)\z"
    lines = F.split(_c(x), "\n")
    start = F.struct(F.array().cast("array<struct<title:string,body:string>>").alias("done"), F.lit(None).cast("string").alias("title"), F.lit("").alias("body"))

    def close(s: Column) -> Column:
        body = F.regexp_replace(s["body"], r"^\n+|\n+$", "")
        return F.when(body == "", s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["title"].alias("title"), body.alias("body")))))

    def step(s: Column, line: Column) -> Column:
        return F.when(line.rlike(pattern), F.struct(close(s).alias("done"), F.trim(line).alias("title"), F.lit("").alias("body"))).otherwise(F.struct(s["done"].alias("done"), s["title"].alias("title"), F.concat(s["body"], line, F.lit("\n")).alias("body")))

    return F.aggregate(lines, start, step, close)


def headings(x: Column | str) -> Column:
    """array<struct<title, body>>: the sections of a text, or the whole text as one if it has none."""
    found = sections(x)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("title"), _c(x).alias("body"))))


def first_key(x: Column | str, dictionary: Sequence[tuple[str, Sequence[str]]], other: str | None = None) -> Column:
    """The first key one of whose words the text contains, else ``other``."""
    out = F.lit(other).cast("string")
    for key, needles in reversed(dictionary):
        out = F.when(any_of(x, needles), key).otherwise(out)
    return out


def advice(x: Column | str, table: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The advice of the first entry all of whose words the text contains."""
    low, out = F.lower(_c(x)), F.lit(None).cast("string")
    for needles, said in reversed(table):
        hit = F.lit(True)
        for n in needles:
            hit = hit & low.contains(n)
        out = F.when(hit, said).otherwise(out)
    return out


def extension(url: Column | str) -> Column:
    """The extension of a URL's path, lower case, or null."""
    path = F.regexp_extract(_c(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{2,5})$", 1)), F.lit(""))


def looks_like_resource(title: Column | str, url: Column | str, category: Column | str, own_domain: str) -> Column:
    """Whether a link is a document, leads outside, or is an inner page with a category or a document's name."""
    own = F.contains(F.regexp_extract(_c(url), "://([^/?#]*)", 1), F.lit(own_domain))
    return (F.length(_c(title)) >= 2) & (F.coalesce(extension(url).isin("pdf", "doc", "docx", "ppt", "pptx"), F.lit(False)) | ~own | (F.coalesce(_c(category), F.lit("")) != ""))


def section_of(line: Column, headers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The section that a line is the header of, or null."""
    plain, out = F.regexp_replace(F.upper(line), "[^A-Z ]", ""), F.lit(None).cast("string")
    for name, words_ in reversed(headers):
        hit = F.lit(False)
        for w in words_:
            hit = hit | plain.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def source_marks(x: Column | str) -> Column:
    """The numbers of sources cited inline as [S1], in order, once each."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(r"\[(S[0-9]+)\]"), F.lit(1)))
