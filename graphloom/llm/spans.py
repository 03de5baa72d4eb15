"""Regex matches with code-point positions and neighbouring words, by built-in functions alone.

``split`` gives the gaps about the matches that ``regexp_extract_all`` gives, so
lengths of gaps and matches add up to positions. Only lengths, matches and the
words next to them leave the scan; the texts are read once.

Neighbouring words are found from the ends of a gap, whole and however far they
lie. Where a gap has too few, the words go on across the match before or after
it, which stands as its kind in angle brackets: identifiers differ, their kind
is what a context can share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import named, settle, text_of

BLANK = r"\x20\x09-\x0D"
_ITEM = "struct<kind:string,i:int,gap:int,match:string,first:string,tail:string>"
#: What is kept of a gap's ends, going inwards: words between blanks (two before a match, one after it), or two words of letters on both sides with all that lies between.
_WORDS = (rf"\A[{BLANK}]*+[^{BLANK}]*+[{BLANK}]*+[^{BLANK}]*+", rf"\A[{BLANK}]*+[^{BLANK}]*+")
_LETTERS = (r"\A[^\p{L}]*+[\p{L}_-]*+[^\p{L}]*+[\p{L}_-]*+",) * 2


def _inwards(text: Column, pattern: str) -> Column:
    """The end of a text that ``pattern`` takes, read backwards; anchored, so it is looked for in one place."""
    return F.reverse(F.regexp_extract(F.reverse(text), pattern, 0))


def _items(text: Column, kind: str, pattern: str, ends: tuple[str, str]) -> Column:
    """A struct for each gap, with the match after it; the last gap has none."""

    def gap(s: Column) -> Column:
        return F.struct(F.length(s).alias("gap"), F.regexp_extract(s, ends[1], 0).alias("first"), _inwards(s, ends[0]).alias("tail"))

    def item(z: Column, i: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), z["g"]["gap"].alias("gap"), z["m"].alias("match"), z["g"]["first"].alias("first"), z["g"]["tail"].alias("tail"))

    gaps = F.transform(F.split(text, pattern, -1), gap)
    return F.transform(F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), item)


def matches(docs: DataFrame, id_col: str, text_col: str, patterns: dict[str, tuple[str, Callable[[Column], Column] | None]], label: str, letters: bool = False) -> DataFrame:
    """One row for each match: uid (of the document's row), doc_id, kind, i, start, end, match, before and after (the text next to it, up to two words before and one after, or two words of letters on both sides); one row with a null kind for each document besides.

    ``patterns``: kind to (pattern, a cheap condition on the text without which nothing matches, or None).
    """
    text, none, ends = F.col("the text"), F.array().cast(f"array<{_ITEM}>"), _LETTERS if letters else _WORDS
    source = docs.select(F.monotonically_increasing_id().alias("uid"), named(id_col).alias("doc_id"), text_of(text_col).alias("the text"))
    arrays = []
    for kind, (pattern, hint) in patterns.items():
        test = text.rlike(pattern) if hint is None else hint(text) & text.rlike(pattern)
        arrays.append(F.when(test, _items(text, kind, pattern, ends)).otherwise(none))
    # Every document keeps a row of its own; the id of a row is fixed by writing the table.
    own = F.array(F.lit(None).cast(_ITEM))
    rows = settle(source.select("uid", "doc_id", F.explode(F.concat(own, *arrays)).alias("s")).select("uid", "doc_id", "s.*"), label)
    order = Window.partitionBy("uid", "kind").orderBy("i")
    size = F.coalesce(F.length("match"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(order)
    stands = F.concat(F.lit("<"), F.col("kind"), F.lit(">"))
    # An end that took its whole gap goes on across the neighbouring match.
    tail_ends, first_ends = F.length("tail") < F.col("gap"), F.length("first") < F.col("gap")
    across = F.concat(F.lag("tail").over(order), stands, F.col("tail"))
    before = F.when(tail_ends | (F.col("i") == 0), F.col("tail")).otherwise(_inwards(across, ends[0]))
    on = F.concat(F.col("first"), stands, F.lead("first").over(order))
    after = F.when(first_ends | F.col("match").isNull(), F.col("first")).otherwise(F.regexp_extract(on, ends[1], 0))
    placed = rows.withColumns({"before": before, "own after": after, "end": end, "start": end - size})
    placed = placed.select("uid", "doc_id", "kind", "i", "match", "before", F.lead("own after").over(order).alias("after"), "start", "end")
    return placed.filter("kind is null or match is not null")
