"""Chunking: sections packed to a size, then cut at sentences with overlap.

The cutting of a text depends on where the last piece ended, so it is a fold over
one text: an Arrow UDF, a part of a batch of texts at a time. Everything else is columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as tx


#: Bytes of texts of an Arrow batch that are cut at a time.
PART_BYTES = 4 << 20

_MARKS, _LINES = re.compile(r"[.!?](?= )"), re.compile("\n")


def cut_points(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the windows over a text longer than ``target``.

    The places where a sentence or a line ends are found once; each window takes
    the last one that lies whole in its final fifth.
    """
    marks, lines = ([m.start() for m in p.finditer(text)] for p in (_MARKS, _LINES))
    windows, start, size = [], 0, len(text)
    while start < size:
        full = start + target
        stop = full
        if full < size:
            before = [places[i - 1] for places, room in ((marks, 2), (lines, 1)) if (i := bisect_right(places, full - room))]
            if before and max(before) >= int(full - target * 0.2):
                stop = max(before) + 2
        windows.append((start, stop))
        start = stop - overlap
    return windows


def cut(texts: Column | str, target: int = 3000, overlap: int = 200) -> Column:
    """array<string>: pieces of ``target`` characters at most, ended at a sentence where one ends in the last fifth, stripped; a short text whole, a blank one not at all."""
    if target < 1 or not 0 <= overlap < 0.8 * target:
        raise ValueError("the overlap has to be under 0.8 of the target, or the cut would not move on")

    def one(text: str | None) -> list[str]:
        if not text:
            return []
        if len(text) <= target:
            return [text.strip()] if text.strip() else []
        return [text[a:b].strip() for a, b in cut_points(text, target, overlap)]

    @F.arrow_udf("array<string>")
    def run(batch: pa.Array) -> pa.Array:
        # Only a part of the batch is made into Python's strings at a time.
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)) // PART_BYTES
        edges = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(batch)]
        return pa.concat_arrays([pa.array((one(x.as_py()) for x in batch.slice(a, b - a)), pa.list_(pa.string()), size=b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    return run(texts)


def pack(parts: Column, target: int, sep: str = "\n\n") -> Column:
    """array<struct<title, body>> of array<struct<title, body>>: neighbours joined while they are ``target`` characters together at most; the first title of each stays."""
    kind = "struct<done:array<struct<title:string,body:string>>,title:string,body:string,size:int,n:int>"
    start = F.from_json(F.lit('{"done":[],"size":0,"n":0}'), kind)

    def pair(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["title"].alias("title"), s["body"].alias("body"))))

    def state(done, title, body, size, n) -> Column:
        return F.struct(done.alias("done"), title.alias("title"), body.alias("body"), size.cast("int").alias("size"), n.cast("int").alias("n"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["body"])
        joined = F.when(s["n"] == 0, x["body"]).otherwise(F.concat(s["body"], F.lit(sep), x["body"]))
        return F.when((s["size"] > 0) & (s["size"] + size > target), state(pair(s), x["title"], x["body"], size, F.lit(1))).otherwise(state(s["done"], F.coalesce(s["title"], x["title"]), joined, s["size"] + size, s["n"] + 1))

    return F.aggregate(parts, start, step, lambda s: F.when(s["n"] > 0, pair(s)).otherwise(s["done"]))


def super_chunks(text: Column | str, target: int) -> Column:
    return pack(tx.headings(text), target)


def paragraphs(text: Column | str, target: int = 8000) -> Column:
    """array<string>: paragraphs packed to ``target`` characters."""
    parts = F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda p: tx.strip(p) != ""), lambda p: F.struct(F.lit(None).cast("string").alias("title"), tx.strip(p).alias("body")))
    return F.transform(pack(parts, target), lambda x: x["body"])


def chunk_documents(docs: DataFrame, target: int = 3000, overlap: int = 200) -> DataFrame:
    """Chunks of documents (source_id, title, text): chunk_id, source_id, chunk_index, section, title, text, token_count, content_hash, prev_chunk_id, next_chunk_id."""
    supers = docs.filter("text is not null and text <> ''").select("source_id", F.col("title").alias("doc_title"), F.posexplode(super_chunks("text", 3 * target)).alias("section", "s"))
    cuts = supers.select("source_id", "section", F.coalesce("s.title", "doc_title").alias("title"), F.posexplode(cut("s.body", target, overlap)).alias("part", "text"))
    line = Window.partitionBy("source_id").orderBy("section", "part")
    out = cuts.withColumn("chunk_index", F.row_number().over(line).cast("long") - 1).withColumn("chunk_id", F.concat_ws(":", "source_id", "chunk_index"))
    return out.select("chunk_id", "source_id", "chunk_index", F.col("section").cast("string").alias("section"), "title", "text", tx.token_estimate("text").alias("token_count"), tx.sha("text").alias("content_hash"), F.lag("chunk_id").over(line).alias("prev_chunk_id"), F.lead("chunk_id").over(line).alias("next_chunk_id"))


#: A sentence: a run without marks or line ends, and its mark. Entered at its start only and giving nothing back, so long lines without a mark cost one pass.
SENTENCE = r"(?<![^.!?\n])[^.!?\n]++[.!?]"


def sentences(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys, i, start, sentence: the sentences of each row's text and where they start; keys tell rows apart.

    Gaps and matches alternate, so a running sum of their lengths gives positions; the sum is a window, linear in the text.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), F.transform(F.split(text, SENTENCE, -1), lambda g: F.length(g))
    each = df.select(*keys, F.posexplode(F.arrays_zip(gaps.alias("g"), found.alias("m"))).alias("i", "z")).filter("z.m is not null")
    line = Window.partitionBy(*keys).orderBy("i")
    return each.select(*keys, "i", (F.sum(F.col("z.g") + F.length("z.m")).over(line) - F.length("z.m")).alias("start"), F.col("z.m").alias("sentence"))
