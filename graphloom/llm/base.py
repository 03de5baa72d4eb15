"""What the operators share: scratch tables, word splitting, hash joins on row keys."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import release, settled as settle

__all__ = ["WORD", "documents", "few", "fresh", "lean", "meet", "named", "release", "settle", "text_of", "word_count"]

#: White space as the contracts define it: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of strings that a worker takes from an Arrow batch at a time; a longer text comes alone.
BATCH_BYTES = 4 << 20
#: Rows of a key that are met by broadcast instead of by shuffle: one part in HOT of all rows, and HOT_ROWS at least.
HOT, HOT_ROWS = 1000, 100_000
#: Rows of a table of some numbers and names that may be broadcast: some 20 MB.
FEW = 100_000


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over batches bounded in bytes; a worker gives its memory back when a partition ends, since it lives on between stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_parts(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def few(table: DataFrame) -> DataFrame:
    """A table for broadcast if it has ``FEW`` rows at most; else as it is, to be met by shuffle."""
    held = settle(table, "few")
    return F.broadcast(held) if held.count() <= FEW else held


def meet(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table`` (a settled table with one row for each ``key``; ``n``: how many of ``rows`` have it).

    A key with more than its part of all rows, ``HOT`` such keys at most, is met by broadcast, where its rows are; the rest by shuffle.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > max(HOT_ROWS, total // HOT)
    hot = table.filter(often)
    if hot.isEmpty():
        return rows.join(table, key)
    by_place = rows.join(F.broadcast(hot), key)
    return by_place.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(~often), key))


def named(col: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + col.replace("`", "``") + "`")


def text_of(col: str) -> Column:
    """The text, null as the empty one."""
    return F.coalesce(named(col), F.lit(""))


def word_count(col: str) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
