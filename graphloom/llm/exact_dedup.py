"""Exact deduplication with Patricia tries as owners of equal texts.

Texts are partitioned by byte length and content hash. A partition has one
compressed radix trie for all its texts, into which their full byte strings go;
a terminal node stores the identifier that owns its text and how many rows have
it. Spark's sorter brings a partition's texts in byte order (and spills what it
sorts), so everything to the left of the path to the last text is finished. When
a trie holds more than its budget, the finished subtrees leave it and pass on
their owners; memory holds the budget and one path, however many texts there are.

Before the shuffle every task folds its own copies in a trie as well, so that a
text that a third of all rows share leaves each task about once. There texts come
in any order; over the budget the largest subtrees leave first.

Defined results: a null text counts as empty. A null identifier owns a text only
if no row of it has another. Of rows that are equal in text and identifier one
stays. Identifiers may be of any type with an order. An empty table gives an
empty result. Other columns are carried only where asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .base import documents, fresh, lean, meet, named, settle, text_of

#: Bytes of text that a trie holds before subtrees leave it.
TRIE_BYTES = 16 << 20
#: Owners that leave together.
ROWS = 1000


class RadixTrie:
    """A compressed radix trie over bytes; ``at`` gives a text's terminal cell, made at need.

    A node is [edge label, children by first byte, cell or None]; a cell is
    [row of the owner or None, rows so far]. ``held`` are the bytes of all edges.
    """

    __slots__ = ("held", "root")

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.held = 0

    def at(self, text: bytes) -> list:
        node, rest = self.root, text
        while rest:
            child = node[1].get(rest[0])
            if child is None:
                child = node[1][rest[0]] = [rest, {}, None]
                self.held += len(rest)
                node = child
                break
            shared = _shared(child[0], rest)
            if shared < len(child[0]):
                tail = [child[0][shared:], child[1], child[2]]
                child[0], child[1], child[2] = child[0][:shared], {tail[0][0]: tail}, None
            node, rest = child, rest[shared:]
        if node[2] is None:
            node[2] = [None, 0]
        return node[2]

    def cells(self, node: list | None = None, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Texts and cells of a subtree, or of all; ``before`` is the path to it."""
        held = [(node or self.root, before)]
        while held:
            at, path = held.pop()
            path += at[0]
            if at[2] is not None:
                yield path, at[2]
            held += ((child, path) for child in at[1].values())

    def cut(self, node: list, first: int, before: bytes) -> Iterator[tuple[bytes, list]]:
        """Takes the subtree of ``node`` that begins with byte ``first`` out, and gives its texts and cells."""
        child = node[1].pop(first)
        self.held -= sum(map(len, _labels(child)))
        return self.cells(child, before)

    def finished(self, last: bytes) -> Iterator[tuple[bytes, list]]:
        """Takes out all that lies beside the path to the text ``last``."""
        node, path = self.root, b""
        while True:
            on = last[len(path)] if len(path) < len(last) else None
            for first in [b for b in node[1] if b != on]:
                yield from self.cut(node, first, path)
            if on is None:
                return
            if node[2] is not None:  # a prefix of the text that comes last
                yield path, node[2]
                node[2] = None
            node = node[1][on]
            path += node[0]

    def largest(self, most: int) -> Iterator[tuple[bytes, list]]:
        """Takes subtrees out, the largest first, until ``most`` bytes or less are held."""
        node, path = self.root, b""
        while len(node[1]) == 1 and node[2] is None:  # to the first fork
            (node,) = node[1].values()
            path += node[0]
        sizes = sorted(((sum(map(len, _labels(child))), first) for first, child in node[1].items()), reverse=True)
        for _, first in sizes:
            if self.held <= most:
                break
            yield from self.cut(node, first, path)


def _labels(node: list) -> Iterator[bytes]:
    held = [node]
    while held:
        at = held.pop()
        yield at[0]
        held += at[1].values()


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slice comparisons."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _owns(new: list, old: list | None, largest: bool) -> bool:
    """Whether a row (identifier, carried columns) owns a text rather than the one so far: by identifier, null last of all, then by the carried columns."""
    if old is None or (new[0] is None) != (old[0] is None):
        return old is None or old[0] is None
    if new[0] != old[0]:
        return (new[0] > old[0]) == largest
    return repr(new[1:]) > repr(old[1:])


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema, largest: bool, final: bool, most: int = TRIE_BYTES) -> Iterator[pa.RecordBatch]:
    """Fold rows (text, rows so far, id, carried ...) by text.

    Not final: any order comes in. Final: texts come in byte order, and each leaves once.
    """
    trie = RadixTrie()

    def out(cells: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, (row, count) in cells:
            rows.append((len(text), hashlib.sha256(text).hexdigest(), text, count, *row) if final else (text, count, *row))
            size += len(text)
            if len(rows) == ROWS or size > most // 4:
                yield packed(rows)
                rows, size = [], 0
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        if final and "text" not in schema.names:
            del columns[2]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        text = b""
        for text, count, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cell = trie.at(text)
            if _owns(row, cell[0], largest):
                cell[0] = row
            cell[1] += count
            if trie.held > most:
                yield from out(trie.finished(text) if final else trie.largest(most // 2))
    yield from out(trie.cells())


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", carry: tuple[str, ...] = (), with_text: bool = False, most: int = TRIE_BYTES) -> DataFrame:
    """One row for each distinct text: n_bytes, text_sha256, group_size, keep_id and, on request, the text and the owner's other columns."""
    largest = {"largest": True, "smallest": False}[keep]
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    rows = docs.select(text_of(text_col).cast("binary").alias("text"), F.lit(1).cast("long").alias("n"), named(id_col).alias("id"), *(named(c).alias(f"c{i}") for i, c in enumerate(carry)))
    id_type = rows.schema["id"].dataType
    part = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("id", id_type), *fields])
    full = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("text_sha256", T.StringType()), *([T.StructField("text", T.BinaryType())] if with_text else []), T.StructField("group_size", T.LongType()), T.StructField("keep_id", id_type), *fields])
    arrow_part, arrow_full = to_arrow_schema(part), to_arrow_schema(full)
    folded = rows.mapInArrow(lean(lambda it: _fold(it, arrow_part, largest, False, most)), part)
    dealt = folded.repartition(F.octet_length("text"), F.xxhash64("text")).sortWithinPartitions("text")
    return dealt.mapInArrow(lean(lambda it: _fold(it, arrow_full, largest, True, most)), full)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256."""
    held = settle(owners(docs, id_col, text_col, keep).select("text_sha256", "keep_id", "group_size"), "owners")
    members = settle(docs.select(named(id_col).alias("doc_id"), F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256")), "digests")
    met = meet(members, held, "text_sha256", "group_size")
    # Equal rows are interchangeable; among the owner's copies one is numbered to stay.
    owner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(0)))
    own = met.filter(owner).withColumn("kept", turn == 1)
    rest = met.filter(~owner).withColumn("kept", F.lit(False))
    return own.unionByName(rest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that own their text, with all their columns; a null text stays null only if no empty one of a larger id has it."""
    carry = tuple(c for c in docs.columns if c not in (id_col, text_col))
    (was_null,) = fresh(docs, "was_null")
    marked = docs.withColumn(was_null, named(text_col).isNull())
    held = owners(marked, id_col, text_col, keep, (*carry, was_null), True)
    back = {id_col: F.col("keep_id"), text_col: F.when(~F.col(f"c{len(carry)}"), F.col("text").cast("string"))} | {c: F.col(f"c{i}") for i, c in enumerate(carry)}
    return held.select(*(back[c].alias(c) for c in docs.columns))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


SQL = {
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """
}
