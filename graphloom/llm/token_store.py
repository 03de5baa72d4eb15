"""Token ids in binary files of patched frame-of-reference blocks, and their readers.

Documents are ordered by id, ranges of them go to tasks, and each task writes the
ids of its documents as one stream, cut into segments of whole documents. A
segment holds blocks of ``BLOCK`` ids: the least id of a block is taken off, the
rest is packed at the width that ``PERCENTILE`` of the block's ids need, and the
others, the outliers, stand in an exception list of the block with their places.
An index of block starts lets a reader decode any block by itself.

A segment, little-endian: magic, shard, number within the shard, ids, blocks,
bytes of blocks, bytes of the document index, bytes of an exception (``_HEADER``); for each block its start (u4),
least id (u4), width (u1) and number of exceptions (u1); the blocks, each the packed
bits, then places (u1) of its exceptions and what of them goes beyond the width (1, 2 or 4 bytes, as
the largest of the segment needs); the document index, an Arrow stream of doc_id and n_tokens. A newline ends each segment, since Spark's text
writer is what commits the files: a lost executor leaves no half-written file behind, and they
may lie in any store that Spark reaches. The readers take them whole (``binaryFile``), so
files are bounded: a file has ``FILE_SEGMENTS`` segments at most, and a segment ends with the document
that fills it.

Tokens are those of ``packing.token_ids``. Defined results: a null or empty text
is the end token alone; documents without an id come first; rows of one id go by a hash of
their texts, equal rows follow each other in any order; very long texts make a segment
of their own. An empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import scratch_path
from .base import documents, few, lean, named, settle, text_of
from .packing import VOCABULARY, token_ids

END = 2
#: Ids of a block, and the share of them that the packed width must hold.
BLOCK, PERCENTILE = 128, 0.85
#: Ids that fill a segment, segments of a file, bytes of text that make a shard.
SEGMENT, FILE_SEGMENTS, SHARD = 1 << 20, 16, 32 << 20
#: Shards whose sizes are summed up together.
TOGETHER = 1000
_MAGIC = b"PFORIDS1"
_HEADER = struct.Struct("<8sqqqqqqq")
_PARTS = (("starts", "<u4"), ("least", "<u4"), ("width", "u1"), ("exceptions", "u1"))


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers as bytes of ``width`` bits each, the highest bit first."""
    kind = ">u2" if width <= 16 else ">u4"
    size = np.dtype(kind).itemsize
    bits = np.unpackbits(values.astype(kind).view(np.uint8).reshape(len(values), BLOCK, size), axis=2)
    return np.packbits(bits[:, :, 8 * size - width :].reshape(len(values), BLOCK * width), axis=1)


def _unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    kind = ">u2" if width <= 16 else ">u4"
    size = np.dtype(kind).itemsize
    bits = np.zeros((len(rows), BLOCK, 8 * size), np.uint8)
    bits[:, :, 8 * size - width :] = np.unpackbits(rows, axis=1).reshape(len(rows), BLOCK, width)
    return np.packbits(bits, axis=2).reshape(len(rows), -1).view(kind).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[dict[str, np.ndarray], bytes, int]:
    """The arrays of ``_PARTS`` for the blocks of some ids, the blocks, and the bytes of an exception."""
    blocks = -(-len(ids) // BLOCK)
    held = np.concatenate([ids, np.full(blocks * BLOCK - len(ids), ids[-1] if len(ids) else 0, np.uint32)]).astype(np.uint32).reshape(blocks, BLOCK)
    least = held.min(axis=1, initial=np.iinfo(np.uint32).max)
    rest = held - least[:, None]
    place = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = np.frexp(np.partition(rest, place, axis=1)[:, place].astype(np.float64))[1].astype(np.int64)
    beyond = (rest >> width[:, None].astype(np.uint64)).astype(np.uint32)
    exceptions = np.count_nonzero(beyond, axis=1)
    top = int(beyond.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    sizes = BLOCK // 8 * width + (1 + size) * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = rest[rows] & np.uint32((1 << w) - 1)
        out[starts[rows][:, None] + np.arange(BLOCK // 8 * w)] = _packed(low, w)
    at, place = np.nonzero(beyond)
    if len(at):
        turn = np.arange(len(at)) - (np.cumsum(exceptions) - exceptions)[at]
        lists = starts[at] + BLOCK // 8 * width[at]
        out[lists + turn] = place
        values = beyond[at, place].astype(f"<u{size}").view(np.uint8).reshape(-1, size)
        out[(lists + exceptions[at] + size * turn)[:, None] + np.arange(size)] = values
    return {"starts": starts, "least": least, "width": width, "exceptions": exceptions}, out.tobytes(), size


def decode_blocks(parts: dict[str, np.ndarray], blocks: np.ndarray, size: int, first: int = 0, end: int | None = None) -> np.ndarray:
    """The ids of the blocks from ``first`` to before ``end``, no other block being looked at."""
    starts, least, width, exceptions = (parts[name][first:end].astype(np.int64) for name, _ in _PARTS)
    rest = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        rest[rows] = _unpacked(blocks[starts[rows][:, None] + np.arange(BLOCK // 8 * w)], w)
    at = np.repeat(np.arange(len(starts)), exceptions)
    if len(at):
        turn = np.arange(len(at)) - (np.cumsum(exceptions) - exceptions)[at]
        lists = starts[at] + BLOCK // 8 * width[at]
        values = blocks[(lists + exceptions[at] + size * turn)[:, None] + np.arange(size)]
        beyond = np.ascontiguousarray(values).view(f"<u{size}")[:, 0].astype(np.uint64)
        rest[at, blocks[lists + turn]] |= (beyond << width[at].astype(np.uint64)).astype(np.uint32)
    return (rest + least[:, None].astype(np.uint32)).reshape(-1)


def encode_segment(shard: int, number: int, doc_ids: pa.Array, ids: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    stream = np.concatenate([np.empty(0, np.uint32), *ids])
    parts, blocks, size = encode_blocks(stream, percentile)
    index = pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "n_tokens"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, index.schema) as writer:
        writer.write_batch(index)
    listed = sink.getvalue().to_pybytes()
    head = _HEADER.pack(_MAGIC, shard, number, len(stream), len(parts["starts"]), len(blocks), len(listed), size)
    return b"".join([head, *(parts[name].astype(kind).tobytes() for name, kind in _PARTS), blocks, listed])


class Segment:
    """A segment that begins at ``at`` in the bytes of a file; ``end`` is where the next one begins."""

    def __init__(self, content: memoryview, at: int) -> None:
        magic, self.shard, self.number, self.n_ids, n, size, listed, self.exception_size = _HEADER.unpack_from(content, at)
        if magic != _MAGIC:
            raise ValueError("no segment of token ids begins here")
        at += _HEADER.size
        self.parts = {}
        for name, kind in _PARTS:
            self.parts[name] = np.frombuffer(content, kind, n, at)
            at += self.parts[name].nbytes
        self.blocks = np.frombuffer(content, np.uint8, size, at)
        self._listed = content[at + size : at + size + listed]
        self.end = at + size + listed + 1

    def documents(self) -> pa.Table:
        """doc_id and n_tokens in the order of the ids."""
        return pa.ipc.open_stream(pa.py_buffer(self._listed)).read_all()

    def ids(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids by position; only the blocks that hold them are decoded."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        first_block = first // BLOCK
        return decode_blocks(self.parts, self.blocks, self.exception_size, first_block, -(-end // BLOCK))[first - first_block * BLOCK : end - first_block * BLOCK]


def segments_of(content: bytes) -> Iterator[Segment]:
    view, at = memoryview(content), 0
    while at < len(view):
        segment = Segment(view, at)
        yield segment
        at = segment.end


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, vocabulary: str = VOCABULARY, percentile: float = PERCENTILE, segment_ids: int = SEGMENT, shard_bytes: int = SHARD) -> None:
    """Writes the ids of all documents, each followed by ``end``, in ascending order of id."""
    rows = docs.select(named(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("uid"), "text")
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    order = ("doc_id", "hash", "uid")  # hash and uid part the rows of one id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, size = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[pa.Array] = []
        ids: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            nonlocal number, size
            value = encode_segment(shard, number, pa.concat_arrays(doc_ids), ids, percentile)
            number, size = number + 1, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        for batch in batches:
            column, at = batch.column(0), 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids.append(np.append(token_ids(text, vocabulary) if text else np.empty(0, np.uint32), np.uint32(end)))
                size += len(ids[-1])
                if size >= segment_ids:
                    doc_ids.append(column.slice(at, i + 1 - at))
                    at = i + 1
                    yield told()
            if at < len(column):
                doc_ids.append(column.slice(at))
        if ids:
            yield told()

    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = dealt.mapInArrow(lean(run), "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint", with_ids: bool = False) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, ids.

    ``id_type``: the type of the ids that were written. Files are read once; sizes of segments, a row each, give the starts.
    """
    names = ["doc_id", "shard", "number", "before", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part in segments_of(content.as_buffer()):
                    listed, ids = part.documents(), part.ids().astype("<u4")
                    n = listed["n_tokens"].to_numpy()
                    edges = np.concatenate([[0], np.cumsum(n)])
                    held, bounds = memoryview(ids), edges.tolist()
                    crc = [zlib.crc32(held[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    arrays = [listed["doc_id"].combine_chunks(), *(pa.array(np.full(len(n), x), pa.int64()) for x in (part.shard, part.number)), *(pa.array(x, pa.int64()) for x in (edges[:-1], n, crc))]
                    if with_ids:
                        arrays.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {id_type}, shard long, number long, before long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    read = _files(spark, path).select("content").mapInArrow(lean(run), schema)
    held = read if with_ids else settle(read, "token-documents")
    sizes = _starts(held.groupBy("shard", "number").agg(F.sum("n_tokens").alias("n_ids")))
    placed = held.join(few(sizes.select("shard", "number", "start")), ["shard", "number"])
    return placed.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _starts(sizes: DataFrame) -> DataFrame:
    """Adds to one row for each segment (shard, number, n_ids) the ids before it: sums within shards, within groups of shards, and over groups."""
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = settle(sizes, "segment-sizes")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("held")).withColumn("group", F.floor(F.col("shard") / TOGETHER))
    shards = shards.withColumn("own", F.coalesce(F.sum("held").over(before("group", "shard")), F.lit(0)))
    # One row for each thousand shards.
    groups = shards.groupBy("group").agg(F.sum("held").alias("whole"))
    groups = groups.select("group", F.coalesce(F.sum("whole").over(before("group")), F.lit(0)).alias("base"))
    shards = shards.join(groups, "group").select("shard", (F.col("base") + F.col("own")).alias("base"))
    within = F.coalesce(F.sum("n_ids").over(before("shard", "number")), F.lit(0))
    return sizes.withColumn("own", within).join(shards, "shard").select("shard", "number", "n_ids", (F.col("base") + F.col("own")).cast("long").alias("start"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each segment: shard, number, n_ids, start and the file that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = [(x.shard, x.number, x.n_ids) for x in segments_of(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows)), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=["file", "shard", "number", "n_ids"])

    found = settle(_files(spark, path).filter(F.length("content") > 0).mapInArrow(lean(run), "file string, shard long, number long, n_ids long"), "segments")
    return _starts(found.select("shard", "number", "n_ids")).join(found.select("shard", "number", "file"), ["shard", "number"])


def ids_between(spark: SparkSession, segments: DataFrame, first: int, end: int) -> DataFrame:
    """The ids at positions ``first`` to before ``end``, as a data loader asks for them: start and ids, a row for each segment.

    ``segments`` is the index. Only files that hold some of the range are read, and of them only the blocks that do.
    """
    wanted = settle(segments.filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > first)), "wanted-segments")
    files = [r.file for r in wanted.select("file").distinct().collect()]  # of the range that is asked for
    held = {(r.shard, r.number): r.start for r in wanted.select("shard", "number", "start").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part in segments_of(content.as_buffer()):
                    start = held.get((part.shard, part.number))
                    if start is not None:
                        a = max(first - start, 0)
                        ids = part.ids(a, end - start).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([start + a]), pa.array([ids], pa.list_(pa.int32()))], names=["start", "ids"])

    if not files:
        return spark.createDataFrame([], "start long, ids array<int>")
    return _files(spark, files).select("content").mapInArrow(lean(run), "start long, ids array<int>")


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(documents(spark, sf_dir), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
