"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Class k takes the pieces longer than capacity / (k + 1) and up to capacity / k;
a sequence of class k holds k pieces, whatever they are, so every worker fills
its own sequences by counting and needs to know of no other. A document is cut
into full pieces of the capacity; what remains is cut at capacity / (k + 1)
until a piece fills its share of a sequence by ``fill`` at least, so a full
sequence is padded by 1 - ``fill`` at most. Pieces that do not make up a full
sequence of their worker and class meet those of other workers, in ever fewer
groups; the last ones, fewer than k of each class and so some thousand at most
whatever the input, go by first fit decreasing into sequences of mixed classes.

Tokens are those that ``tokenizers`` gives with the byte-level vocabulary file,
special tokens in a text being its own; one end token follows every document.
Two libraries have the vocabulary, and both merge the pair of least rank first
inside the pieces of one pattern. They can differ only in special tokens and in
the Unicode tables behind the pattern; texts below U+0250 without the string of a
special token therefore go through the faster one, all others through
``tokenizers``. So do texts with a run of more than ``LONGEST_RUN`` characters,
for which the faster one's pattern engine gives up.

Defined results: a null or empty text is the end token alone. Equal rows are
packed each for itself. Very long texts are cut like others. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import documents, lean, named, release, settle

CAPACITY, END, FILL = 2048, 1, 0.98
#: Pieces of a class that a worker takes, about, and workers whose remainders meet.
WORKER_PIECES, MEET = 4_000, 64
VOCABULARY = "byte_bpe_50k.json"


@lru_cache(2)
def _encoder(vocabulary: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return slow, fast, tuple(t.content for t in slow.get_added_tokens_decoder().values())


#: Runs longer than this go to the library that defines the ids.
LONGEST_RUN = 4096


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of a text without an end token."""
    slow, fast, special = _encoder(vocabulary)
    plain = (text.isascii() or max(text) < "ɐ") and not any(t in text for t in special)
    if plain and (len(text) <= LONGEST_RUN or max(map(len, text.split(" "))) <= LONGEST_RUN):
        return np.array(fast.encode_ordinary(text), np.uint32)
    return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if k * rest >= fill * capacity or capacity // (k + 1) == 0:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, fill: float = FILL, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens and, on request, the token ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, length, crc, total, held = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(text, vocabulary) if text else np.empty(0, np.uint32), np.uint32(end)).astype("<u4")
                a = 0
                for n in cuts(len(ids), capacity, fill):
                    part = ids[a : a + n]
                    rows.append(i)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        held.append(part.astype(np.int32))
                    a += n
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(held, pa.list_(pa.int32()))] * with_ids], names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(named(id_col), named(text_col)).mapInArrow(lean(run), schema)


def _first_fit(capacity: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="together").sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        room: list[int] = []
        at, offset = [], []
        for n in part["length"]:
            i = next((i for i, r in enumerate(room) if r >= n), len(room))
            if i == len(room):
                room.append(capacity)
            at.append(i)
            offset.append(capacity - room[i])
            room[i] -= n
        part["sequence_id"], part["offset"] = -1 - np.array(at, "int64"), np.array(offset, "int64")
        return part

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, worker_pieces: int = WORKER_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces; (doc_id, start, ids_crc32) tells them apart, equal ones are interchangeable."""
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    # A row's own number deals it out, so that equal or null ids do not meet in one worker; the number is fixed by writing the table.
    cut = settle(cut.select(*keys, F.monotonically_increasing_id().alias("uid")), "pieces")
    rest = cut.withColumn("class", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    # As many workers as the pieces of a class ask for; there are at most twice as many classes as the root of the capacity.
    sizes = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: -(-n // worker_pieces) for k, n in sizes.items()}
    workers = max(share.values(), default=1)
    spread = F.element_at(F.create_map(*(F.lit(v) for pair in share.items() for v in pair)), F.col("class")) if share else F.lit(1)
    rest = rest.withColumn("worker", F.pmod(F.xxhash64("uid"), spread))
    done, level = None, 0
    while True:
        own = Window.partitionBy("worker", "class")
        order = own.orderBy("uid")
        dealt = rest.withColumn("turn", F.row_number().over(order) - 1).withColumn("held", F.count(F.lit(1)).over(own))
        dealt = dealt.withColumn("bin", F.floor(F.col("turn") / F.col("class"))).withColumn("whole", (F.col("bin") + 1) * F.col("class") <= F.col("held"))
        before = Window.partitionBy("worker", "class", "bin").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # level, worker, class and count make up an id without any order among workers.
        name = F.lit(level).cast("long") * F.lit(1 << 58) + F.col("worker") * F.lit(1 << 36) + F.col("class").cast("long") * F.lit(1 << 24) + F.col("bin")
        full = dealt.filter("whole").withColumn("offset", F.sum("length").over(before) - F.col("length")).select(*keys, name.alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
        done = full if done is None else done.unionByName(full)
        rest = settle(dealt.filter("not whole").select(*keys, "uid", "class", "worker"), "pieces-rest")
        level += 1
        if workers == 1:
            break
        workers = -(-workers // MEET)
        rest = rest.withColumn("worker", F.pmod("worker", F.lit(workers)))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.select(*keys).schema)
    last = rest.select(*keys, F.lit(0).alias("together")).groupBy("together").applyInPandas(_first_fit(capacity), f"{kind}, sequence_id long, offset long")
    return done.unionByName(last)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, pad: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, padded up to the capacity unless their length is a power of two."""
    cut = settle(pieces(docs, id_col, text_col, capacity, end, with_ids=True), "pieces-ids")
    placed = pack(cut.drop("ids"), capacity)
    turn = F.row_number().over(Window.partitionBy("doc_id", "start", "ids_crc32").orderBy(F.lit(0)))
    cut, placed = cut.withColumn("turn", turn), placed.withColumn("turn", turn)
    met = placed.alias("p").join(cut.alias("c"), F.col("p.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("p.start") == F.col("c.start")) & (F.col("p.ids_crc32") == F.col("c.ids_crc32")) & (F.col("p.turn") == F.col("c.turn")))
    ids = met.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p.offset", "c.ids"))), lambda x: x.ids)).alias("ids"))
    size = F.size("ids")
    power = size.bitwiseAND(size - 1) == 0
    return ids.select("sequence_id", F.when(power, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(capacity) - size)))).alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
