"""SimHash near-duplicates through an inverted index of byte positions.

Two 64-bit fingerprints within 3 bits differ in 3 of their 8 bytes at most, so
they share 5 positional bytes or more. The index posts every distinct
fingerprint under positional bytes. A list of one byte is always a 256th of
everything, so lists are split by the adjoining byte from the start: of the four
pairs of positions, (0, 1) to (6, 7), a linked pair shares one at least. In a
posting list the shared positional bytes of every pair are tallied (all eight of
them, in one machine word); pairs that reach the guaranteed minimum of 5 are
retained and verified by Hamming distance. A list gives only the links of a
spanning forest, found by a search that tallies each fingerprint with those not
reached yet, so a group of g near copies gives g - 1 links and never g * g pairs.

A list that is still long is split by a further byte: of any four positions a
linked pair shares one, so members are posted again under four of the positions
that the list has not used. Lists of five shared bytes, where no further byte is
guaranteed, are dealt out as pairs of blocks. No list, partner or candidate is
dropped, and no list that one task takes is longer than ``LONG_LIST``.

Defined results: a null text is empty; no word gives fingerprint zero, which is
linked like any other; fewer words than a shingle give one shingle of all of
them. Null identifiers take part, and a group of only those has a null id.
Repeated rows share a fingerprint. Other columns of the table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, fresh, lean, meet, named, release, settle, text_of

#: Longest posting list that one task takes as a whole, and lists that are looked through together.
LONG_LIST, SHORT_LIST = 4096, 64
#: Positional bytes, and those of them that a list of the first level has in common.
POSITIONS, FIRST = 8, ((0, 1), (2, 3), (4, 5), (6, 7))


def fingerprint(text: bytes, words: int, seed: int) -> int:
    """The SimHash of a text: bit by bit, whether over half of its shingles' XXH64 have it."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    codes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 65_536):
        ones += np.unpackbits(codes[i : i + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(codes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """id, fingerprint (as a signed long) and a hash of the text, for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, words, seed) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64()), batch.column(2)], names=["id", "fp", "code"])

    return docs.select(named(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"), F.xxhash64(text_of(text_col)).alias("code")).mapInArrow(lean(run), f"id {kind}, fp long, code long")


def _shared_bytes(other: np.ndarray) -> np.ndarray:
    """The tally: how many of the 8 bytes of each XOR of two fingerprints are zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((other & low) + low) | other | low))


def _near(other: np.ndarray, bits: int) -> np.ndarray:
    """Of XORs with one fingerprint, the places of those that reach the count and then stand the verification."""
    retained = np.flatnonzero(_shared_bytes(other) >= POSITIONS - bits)
    return retained[np.bitwise_count(other[retained]) <= bits]


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints that lie within ``bits``."""
    out = []
    open_ = np.arange(len(prints))
    while len(open_) > 1:
        queue, open_ = [int(open_[0])], open_[1:]
        while queue and len(open_):
            at = queue.pop()
            hit = _near(prints[open_] ^ prints[at], bits)
            if len(hit):
                found = open_[hit].tolist()
                out += [(at, x) for x in found]
                queue += found
                open_ = np.delete(open_, hit)
    return out


def _linked_lists(prints: np.ndarray, edges: np.ndarray, bits: int) -> np.ndarray:
    """Lists that hold a link; short ones are looked through all at once, by the distance of members in their list."""
    sizes = np.diff(edges)
    linked = sizes > SHORT_LIST
    short = np.repeat(~linked, sizes)
    own, held = np.repeat(np.arange(len(sizes)), sizes)[short], prints[short]
    for apart in range(1, min(SHORT_LIST, int(sizes[~linked].max(initial=0)))):
        if len(own) <= apart:
            break
        other = held[apart:] ^ held[:-apart]
        other[own[apart:] != own[:-apart]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        linked[own[apart:][_near(other, bits)]] = True
        # Lists with no members this far apart, and those known to hold a link, are done.
        more = (sizes > apart + 1) & ~linked
        kept = more[own]
        own, held = own[kept], held[kept]
    return np.flatnonzero(linked)


def _links(bits: int):
    """Reads posting lists in order and gives their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def lists(keys: np.ndarray, more: bool) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero((keys[1:, :-1] != keys[:-1, :-1]).any(axis=1)) + 1
            edges = np.concatenate([[0], cut, [len(keys)]])
            if more:
                rest.append(keys[edges[-2] :])
                edges = edges[:-1]
            left, right = [], []
            every = np.ascontiguousarray(keys[: edges[-1], -1]).view(np.uint64)
            for i in _linked_lists(every, edges, bits):
                prints = every[edges[i] : edges[i + 1]]
                for a, b in _forest(prints, bits):
                    left.append(prints[a])
                    right.append(prints[b])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (left, right)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
                keys, rest = np.concatenate([*rest, keys]), []
                yield from lists(keys, True)
        if rest:
            keys, rest = np.concatenate(rest), []
            yield from lists(keys, False)

    return lean(run)


def _byte(position: int) -> int:
    value = 0xFF << (8 * position)
    return value - (1 << 64) if value >> 63 else value


def _posted(prints: DataFrame) -> DataFrame:
    """The first level: (used, key, fp), used being the set of positions that a list has in common, as bits, and key their bytes."""
    posts = []
    for places in FIRST:
        mask = sum(_byte(p) for p in places)
        posts.append(F.struct(F.lit(sum(1 << p for p in places)).alias("used"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return prints.select("fp", F.explode(F.array(*posts)).alias("post")).select("post.used", "post.key", "fp")


def _split(posts: DataFrame, bits: int) -> DataFrame:
    """Members of long lists under one more byte, at the first bits + 1 positions that their list has not used: a linked pair shares one of them."""
    unused = F.lit(0)
    posted = []
    for p in range(POSITIONS):
        free = F.col("used").bitwiseAND(F.lit(1 << p)) == 0
        post = F.struct(F.col("used").bitwiseOR(F.lit(1 << p)).alias("used"), F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_byte(p)).cast("long"))).alias("key"))
        posted.append(F.when(free & (unused <= bits), post))
        unused = unused + free.cast("int")
    return posts.select("fp", F.explode(F.filter(F.array(*posted), lambda x: x.isNotNull())).alias("post")).select("post.used", "post.key", "fp").distinct()


def _search(posts: DataFrame, bits: int, *keys: str) -> DataFrame:
    ordered = posts.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return ordered.mapInArrow(_links(bits), "a long, b long")


def links(prints: DataFrame, bits: int = 3, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose closure is that of all pairs within ``bits`` bits (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("the index guarantees 0 to 3 differing bits")
    posts, found, used = _posted(prints), [], []
    for level in range(len(FIRST[0]), POSITIONS - bits + 1):
        long = settle(posts.groupBy("used", "key").count().filter(F.col("count") > long_list), "simhash-long")
        used.append(long)
        if long.isEmpty():
            found.append(_search(posts, bits, "used", "key"))
            break
        found.append(_search(posts.join(long, ["used", "key"], "left_anti"), bits, "used", "key"))
        still = posts.join(long, ["used", "key"])
        if level < POSITIONS - bits:
            posts = settle(_split(still, bits), "simhash-split")
            used.append(posts)
        else:  # no further byte is guaranteed
            blocks = F.ceil(F.col("count") / F.lit(max(1, long_list // 2))).cast("int")
            own = still.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            met = own.select("used", "key", "fp", "block", pair.alias("other")).select("used", "key", "fp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
            found.append(_search(met, bits, "used", "key", "low", "high"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = settle(out.distinct(), "simhash-links")
    release(*used)
    return out


def roots(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, root), by contraction.

    In each round every node moves to the neighbour, or itself, of the least
    priority, drawn anew by hash; links between moved nodes go on to the next
    round, which has a fraction of the nodes. Nothing is gathered on the driver.
    """
    edges, moves = settle(edges.filter("a <> b"), "links"), []
    while not edges.isEmpty():
        rank = lambda c, n=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("p"), F.col(c).alias("to"))
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), rank("a").alias("r")), F.struct(F.col("a").alias("node"), rank("b").alias("r")), F.struct(F.col("b").alias("node"), rank("b").alias("r")), F.struct(F.col("b").alias("node"), rank("a").alias("r"))))
        move = settle(edges.select(ends.alias("e")).groupBy("e.node").agg(F.min("e.r").alias("r")).select("node", F.col("r.to").alias("to")), "moves")
        moves.append(move)
        left, right = move.select(F.col("node").alias("a"), F.col("to").alias("x")), move.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        past, edges = edges, settle(moved.distinct(), "links")
        release(past)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), "to")
        out = out.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return out


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3, seed: int = 42, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """(members, groups): members has id, fp, code of every row; groups has fp, rows (of that fp), component_id and owner, the least (id, code) of the component."""
    members = settle(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "code")
    prints = settle(members.groupBy("fp").agg(F.min("id").alias("least"), F.min(own).alias("owner"), F.count(F.lit(1)).alias("rows")), "prints")
    tree = roots(links(prints.select("fp"), bits, long_list))
    rooted = settle(prints.join(tree.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), "least", "owner"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("owner").alias("owner"))
    groups = settle(rooted.select("fp", "rows", "root").join(least, "root").select("fp", "rows", "component_id", "owner"), "groups")
    release(prints, rooted)
    return members, groups


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` that own their group: the least id stays. Equal rows (id and text) count as one and both stay; run exact dedup first.

    Only keys of dropped rows are gathered, so texts stay where they are read as
    long as those keys are few; else they meet by shuffle.
    """
    members, groups = near_groups(docs, id_col, text_col, words, bits)
    own_id, own_code, row = fresh(docs, "dropped_id", "dropped_code", "row")
    met = meet(members, groups, "fp", "rows")
    owns = F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("code") == F.col("owner.code"))
    dropped = settle(met.filter(~owns).select(F.col("id").alias(own_id), F.col("code").alias(own_code)).distinct(), "near-dropped")
    release(members, groups)
    keyed = docs.select(F.struct(*map(named, docs.columns)).alias(row), named(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("code"))
    kept = keyed.join(dropped, F.col("id").eqNullSafe(F.col(own_id)) & (F.col("code") == F.col(own_code)), "left_anti")
    return kept.select(f"{row}.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, groups = near_groups(documents(spark, sf_dir))
    return meet(members, groups.select("fp", "rows", "component_id"), "fp", "rows").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
