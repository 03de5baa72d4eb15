"""Spelling variants: words of a corpus that differ by one code point, found by two-dimensional range reporting.

Every word is a point: its place in the forward order of all words, and its place
in the order of the words read backwards. A word that differs from w at position
i has w's first i code points, which are an interval of the forward order, and
the rest of w after the edit, an interval of the backward order; the points in
the rectangle of both intervals are the words sought. A wavelet tree over the
places reports them in a logarithmic number of steps a point. A replaced code
point is looked for among words of the same length, an inserted one among those
one longer; a deletion is an insertion seen from the other word.

Words of one length and the next make a class. A class of more than ``TARGET``
code points is divided: an edit in the left half of the positions leaves the right half
of the word as it is, and the other way round, so words that share this half meet
in a group of their own, once for each half. Groups that are still too large are
divided again, at last down to one position, where a group has one word for each code point at
most. Groups of a class are dealt into tasks by hash. So nothing is gathered that
grows with the corpus, and no pair of words is compared that shares no key.

Defined results: null texts and null words have no words; a null document id
counts as the empty text in the hash; repeated rows count each for itself; ties
of the form go to the smallest word in code-point order. Very long words are
taken whole. Empty tables give no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, lean, named, release, settle

#: Code points and occurrences that make a word; how many times the count of a word its form has.
LEAST_LENGTH, LEAST_COUNT, FORM = 5, 3, 2
#: One in so many runs of a document has a code point deleted (the contract's damage).
DAMAGE = 97
#: Code points of a group that meets in one task.
TARGET = 400_000
#: Distinct words that a task counts before it hands on what it has.
HELD = 300_000
#: Latin-1 bytes of letters, A-Z as a-z, all else as blanks; a code point beyond Latin-1 becomes "?", which is no letter.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 32 for c in range(256))


def count_runs(held: Counter, doc_id: object, text: str, damage: int = DAMAGE) -> None:
    """Adds the runs of letters of a text, as Latin-1, to ``held``; those whose hash ``damage`` divides (0: none) lack a code point."""
    letters = text.encode("latin-1", "replace").translate(_LETTERS)
    runs = letters.split()
    held.update(runs)
    if not damage:
        return
    head, crc, plain = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32, letters.isascii()
    hashes = {run: crc(run if plain or run.isascii() else run.decode("latin-1").encode(), head) for run in set(runs)}
    for run in [run for run, h in hashes.items() if h % damage == 0]:
        at, n = hashes[run] % len(run), runs.count(run)
        held[run] -= n
        held[run[:at] + run[at + 1 :]] += n


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """The words of whole texts with how often they occur: word, n. Each task folds its own rows before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if n and len(w) >= least_length}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in kept], pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count_runs(held, doc_id, text, damage)
                if len(held) > HELD:
                    yield told()
        yield told()

    rows = docs.select(named(id_col), named(text_col)).filter(named(text_col).isNotNull())
    return rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


class WaveletTree:
    """Places of points: for each forward place the backward place, as a bit vector for each binary digit with its prefix counts."""

    def __init__(self, places: np.ndarray) -> None:
        self.digits = max(1, int(places.max(initial=0)).bit_length())
        self.zeros, self.before = [], []
        for digit in range(self.digits - 1, -1, -1):
            bits = (places >> digit) & 1
            self.before.append(np.concatenate([[0], np.cumsum(1 - bits)]))  # zeros before each place
            self.zeros.append(int(self.before[-1][-1]))
            places = np.concatenate([places[bits == 0], places[bits == 1]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rectangles [left, right) by [low, high): (number of the rectangle, backward place) of every point in them."""
        which = np.flatnonzero((left < right) & (low < high))
        left, right, low, high, value = left[which], right[which], low[which], high[which], np.zeros(len(which), np.int64)
        for level, (before, zeros) in enumerate(zip(self.before, self.zeros, strict=True)):
            span = 1 << (self.digits - 1 - level)
            a, b = before[left], before[right]
            first = (a < b) & (value < high) & (value + span > low)
            second = (left - a < right - b) & (value + span < high) & (value + 2 * span > low)
            pick = lambda x, y: np.concatenate([x[first], y[second]])  # noqa: B023, E731
            which, low, high = pick(which, which), pick(low, low), pick(high, high)
            left, right, value = pick(a, zeros + left - a), pick(b, zeros + right - b), pick(value, value + span)
        return which, value


def _sorted_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The order of the words, and how many first code points each shares with the one before it in that order."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    shared = np.zeros(len(words) + 1, np.int64)
    width = max(map(len, words), default=0)
    step = max(1, 8_000_000 // (width + 1))
    for at in range(1, len(words), step):
        part = [words[i] for i in order[at - 1 : at + step]]
        codes = np.array(part, f"U{max(1, width)}").view(np.uint32).reshape(len(part), -1)
        apart = codes[1:] != codes[:-1]
        shared[at : at + len(part) - 1] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return order, shared


def _intervals(place: np.ndarray, shared: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval of places of words that share their first ``size`` code points with the word at each of ``place``."""
    edge = np.flatnonzero(shared[:-1] < size) if size else np.zeros(1, np.int64)
    at = np.searchsorted(edge, place, "right")
    return edge[at - 1], np.append(edge, len(shared) - 1)[at]


def neighbours(words: list[str], size: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of distinct words that differ by one edit at a position in [first, end): i of ``size`` code points, j of as many or of one more; each pair once.

    ``words`` have ``size`` or ``size + 1`` code points. An inserted code point stands at the first position where both words differ.
    """
    order, shared = _sorted_words(words)
    back_order, back_shared = _sorted_words([w[::-1] for w in words])
    place, back = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
    place[order], back[back_order] = np.arange(len(words)), np.arange(len(words))
    short = np.array([len(w) == size for w in words], bool)
    own = np.flatnonzero(short)
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # What a word shares with its neighbours in an order is the most it shares with any word, so positions beyond that need no look.
    reach = np.maximum(shared[place[own]], shared[place[own] + 1])
    back_reach = np.maximum(back_shared[back[own]], back_shared[back[own] + 1])
    for kind, longer in ((short, 0), (~short, 1)):
        count, back_count = (np.concatenate([[0], np.cumsum(kind[o])]) for o in (order, back_order))
        if not count[-1]:
            continue
        rank = back_count[back]  # backward places among words of this kind
        member = np.flatnonzero(kind)[np.argsort(rank[kind], kind="stable")]  # the word at each such place
        tree = WaveletTree(rank[order[kind[order]]])
        least = np.maximum(first, size - 1 + longer - back_reach)
        most = np.minimum(min(end, size + longer) - 1, reach)
        live = np.flatnonzero(least <= most)
        if not len(live):
            continue
        steps = np.zeros(size + 3, np.int64)
        np.add.at(steps, least[live], 1)
        np.add.at(steps, most[live] + 1, -1)
        for at in np.flatnonzero(np.cumsum(steps) > 0).tolist():
            ask = own[live[(least[live] <= at) & (at <= most[live])]]
            left, right = _intervals(place[ask], shared, at)
            low, high = _intervals(back[ask], back_shared, size - 1 + longer - at)
            which, value = tree.report(count[left], count[right], back_count[low], back_count[high])
            i, j = ask[which], member[value]
            if longer:
                keep = np.array([at == size or words[a][at] != words[b][at] for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
            else:
                keep = i < j  # a pair of one length is found from both ends
            found_i.append(i[keep])
            found_j.append(j[keep])
    return np.concatenate(found_i), np.concatenate(found_j)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds the hash of what all words of a group share: the code points before ``first`` and from ``end`` on, one further in the longer words."""
    rest = F.col("end") + 1 + (F.length("word") - F.col("size"))  # from 1
    return rows.withColumn("key", F.xxhash64("size", "first", "end", F.substr("word", F.lit(1), F.col("first")), F.substr("word", rest)))


def groups(words: DataFrame, target: int = TARGET) -> DataFrame:
    """Words with the groups in which they meet all their near words: word, n, size (of the shorter words), first and end (positions of edits), task."""
    size = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("size")).filter("size > 0")
    rows = _keyed(roles.withColumn("first", F.lit(0)).withColumn("end", F.col("size") + 1))
    done, held, level = None, settle(rows, "spelling-roles"), 0
    while True:
        loads = settle(held.groupBy("size", "first", "end", "key").agg(F.sum(F.length("word").cast("long")).alias("load"), F.max(F.length("word") - F.col("size")).alias("longer"), F.min(F.length("word") - F.col("size")).alias("least"), F.count(F.lit(1)).alias("held")), "spelling-loads")
        # A word alone meets nobody, nor do longer words without a shorter one.
        large = (F.col("load") > target) & (F.col("end") - F.col("first") > 1)
        useful = (F.col("held") > 1) & (F.col("least") == 0)
        tasks = loads.filter(useful & ~large).groupBy("size", "first", "end").agg(F.ceil(F.sum("load") / F.lit(target)).cast("int").alias("tasks"))
        met = held.join(loads.select("key", "size", "first", "end", "load", "held", "least"), ["size", "first", "end", "key"]).filter(useful)
        ready = met.filter(~large).join(tasks, ["size", "first", "end"]).select("word", "n", "size", "first", "end", F.pmod("key", F.col("tasks").cast("long")).alias("task"))
        done = ready if done is None else done.unionByName(ready)
        if loads.filter(useful & large).isEmpty():
            return done
        half = F.floor((F.col("first") + F.col("end")) / 2).cast("int")
        parts = F.array(F.struct("first", half.alias("end")), F.struct(half.alias("first"), "end"))
        split = met.filter(large).select("word", "n", "size", F.explode(parts).alias("part")).select("word", "n", "size", "part.first", "part.end")
        level += 1
        held = settle(_keyed(split), f"spelling-half-{level}")


_BY = ("size", "first", "end", "task")


def near_pairs(words: DataFrame, target: int = TARGET) -> DataFrame:
    """All pairs of distinct words (rows of word, n) that differ by one inserted, deleted or replaced code point: word_a, n_a, word_b, n_b, each pair once, the longer word or the later row as b."""

    def run(part: pa.Table) -> pa.Table:
        (words, n), (i, j) = _words(part), _near(part)
        return pa.table({"word_a": words.take(i), "n_a": n[i], "word_b": words.take(j), "n_b": n[j]})

    return groups(words, target).groupBy(*_BY).applyInArrow(run, "word_a string, n_a long, word_b string, n_b long")


def _words(part: pa.Table) -> tuple[pa.Array, np.ndarray]:
    return part["word"].combine_chunks(), part["n"].to_numpy()


def _near(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return neighbours(part["word"].to_pylist(), *(part[c][0].as_py() for c in ("size", "first", "end")))


def _best(part: pa.Table) -> pa.Table:
    """For each word of a group with near words there: word, n_near, form_n, form (the best of them)."""
    (column, n), (i, j) = _words(part), _near(part)
    words = column.to_pylist()
    me, other = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -n[other], me))
    me, other = me[order], other[order]
    at = np.flatnonzero(np.append(True, me[1:] != me[:-1])[: len(me)])
    return pa.table({"word": column.take(me[at]), "n_near": np.diff(np.append(at, len(me))), "form_n": n[other[at]], "form": column.take(other[at])})


def forms(words: DataFrame, target: int = TARGET, times: int = FORM) -> DataFrame:
    """Words (word, n) with n_near, form and form_n: the near word of largest n if it has ``times`` n at least."""
    words = settle(words, "spelling-words")
    found = groups(words, target).groupBy(*_BY).applyInArrow(_best, "word string, n_near long, form_n long, form string")
    best = F.struct((-F.col("form_n")).alias("less"), "form")
    told = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.when(F.col("form").isNotNull(), best).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast(told.schema["best"].dataType).alias("best"))
    each = told.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    ok = -F.col("best.less") >= F.lit(times) * F.col("n")
    return each.select("word", "n", "n_near", F.when(ok, F.col("best.form")).alias("form"), F.when(ok, -F.col("best.less")).alias("form_n"))


def roots(table: DataFrame) -> DataFrame:
    """Adds root: from a word along its forms to the last one. Counts at least double at each step, so chains are short; every round doubles the way that is known."""
    table = settle(table, "spelling-forms")
    way = settle(table.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-way")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if way.join(further, "root", "left_semi").isEmpty():
            break
        longer = settle(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-way")
        release(way)
        way = longer
    return table.join(way, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, target: int = TARGET) -> DataFrame:
    """The words of a corpus with the variants' forms and roots: word, n, n_near, form, form_n, root."""
    return roots(forms(word_counts(docs, id_col, text_col, damage, least_length, least_count), target))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
