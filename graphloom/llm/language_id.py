"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds (multiplies) the
vectors of its letters, each permuted (rotated) by its distance from the end;
a text bundles (adds) its n-grams, and so does a language over its labelled
texts. A text gets the language whose bundle has the largest cosine.

Texts are lower-cased; whatever is not a letter counts as a space, and spaces
in a row as one. Prototypes are fitted on a bounded sample: of each language
the labelled rows with the smallest hash of id and text, ``per_language`` at most.
Rows equal in both share a hash; so many of them that they alone would go over
the bound are left out of the sample, unless the language has no others.
Prediction covers every whole text; long ones are bundled in slices that overlap by n - 1.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing was learned. Ties go to the first language in code
point order. Rows with a null language, or that the caller holds out, are not
learned from. Only text is read for a prediction. Empty tables give no rows.
The prototypes on the driver take languages x dimensions numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import documents, fresh, lean, named, settle

UND = "und"
DIMENSIONS, ORDER, PER_LANGUAGE = 1024, 3, 3000
#: Letters of a slice, letters that are bundled at a time, and n-gram vectors that a worker keeps.
SLICE, TOGETHER, KEPT = 100_000, 400_000, 30_000


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: itself if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    points = [c for c in range(0x110000) if chr(c).isalpha()]
    table[points] = points
    return table


@lru_cache(4096)
def _letter(point: int, dimensions: int) -> np.ndarray:
    bits = np.random.Generator(np.random.PCG64(point + 1)).integers(0, 2, dimensions, np.int8)
    return 2 * bits - 1


class Bundler:
    """Bundles of texts; keeps the vectors of n-grams it has met."""

    def __init__(self, dimensions: int, order: int) -> None:
        self.dimensions, self.order = dimensions, order
        self.place: dict[int, int] = {}
        self.vectors = np.empty((1024, dimensions), np.float32)

    def _places(self, codes: np.ndarray) -> np.ndarray:
        if len(self.place) + len(codes) > KEPT:
            self.place.clear()
        if len(codes) > len(self.vectors) - len(self.place):
            grown = np.empty((max(2 * len(self.vectors), len(self.place) + len(codes)), self.dimensions), np.float32)
            grown[: len(self.place)] = self.vectors[: len(self.place)]
            self.vectors = grown
        out = np.empty(len(codes), np.int64)
        for i, code in enumerate(codes.tolist()):
            at = self.place.get(code)
            if at is None:
                at = self.place[code] = len(self.place)
                bound = np.ones(self.dimensions, np.int8)
                for k in range(self.order):
                    bound = bound * np.roll(_letter((code >> (21 * k)) & 0x1FFFFF, self.dimensions), k)
                self.vectors[at] = bound
            out[i] = at
        return out

    def slices(self, text: str) -> Iterator[np.ndarray]:
        """Codes of the n-grams, slice by slice; nothing for a text without letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        held = _letters()[points].astype(np.uint64)
        if not held.any():
            return
        held = np.concatenate([[np.uint64(0)], held, [np.uint64(0)]]).astype(np.uint64)
        held = held[np.concatenate([[True], (held[1:] != 0) | (held[:-1] != 0)])]
        n = len(held) - self.order + 1
        for a in range(0, n, SLICE):
            b = min(a + SLICE, n)
            code = np.zeros(b - a, np.uint64)
            for k in range(self.order):
                code |= held[a + self.order - 1 - k : b + self.order - 1 - k] << np.uint64(21 * k)
            yield code

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text; zero where it has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        codes: list[np.ndarray] = []
        rows: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            for code in self.slices(text or ""):
                codes.append(code)
                rows.append(i)
                held += len(code)
                if held > TOGETHER:
                    self._add(out, codes, rows)
                    codes, rows, held = [], [], 0
        if codes:
            self._add(out, codes, rows)
        return out

    def _add(self, out: np.ndarray, codes: list[np.ndarray], rows: list[int]) -> None:
        distinct, where = np.unique(np.concatenate(codes), return_inverse=True)
        part = max(1, KEPT // 3)
        segment = np.repeat(np.arange(len(rows)), [len(c) for c in codes])
        for a in range(0, len(distinct), part):
            places = self._places(distinct[a : a + part])
            inside = (where >= a) & (where < a + part)
            counts = np.bincount(segment[inside] * len(places) + where[inside] - a, minlength=len(rows) * len(places)).reshape(len(rows), -1)
            np.add.at(out, rows, counts.astype(np.float32) @ self.vectors[places])


def prototypes(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = PER_LANGUAGE, dimensions: int = DIMENSIONS, order: int = ORDER) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their unit bundles."""
    labelled = docs.filter(learn & named(lang_col).isNotNull() & named(text_col).isNotNull())
    draw = F.xxhash64(named(key_col).cast("string"), named(text_col), F.lit(9))
    first = labelled.select(named(lang_col).cast("string").alias("lang"), draw.alias("draw"))
    # The smallest hashes are ranked among twice as many as are wanted, not among all rows of a language.
    sizes = {r.lang: r.n for r in first.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2.0 * per_language / n)))) if sizes else F.create_map().cast("map<string,double>")
    first = first.filter((F.col("draw").cast("double") / float(1 << 64) + 0.5) <= F.try_element_at(share, F.col("lang")))
    drawn = first.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")).withColumn("many", F.col("n") > per_language)
    rising = Window.partitionBy("lang").orderBy("many", "draw")
    drawn = drawn.withColumn("rows", F.sum("n").over(rising)).withColumn("turn", F.row_number().over(rising)).filter((F.col("rows") <= per_language) | (F.col("turn") == 1))
    # For each language one number comes to the driver, and the hash of copies if it has nothing else; texts are filtered where they are read and not dealt out.
    limits = drawn.groupBy("lang").agg(F.max("draw").alias("limit"), F.bool_or("many").alias("many")).collect()
    bound = F.create_map(*(F.lit(x) for r in limits for x in (r.lang, r.limit))) if limits else F.create_map().cast("map<string,bigint>")
    over = settle(first.groupBy("lang", "draw").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_language).select("lang", "draw"), "languages-over")
    only = [r.lang for r in limits if r.many]
    chosen = labelled.select(named(lang_col).cast("string").alias("lang"), draw.alias("draw"), named(text_col).alias("text")).filter(F.col("draw") <= F.try_element_at(bound, F.col("lang")))
    chosen = chosen.join(over.filter(~F.col("lang").isin(only)), ["lang", "draw"], "left_anti").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dimensions, order), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = bundler.bundles([t for x, t in zip(langs, texts, strict=True) if x == lang])
                sums[lang] = sums.get(lang, 0) + own.sum(axis=0, dtype=np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "sums"])

    parts = chosen.mapInArrow(lean(run), "lang string, sums array<double>").select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    rows = sorted(tuple(r) for r in parts.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x.v)).collect())
    kept = [(lang, np.array(v)) for lang, v in rows if np.any(v)]
    return [lang for lang, _ in kept], np.array([v / np.linalg.norm(v) for _, v in kept]).reshape(len(kept), dimensions)


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, text_col: str = "text", carry: tuple[str, ...] = (), order: int = ORDER, as_names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``carry``, then the language and the cosine (0 where negative) of every row."""
    dimensions, compared = profiles.shape[1], profiles.astype(np.float32).T
    (label, score) = as_names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions, order)
        for batch in batches:
            sums = bundler.bundles(batch.column(batch.num_columns - 1).to_pylist())
            size = np.sqrt(np.einsum("ij,ij->i", sums, sums, dtype=np.float64))
            if langs:
                cosine = (sums @ compared) / np.maximum(size, 1e-9)[:, None]
                best = cosine.argmax(axis=1)
                value = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)
                names = [langs[b] if s else UND for b, s in zip(best.tolist(), size.tolist(), strict=True)]
                value[size == 0] = 0
            else:
                names, value = [UND] * len(size), np.zeros(len(size))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(value)], names=[*carry, label, score])

    fields = T.StructType([*(docs.schema[c] for c in carry), T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.select(*(named(c).alias(f"c{i}") for i, c in enumerate(carry)), named(text_col).alias("text")).mapInArrow(lean(run), fields)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(named(id_col).cast("string")) % 5 == 0, F.lit(False))


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` in which a language was found, all columns as they were."""
    langs, profiles = prototypes(docs, F.lit(True), text_col, lang_col, id_col)
    if not langs:
        return docs.filter(F.lit(False))
    label, score = fresh(docs, "lang_pred", "score")
    return predict(docs, langs, profiles, text_col, tuple(docs.columns), as_names=(label, score)).filter(named(label) != UND).select(*map(named, docs.columns))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", held_out())
    langs, profiles = prototypes(docs, ~F.col("held_out") & F.col("doc_id").isNotNull())
    return predict(docs, langs, profiles, carry=("doc_id", "held_out"))
