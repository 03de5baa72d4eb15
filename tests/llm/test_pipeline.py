import math
from collections import Counter, defaultdict

import corpus_pipeline
from graphloom.llm import packing

from .cases import awkward, empty
from .test_corpus import check_packing, count, shared_out
from .test_dedup import brute_components, brute_prints


def test_stages_keep_the_columns(spark, tmp_path):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
            out.write.parquet(f"{tmp_path}/{name}-{docs.isEmpty()}")
            docs = spark.read.parquet(f"{tmp_path}/{name}-{docs.isEmpty()}") if not docs.isEmpty() else out
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_every_stage_has_its_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf).cache()
        if name == "exact_dedup":
            assert out.count() == docs.select("text").distinct().count()
            assert {r.doc_id for r in out.collect()} == {r.m for r in docs.groupBy("text").agg({"doc_id": "max"}).toDF("text", "m").collect()}
        docs = out
    packed = corpus_pipeline.run(spark, sf)
    assert packed.filter("start = 0").select("doc_id").distinct().count() <= docs.count()


def brute_mix(spark, docs):
    """Times by document: sorted by key within each source, one after the other."""
    from pyspark.sql import functions as F

    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.shiftrightunsigned(F.xxhash64(F.lit(2), F.col("doc_id").cast("string"), F.xxhash64(F.coalesce("text", F.lit("")))), 11).alias("bits")).collect()
    size = {r.doc_id: count(r.text) for r in rows}
    sums = defaultdict(int)
    for r in rows:
        sums[r.source] += size[r.doc_id]
    target, times = shared_out(sums), {}
    for source in sums:
        keyed = []
        for r in rows:
            if r.source == source:
                n = size[r.doc_id]
                weight = max(0.1, (1.0 if 3 <= len(r.text) / max(n, 1) <= 12 else 0.4) * n / (n + 50))
                keyed.append((-math.log((r.bits + 0.5) / (1 << 53)) / weight, r.doc_id))
        epochs = math.floor(target[source] / sums[source] + 1e-12) if sums[source] else 0
        rest, before = target[source] - epochs * sums[source], 0
        for _, doc_id in sorted(keyed):
            times[doc_id] = epochs + (size[doc_id] > 0 and before + size[doc_id] / 2 < rest)
            before += size[doc_id]
    return times


def test_stages_are_brute_force(spark, tmp_path):
    """Each stage on what the last one kept, in plain Python on whole texts."""
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    longest = sorted(table.collect(), key=lambda r: -len(r.text))[:6]
    near = [(80_000 + i, f"{r.text} Addendum {i}.", r.lang, r.source, None) for i, r in enumerate(longest)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(spark.createDataFrame([*near, (90_001, None, "en", "src0", None), (90_002, "!!! 123", "en", "src1", 7), (90_003, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        stages[name](spark, df, sf).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    kept = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    out = step("language_id", docs)
    assert sorted(r.doc_id for r in out.collect()) == sorted(kept) and len(kept) == docs.count() - 3
    owner = {}
    for i, text in kept.items():
        owner[text] = max(owner.get(text, -1), i)
    out = step("exact_dedup", out)
    assert sorted((r.text, r.doc_id) for r in out.collect()) == sorted(owner.items())
    left = sorted((i, t) for t, i in owner.items())
    least = {c for _, _, c in brute_components(brute_prints(left))}
    out = step("simhash_near_dedup", out)
    assert {r.doc_id for r in out.collect()} == least and out.count() == len(least) < len(left)
    times = brute_mix(spark, out)
    mixed = step("mixing", out)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    packed = step("packing", mixed).collect()
    assert check_packing([(r.doc_id, r.text) for r in mixed.collect()], packed) < 0.03
    n = sum(len(packing.token_ids(r.text)) + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == n


def test_pipeline_on_empty_and_on_textless_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("empty", []), ("nulls", [(i if i else None, (None, "", " \t", "123 !")[i % 4], None, None, None) for i in range(9)]), ("one", [(1, "one text", None, None, None)] * 3)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(out) == 0 if name != "one" else {r.doc_id for r in out} <= {1}
