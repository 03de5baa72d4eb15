"""What callers ask of the engine, hooks, reports, layouts and blocks, on rows worked out by hand."""

import math
import re
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom.engine import Engine
from graphloom.operators import evaluate, hooks, predict, search, vectors
from graphloom.sources import pdf, sinks, store


@pytest.fixture(scope="module")
def engine(spark):
    ents = spark.createDataFrame([
        ("legal_claim:doc:7:1", "legal_claim", "Overcharge", "RENT_OVERCHARGE", None, ["c1"], None), ("legal_claim:doc:70:1", "legal_claim", "Heat", "HABITABILITY_VIOLATION", None, None, None),
        ("evidence:r", "evidence", "rent receipt", None, None, ["c2", "c3"], None), ("evidence:l", "evidence", "lease", None, None, None, ("The lease.",)), ("law:1", "law", "Rent Code", None, None, None, None),
        ("legal_outcome:o", "legal_outcome", "refund", None, None, None, None), ("case_document:a", "case_document", "A v. B", None, "plaintiff_win", None, None), ("case_document:b", "case_document", "C v. D", None, "plaintiff_win", None, None),
    ], "id string, type string, name string, claim_type string, outcome string, chunk_ids array<string>, best_quote struct<text: string>").withColumns({"description": F.lit("x"), "jurisdiction": F.lit("NYC")})
    edges = spark.createDataFrame([
        ("legal_claim:doc:7:1", "evidence:r", "HAS_EVIDENCE"), ("law:1", "legal_claim:doc:7:1", "ADDRESSES"), ("legal_claim:doc:7:1", "legal_outcome:o", "RESULTS_IN"), ("law:1", "legal_outcome:o", "AUTHORIZES"),
        ("case_document:a", "legal_claim:doc:7:1", "ADDRESSES"), ("case_document:b", "legal_claim:doc:7:1", "ADDRESSES"),
    ], "src string, dst string, type string")
    chunks = spark.createDataFrame([("c1", "s", 0, "The first part. Nothing here.", None, "en"), ("c2", "s", 1, "Keep the rent receipt. It is proof of what you paid, whatever the landlord says about it later on.", ["law:1"], "en"), ("c3", "s", 2, "The end.", None, "fr"), ("x1", "t", 0, "other", None, "en")], "chunk_id string, source_id string, chunk_index int, text string, entities array<string>, lang string")
    return Engine(ents, edges, chunks)


@pytest.fixture(scope="module")
def required(spark):
    return spark.createDataFrame([("RENT_OVERCHARGE", "evidence:r", "rent receipt", True), ("RENT_OVERCHARGE", "evidence:l", "lease", False), ("HABITABILITY_VIOLATION", "evidence:p", "photos", True)], "claim_type string, evidence_id string, name string, is_critical boolean")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_chunks_and_entities(engine):
    assert ids(engine.chunks_of_entity("evidence:r"), "chunk_id") == ["c2", "c3"] and ids(engine.chunks_of_entity("law:1"), "chunk_id") == ["c2"]
    assert ids(engine.entities_of_chunk("c2")) == ["evidence:r", "law:1"] and ids(engine.entities_of_chunk("x1")) == []
    assert {r.chunk_id: (r.prev_chunk_id, r.next_chunk_id) for r in engine.adjacent("c1", "c2", "x1").collect()} == {"c1": (None, "c2"), "c2": ("c1", "c3"), "x1": (None, None)}
    assert ids(engine.find_chunks("lang = 'en'", source_id="s", text="RECEIPT"), "chunk_id") == ["c2"] and ids(engine.find_chunks(offset=1, limit=2), "chunk_id") == ["c2", "c3"] and ids(engine.chunk("c3"), "chunk_id") == ["c3"]
    assert {r.id: r.quote.startswith(("Keep the rent receipt.", "The lease.")) for r in engine.best_quote("evidence:r", "evidence:l", "law:1").collect()} == {"evidence:r": True, "evidence:l": True, "law:1": True}


def test_expansion(engine, spark):
    near, lines = engine.expand(spark.createDataFrame([("law:1",)], "id string"))
    assert ids(near) == ["law:1", "legal_claim:doc:7:1", "legal_outcome:o"] and lines.count() == 3


def test_required_evidence_and_chains(engine, required):
    assert [r.evidence_id for r in engine.required_evidence(required, "rent overcharge").collect()] == ["evidence:r", "evidence:l"]
    assert engine.required_evidence(required, "no such thing").count() == 0
    chain = engine.proof_chain(required, "legal_claim:doc:7:1").first()
    assert (chain.presented, chain.missing, chain.outcome, chain.strength) == (["evidence:r"], ["evidence:l"], "legal_outcome:o", "moderate") and chain.completeness == pytest.approx(2 / 3)
    assert ids(engine.document_chains(required, "7"), "claim") == ["legal_claim:doc:7:1"]


def test_situations_are_analysed(engine, required, spark):
    cases = spark.createDataFrame([(1, "My apartment is rent stabilized and this is an overcharge; I have a rent receipt."), (2, "Nothing of the kind"), (3, None)], "case_id long, text string")
    rows = engine.analyze(cases, required).collect()
    assert [r.case_id for r in rows] == [1]
    assert rows[0].claim_type == "RENT_OVERCHARGE" and rows[0].missing == ["lease"] and rows[0].completeness == pytest.approx(2 / 3) and rows[0].laws == ["law:1"] and rows[0].outcome == "favorable" and rows[0].score == pytest.approx(0.7)


def test_calls_are_made_again_up_to_a_cap(spark):
    assert hooks.pauses(4, 2.0, 10.0) == [2.0, 4.0, 8.0, 10.0] and hooks.pauses(0) == []
    waited, failures = [], [ValueError("a"), ValueError("b")]

    def shaky(x):
        if failures:
            raise failures.pop()
        return x

    assert hooks.persistent(shaky, [1, 2, 3], (ValueError,), waited.append)(5) == 5 and waited == [1, 2]
    with pytest.raises(ValueError):
        hooks.persistent(lambda: int("x"), [0, 0], (ValueError,), waited.append)()
    with pytest.raises(TypeError):
        hooks.persistent(lambda: int([]), [0], (ValueError,), waited.append)()


def test_calls_at_a_time_are_bounded(spark):
    def call(row):
        with lock_of():
            open_calls.append(len(open_calls) + 1)
        time.sleep(0.01)
        most = max(open_calls)
        with lock_of():
            open_calls.pop()
        if row["i"] == 13:
            raise ValueError("no luck")
        return f"{row['i']}:{most}"

    lock, open_calls = None, []

    def lock_of():
        nonlocal lock
        lock = lock or threading.Lock()
        return lock

    out = hooks.called(spark.range(40).select(F.col("id").alias("i"), F.lit("x").alias("b")), call, partitions=1, concurrency=4, waits=[0.0]).collect()
    assert len(out) == 40 and [r.error for r in out if r.i == 13] == ["ValueError: no luck"]
    assert all(r.error is None and int(r.answer.split(":")[1]) <= 4 for r in out if r.i != 13)


def test_report_as_a_page(spark, tmp_path):
    sinks.write_report(spark.createDataFrame([("a<b", [1, 2]), (None, None)], "name string, n array<int>"), f"{tmp_path}/r", "html")
    page = "".join(r.value for r in spark.read.text(f"{tmp_path}/r", wholetext=True).collect())
    assert page.startswith("<!DOCTYPE html>") and "<td>a&lt;b</td><td>[1,2]</td>" in page and page.rstrip().endswith("</html>") and page.count("<tr>") == 3
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(1).toDF("a"), f"{tmp_path}/q", "pdf")


def test_vectors_go_beside_their_entities(spark, tmp_path):
    sinks.write_entities_and_vectors(spark.createDataFrame([("law:1", [1.0]), ("law:2", None)], "id string, embedding array<double>"), str(tmp_path))
    assert ids(spark.read.parquet(f"{tmp_path}/entities")) == ["law:1", "law:2"] and ids(spark.read.parquet(f"{tmp_path}/entity_vectors")) == ["entity:law:1"]


def test_tables_lie_by_type_and_key(spark, tmp_path):
    held = store.Store(spark, str(tmp_path))
    held.write("edges", spark.createDataFrame([("a", "b", "CITES"), ("b", "c", "ENABLES"), ("a", "d", None)], "src string, dst string, type string"))
    table = held.read("edges")
    assert sorted((r.src, r.dst, r.type) for r in table.collect()) == [("a", "b", "CITES"), ("a", "d", None), ("b", "c", "ENABLES")]
    plan = table.filter("type = 'CITES' and src = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "EqualTo(src,a)" in plan
    assert table.filter("type = 'CITES'").count() == 1


def cosine(a, b):
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / size if size else 0.0


def test_top_k_in_blocks_is_brute_force(spark):
    draw = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.normal(size=(120, 6)))] + [(500, [0.0] * 6), (501, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = df.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    want = set()
    for q, e in rows[:-1]:
        if q % 20 == 0:
            want |= {(q, i) for _, i in sorted((-round(cosine(e, v), 9), i) for i, v in rows if v is not None)[:5]}
    for block, other in ((2048, 16384), (3, 25)):
        assert {(r.query_id, r.id) for r in vectors.top_k(asked, df, 5, block, other).collect()} == want
    label = df.filter("id < 30").select(F.concat(F.lit("n"), "id").alias("name"), "embedding")
    got = [sorted((r.id, r.name, round(r.score, 6)) for r in vectors.nearest(df.filter("id < 100"), label, 0.2, block).collect()) for block in (10_000, 7)]
    assert got[0] == got[1] and len(got[0]) > 50


def test_types_join_the_nearest_before_them():
    at = lambda a: [math.cos(a), math.sin(a)]
    held = {"a": at(0), "b": at(0.5), "c": at(0.9), "d": at(2.0)}
    assert vectors.canonical_types(["a", "b", "c", "d"], held, 0.85) == (["a", "c", "d"], {"a": "a", "b": "a", "c": "c", "d": "d"})
    assert vectors.canonical_types(["c", "b", "a", "d"], held, 0.85) == (["c", "a", "d"], {"c": "c", "b": "c", "a": "a", "d": "d"})


def test_similar_cases_in_blocks(spark, monkeypatch):
    cases = spark.createDataFrame([(f"case:{i}", f"case about heat {i}", "d", ("plaintiff_win", "defendant_win", "settlement")[i % 3], "NYC") for i in range(40)], "id string, name string, description string, outcome string, jurisdiction string")
    asked = spark.createDataFrame([(i, "heat" if i % 2 else "3", 0.7, "NYC") for i in range(6)], "query_id int, issue string, completeness double, wanted string")
    want = sorted(map(tuple, predict.similar_cases(cases, asked, 5).collect()))
    monkeypatch.setattr(predict, "SENT_QUERIES", 2)
    assert sorted(map(tuple, predict.similar_cases(cases, asked, 5).collect())) == want and len(want) == 30


def test_approximate_pairs_reach_their_recall(spark, sf):
    held = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    exact = {(r.a, r.b) for r in vectors.similar_pairs(held.withColumn("grp", F.lit(0)), 0.3).collect()}
    found = {(r.a, r.b) for r in vectors.approximate_pairs(held, 0.3).collect()}
    print("recall", len(found & exact) / len(exact), "of", len(exact))
    assert found <= exact and len(found) >= 0.9 * len(exact)


def test_passages_in_texts_are_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    texts, passages = docs.collect(), items.collect()
    want = {(p.query_id, t.id) for p in passages for t in texts if p.text and t.text and p.text in t.text}
    found = search.texts_with_passages(items, docs)
    assert {(r.query_id, r.id) for r in found.collect()} == want and want
    ranked = search.search(items, docs, ["text"], 10)
    first = ranked.filter("rank = 1").select("query_id", "id")
    metrics = {r.query_id: r for r in evaluate.retrieval_metrics(ranked, found).collect()}
    top = {(r.query_id, r.id) for r in ranked.collect()}
    for q in {q for q, _ in want}:
        own = {i for x, i in want if x == q}
        assert metrics[q].recall == pytest.approx(len({i for x, i in top if x == q} & own) / len(own))
    assert first.count() == len(passages)


def small_pdf(pages, packed):
    """A file with one content stream for each page, compressed or not."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)]
    objects = list(enumerate(parts, 1))
    for i, content in enumerate(pages):
        stream = zlib.compress(content) if packed else content
        objects += [(10 + i, b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (50 + i)), (50 + i, b"<< /Length %d%s >>\nstream\n" % (len(stream), b" /Filter /FlateDecode" if packed else b"") + stream + b"\nendstream")]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in reversed(objects)) + b"%%EOF"


def test_pdf_pages_one_after_the_other(spark, tmp_path):
    pages = [rb"BT /F1 12 Tf 72 700 Td (Case \(one\)) Tj 0 -14 Td [(Heat) -300 (and) 20 (hot water)] TJ T* (caf\351) Tj ET", b"BT <feff0041263a> Tj (next) ' ET"]
    want = "Case (one)\nHeat andhot water\ncafé\nA☺\nnext"
    for packed in (False, True):
        assert pdf.text_of(small_pdf(pages, packed)) == want
    (tmp_path / "a.pdf").write_bytes(small_pdf(pages, True))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = {r.path[-5:]: r.text for r in pdf.pdf_text(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.pdf": want, "b.pdf": None}


def test_recognised_names_are_masked(spark):
    def recognise(text):
        if "fail" in text:
            raise ValueError
        return [(m.start(), m.end(), "PERSON") for m in re.finditer("Ann( Lee)?", text)] + [(m.start(), m.end(), "GPE") for m in re.finditer("Lee|Rome", text)] + [(0, 1, "DATE")]

    rows = spark.createDataFrame([(1, "Ann Lee of Rome"), (2, "fail Ann"), (3, None), (4, "Lee")], "id long, text string")
    assert {r.id: r.text for r in hooks.masked(rows, recognise).collect()} == {1: "[NAME] of [LOCATION]", 2: "fail Ann", 3: None, 4: "[LOCATION]"}
