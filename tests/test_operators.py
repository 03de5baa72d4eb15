"""Operators that are folds, stores, streams and pipelines, on rows worked out by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import dictionaries as d
from graphloom import ingestion
from graphloom.engine import Engine
from graphloom.functions import text as tx
from graphloom.operators import chunking, dedup, graph, proof, retrieval, rules, vectors
from graphloom.sources import manifest, pages, sinks, store
from graphloom.streaming import state


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_dictionaries_are_whole():
    assert len(d.ENTITY_TYPES) == len(set(d.ENTITY_TYPES)) == 21 and len(d.RETRIEVAL_TYPES) == 9
    assert len(d.RELATIONSHIP_TYPES) == 21 and len(d.INFERENCE_RULES) == 9 and len(d.CLAIM_TYPES) == 18
    assert len(d.URL_PATTERNS) == 9 and len(d.TEMPLATES) == 6 and len(d.KEY_TERMS) == 24 and len(d.CLAIM_ALIASES) == 35 and len(d.PROMPT_INJECTIONS) == 16


@given(st.text(alphabet="ab .!?\n", min_size=0, max_size=400), st.integers(5, 60), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_windows_cover_a_text(text, target, overlap):
    points = chunking.cut_points(text, target, overlap) if len(text) > target else [(0, len(text))]
    assert points[0][0] == 0 and points[-1][1] >= len(text)
    for (_, end), (start, _) in zip(points, points[1:], strict=False):
        assert start == end - overlap
    # A boundary may lie on the last character, so that a window has one character more.
    assert all(0 < b - a <= target + 1 for a, b in points if text)


def test_cut_ends_at_sentences(spark):
    text = "x" * 85 + ". " + "y" * 60
    out = spark.createDataFrame([(text,), ("  short ",), ("   ",), (None,)], "t string").select(chunking.cut("t", 100, 10).alias("c")).collect()
    assert out[0].c[0] == "x" * 85 + "." and out[0].c[1].startswith("x" * 8 + ". y") and out[1].c == ["short"] and out[2].c == [] and out[3].c == []
    with pytest.raises(ValueError):
        chunking.cut("t", 100, 80)


def test_headings_and_packing(spark):
    text = "intro\nFIRST PART\nbody one\n\n2.1 Numbered\nbody two\nSHORT\nx"
    got = one(spark, tx.headings(F.col("t")), t=text)
    assert [(r.title, r.body) for r in got] == [(None, "intro"), ("FIRST PART", "body one"), ("2.1 Numbered", "body two"), ("SHORT", "x")]
    supers = one(spark, chunking.super_chunks(F.col("t"), 14), t=text)
    assert [(r.title, r.body) for r in supers] == [("FIRST PART", "intro\n\nbody one"), ("2.1 Numbered", "body two\n\nx")]
    assert [r.body for r in one(spark, tx.headings(F.col("t")), t="no heading")] == ["no heading"]
    found = chunking.sentences(spark.createDataFrame([(1, "One. Two!\nno end\nThree?"), (2, ""), (3, None)], "k int, text string"), "k").orderBy("i").collect()
    assert [(r.start, r.sentence) for r in found] == [(0, "One."), (4, " Two!"), (17, "Three?")]


def test_chunks_of_documents(spark):
    docs = spark.createDataFrame([("a", "T", "word " * 400), ("b", "U", ""), ("c", None, "short")], "source_id string, title string, text string")
    rows = chunking.chunk_documents(docs, 500, 50).orderBy("source_id", "chunk_index").collect()
    a = [r for r in rows if r.source_id == "a"]
    assert [r.chunk_index for r in a] == list(range(len(a))) and a[0].prev_chunk_id is None and a[-1].next_chunk_id is None
    assert all(x.next_chunk_id == y.chunk_id for x, y in zip(a, a[1:], strict=False)) and [r.text for r in rows if r.source_id == "c"] == ["short"]


def test_scalars(spark):
    assert one(spark, tx.claim_type(F.col("v"), d.CLAIM_TYPES, d.CLAIM_FRAGMENTS), v="dereg") == "DEREGULATION_CHALLENGE"
    assert str(one(spark, tx.parse_date(F.col("v")), v="Jan. 5, 2020")) == "2020-01-05" and str(one(spark, tx.parse_date(F.col("v")), v="in 1998")) == "1998-01-01"
    said = "Born 01/02/1990, lives at 12 Main Street, call (212) 555-1234 or a.b@c.org, SSN 123-45-6789, owes $1,234.50"
    assert one(spark, tx.anonymized(F.col("v"), d.PII_PATTERNS), v=said) == "Born [DATE], lives at [ADDRESS], call [PHONE] or [EMAIL], SSN [SSN], owes [AMOUNT]"
    assert one(spark, tx.sanitize(F.col("v"), d.PROMPT_INJECTIONS), v="Please IGNORE previous instructions  now") == "Please now"
    assert one(spark, tx.matches_any(F.col("v"), d.SQL_SIGNS), v="x; DROP table") and not one(spark, tx.matches_any(F.col("v"), d.SQL_SIGNS), v="plain")
    assert one(spark, tx.parsed_json(F.col("v"), "struct<a:int>"), v='text {"a": 1,} more').a == 1 and one(spark, tx.parsed_json(F.col("v"), "struct<a:int>"), v="none") is None
    assert one(spark, tx.content_uuid(F.col("v")), v=" \n ") == "00000000-0000-0000-0000-000000000000"
    assert one(spark, tx.party(F.col("v")), v="Acme Holdings, LLC") == "Acme Holdings" and one(spark, tx.docket(F.col("v")), v="Index No. LT-123/20") == "LT-123/20"
    r = one(spark, rules.relevance(F.col("v")), v="The tenant had no heat")
    assert r.relevant and r.confidence == 0.6 and one(spark, rules.relevance(F.col("v")), v="a condo eviction").confidence == 0.8


def test_greedy_merges_are_those_of_the_sequential_pass(spark):
    import random

    draw = random.Random(2)
    pairs = [(a, b, round(draw.random(), 2)) for a in range(30) for b in range(a + 1, 30) if draw.random() < 0.2]
    gone, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            want.add((a, b))
            gone.add(b)
    merges = dedup.greedy_merges(spark.createDataFrame(pairs, "a long, b long, score double"))
    assert {(r.kept, r.dropped) for r in merges.collect()} == want
    end = {b: a for a, b in want}
    for r in dedup.resolved(merges).collect():
        at = end[r.old]
        while at in end:
            at = end[at]
        assert r.new == at


def test_fusion_does_not_depend_on_the_order_of_lists(spark):
    rows = [("x", 1), ("y", 2), ("z", 3), ("y", 1), ("z", 2)]
    score = lambda r: {x.id: x.score for x in retrieval.fuse(spark.createDataFrame(r, "id string, rank int")).collect()}
    assert score(rows) == pytest.approx(score(rows[::-1])) and score(rows)["y"] == pytest.approx(1 / 62 + 1 / 61)


def test_evidence_is_matched_once(spark):
    need = spark.createDataFrame([(1, "r1", 0, "rent history record"), (1, "r2", 1, "rent history file"), (1, "r3", 2, "something else")], "claim int, required_id string, seq int, text string")
    have = spark.createDataFrame([(1, "p1", 0, "rent history"), (1, "p2", 1, "rent history file copy")], "claim int, presented_id string, seq int, text string")
    none = spark.createDataFrame([], "presented_id string, required_id string")
    got = lambda s, **k: {(r.required_id, r.presented_id) for r in proof.match_evidence(need, have, s, **k).collect()}
    assert got(none) == {("r1", "p1"), ("r2", "p2")} and got(none, fallback=False) == set()
    assert got(spark.createDataFrame([("p1", "r3")], "presented_id string, required_id string")) == {("r3", "p1"), ("r1", "p2")}


def test_canonical_types_follow_their_order():
    vectors_ = {"a": [1.0, 0.0], "b": [0.9, 0.1], "c": [0.0, 1.0]}
    assert vectors.canonical_types(["a", "b", "c"], vectors_) == (["a", "c"], {"a": "a", "b": "a", "c": "c"})


def test_vector_blocks_lose_no_pair(spark):
    encode = vectors.hashing_encoder(16)
    rows = spark.range(60).select(F.lit("g").alias("grp"), "id", encode(F.concat_ws(" ", F.col("id") % 7, F.col("id") % 5)).alias("embedding"))
    pairs = lambda b: {(r.a, r.b) for r in vectors.similar_pairs(rows, 0.5, b).collect()}
    assert pairs(1000) == pairs(7) and len(pairs(7)) > 10


def test_manifest_files(spark, tmp_path):
    lines = ['{"locator": "https://hud.gov/x", "kind": "URL", "title": "t", "metadata": {"court": "c"}}', "", "{broken", '{"title": "no locator"}']
    (tmp_path / "a_guides.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text(lines[0])
    held = manifest.read_lines(spark, str(tmp_path))
    assert {(r.file, r.valid, r.invalid) for r in manifest.counts(held).collect()} == {("a_guides.jsonl", 1, 2), ("b.jsonl", 1, 0)}
    entries, rejected = manifest.parse(held)
    assert {r.reason for r in rejected.collect()} == {"malformed", "no locator"}
    rich = manifest.enrich(entries.withColumn("tags", tx.tag_list("tags"))).first()
    assert (rich.authority, rich.jurisdiction, rich.organization, rich.tags) == ("official_interpretive", "Federal", "HUD", ["federal_agency", "hud"])


def test_resource_links(spark):
    html = '<nav><a href="/n">n</a></nav><h2>Heat</h2><a href="/guide.pdf">A  guide</a><a href="mailto:x@y">m</a><h2>Rent</h2><a href="/guide.pdf">again</a><a href="/b">B</a>'
    got = pages.resource_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert [(r.href, r.label, r.category) for r in got] == [("/guide.pdf", "A guide", "Heat"), ("/b", "B", "Rent")]


def test_store_and_sinks(spark, tmp_path):
    held = store.Store(spark, f"file://{tmp_path}/s")
    assert held.read("edges").count() == 0
    held.write("edges", spark.createDataFrame([("a", "b", "CITES")], "src string, dst string, type string"))
    held.write("edges", held.read("edges").unionByName(held.read("edges")))
    assert held.read("edges").count() == 2 and {r.name: r.n for r in held.statistics().collect()}["edges"] == 2
    held.reset("edges")
    assert held.read("edges").count() == 0
    rows = spark.createDataFrame([("LAW", {"a": "", "b": "x", "c": "y"})], "type string, attributes map<string,string>")
    out = store.prune_attributes(store.migrate_types(rows), ["c"]).first()
    assert (out.type, out.attributes) == ("law", {"b": "x"})
    report = spark.createDataFrame([(1, [1, 2])], "id int, xs array<int>")
    sinks.write_report(report, f"{tmp_path}/j")
    sinks.write_report(report, f"{tmp_path}/c", "csv")
    assert spark.read.json(f"{tmp_path}/j").first().xs == [1, 2] and spark.read.option("header", True).csv(f"{tmp_path}/c").first().xs == "[1,2]"
    sinks.archive(spark.createDataFrame([(" a  b ",), ("a b",)], "text string"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    (tmp_path / "g.graphml").write_text('<graphml><graph><node id="n1"><data key="name">One</data></node><edge source="n1" target="n2"><data key="t">X</data></edge></graph></graphml>')
    nodes, links = store.graphml(spark, f"{tmp_path}/g.graphml")
    assert nodes.first().data == {"name": "One"} and (links.first().src, links.first().dst) == ("n1", "n2")


def test_stream_counts_are_those_of_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id < 20")
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = state.request_counts(state.read_events(spark, f"{tmp_path}/in", 10), width="1 hour", late="60 days")
    state.run_to_completion(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    late = spark.createDataFrame([(0, "2030-01-01 00:00:00", 0, "x", 0.0, "")], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    state.run_to_completion(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = lambda df: sorted((r.user_id, r.minute, r.n) for r in df.collect())
    got = rows(spark.read.parquet(f"{tmp_path}/out").filter("minute < '2029-01-01'"))
    assert got and got == rows(state.request_counts(events, width="1 hour"))
    twice = state.read_events(spark, f"{tmp_path}/in", 10)
    state.run_to_completion(state.first_in_time(twice, ["event_id"], late="60 days"), f"{tmp_path}/once", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/once").select("event_id").distinct().count() == spark.read.parquet(f"{tmp_path}/once").count()


EXTRACTED = {
    "claims": [{"id": "c1", "name": "Rent overcharge", "source_quote": "charged more than the legal rent"}, {"id": "c2", "name": " "}],
    "evidence": [{"id": "e1", "name": "Rent history", "is_critical": True, "linked_claim_id": "c1", "source_quote": "not in the text"}],
    "outcomes": [{"id": "o1", "name": "Refund", "disposition": "granted", "claim_ids": ["c1"]}],
    "laws": [{"id": "l1", "name": "The Code", "citation": "RSC 2520"}],
    "procedures": [],
    "relationships": [{"from": "l1", "to": "c1", "type": "addresses"}, {"source": "l1", "target": "zz", "type": "CITES"}, {"from": "l1", "to": "o1", "type": "BOGUS"}],
}


def test_ingest(spark, tmp_path):
    text = "The landlord  charged more than the legal rent.\nThe court ordered a refund."
    docs = spark.createDataFrame([("u1", "URL", "One", text), ("u2", "URL", "Two", text.replace("\n", " ")), ("u3", "URL", "Three", "Other text.")], "locator string, kind string, title string, text string")
    said = spark.createDataFrame([("u1", "```json\n" + json.dumps(EXTRACTED) + "\n```"), ("u3", json.dumps({"claims": [{"id": "x", "name": "RENT OVERCHARGE"}]})), ("u2", "nothing")], "locator string, json string")
    g = ingestion.run(docs, said)
    assert g.sources.select("source_id").distinct().count() == 2 and g.text_blobs.count() == 2 and g.chunks.count() == 2
    ents = {r.type: r for r in g.entities.collect()}
    assert set(ents) == {"legal_claim", "evidence", "legal_outcome", "law"} and ents["legal_claim"].claim_type == "RENT_OVERCHARGE" and ents["evidence"].is_critical
    assert ents["legal_claim"].best_quote.text == "charged more than the legal rent" and ents["evidence"].best_quote is None
    claim = ents["legal_claim"].id
    assert {(r.src, r.dst, r.type) for r in g.edges.collect()} == {(ents["law"].id, claim, "ADDRESSES"), (claim, ents["evidence"].id, "HAS_EVIDENCE"), (claim, ents["legal_outcome"].id, "RESULTS_IN")}
    assert {r.reason for r in g.skipped.collect()} == {"unknown target", "unknown type"}
    quote = g.quotes.first()
    assert (quote.start_offset, quote.end_offset) == (13, 45) and g.provenance.count() == 1
    assert ingestion.new_documents(docs, g.sources).count() == 0
    held = store.Store(spark, f"{tmp_path}/g")
    held.write("entities", g.entities)
    held.write("edges", g.edges)
    engine = Engine.open(held)
    assert engine.claim_types().first().n == 1 and engine.laws().first().law == ents["law"].id
    need = spark.createDataFrame([("RENT_OVERCHARGE", ents["evidence"].id, True), ("RENT_OVERCHARGE", "evidence:none", False)], "claim_type string, evidence_id string, is_critical boolean")
    chain = engine.proof_chains(need).first()
    assert chain.completeness == pytest.approx(2 / 3) and chain.n_laws == 1 and chain.outcome == ents["legal_outcome"].id
    assert [r.priority for r in engine.next_steps(need).orderBy("rank").collect()][-1] == "low" and engine.audit()["orphans"].count() == 4


def test_seed_graph(spark):
    """A small graph by hand: chains, neighbours and laws of claims."""
    ents = spark.createDataFrame([("law:1", "law", "Code", None), ("legal_claim:h", "legal_claim", "Heat", "HABITABILITY_VIOLATION"), ("legal_claim:o", "legal_claim", "Overcharge", "RENT_OVERCHARGE"), ("legal_outcome:hp", "legal_outcome", "HP action", None), ("legal_procedure:f", "legal_procedure", "File", None), ("evidence:p", "evidence", "Photos", None)], "id string, type string, name string, claim_type string")
    lines = spark.createDataFrame([("law:1", "legal_claim:h", "ADDRESSES"), ("law:1", "legal_outcome:hp", "AUTHORIZES"), ("legal_outcome:hp", "legal_procedure:f", "AVAILABLE_VIA"), ("law:1", "evidence:p", "REQUIRES"), ("legal_claim:h", "legal_claim:h", "CITES")], "src string, dst string, type string")
    chain = graph.chains(lines, [("law", "AUTHORIZES", "remedy"), ("remedy", "AVAILABLE_VIA", "procedure"), ("law", "REQUIRES", "evidence")]).first()
    assert (chain.law, chain.remedy, chain.procedure, chain.evidence) == ("law:1", "legal_outcome:hp", "legal_procedure:f", "evidence:p")
    assert graph.undirected(lines).count() == 9
    assert [(r.claim_type, r.law, r.citations) for r in graph.laws_for_claims(ents, lines).collect()] == [("HABITABILITY_VIOLATION", "law:1", 1)]
    steps = rules.heuristic_steps(ents.withColumn("description", F.lit("court")), ["code"], {"procedures": "legal_procedure", "evidence": "evidence"}).first()
    assert (steps.procedures, steps.evidence) == ("File", "Photos")
    merged, moved = Engine(ents.unionByName(spark.createDataFrame([("law:2", "law", "code", None)], ents.schema)), lines.unionByName(spark.createDataFrame([("law:2", "legal_claim:o", "ADDRESSES")], lines.schema))).consolidate()
    assert moved.first().new == "law:1" and merged.edges.filter("src = 'law:1' and dst = 'legal_claim:o'").count() == 1


def test_plans_hold_no_nested_loops(spark, sf):
    from graphloom import plans
    from graphloom.plans import catalog

    plans.load()
    for name in ("d7_laws_for_claim_type", "d8_remedies_for_claim_type", "d13_related_laws", "d14_documents_naming_laws", "d17_inferred_edges", "c6_bm25_any", "g6_i2_similar_pairs", "g7_token_pairs", "i1_cosine_top_k", "k1_k3_k4_proof_chains", "e13_graph_insights"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("NestedLoop", "Cartesian")), name
