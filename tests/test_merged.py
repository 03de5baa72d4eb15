"""Merged entities keep what their members had."""

from graphloom.engine import Engine
from graphloom.operators import dedup
from graphloom.schemas import ENTITIES, QUOTE, struct


def test_merged_entities_lose_nothing(spark):
    quote = lambda t: (t, "s", "c", None)
    far = "x" * 100
    ddl = f"id string, type string, name string, description string, jurisdiction string, attributes map<string, string>, source_metadata struct<source: string, authority: string, created_at: timestamp, processed_at: timestamp>, all_quotes array<{QUOTE}>, chunk_ids array<string>, provenance array<struct<source: string, quote: string, authority: string, title: string>>, mentions_count int, court string"
    rows = [
        ("b", "law", "kept", "short", None, {"k": "kept"}, ("s1", "informational_only", None, None), [quote(far + "1")], ["2"], [("s1", "q", None, None)], 1, None),
        ("a", "law", "dropped", "longer one", "NY", {"k": "lost", "m": "more"}, ("s2", "binding_legal_authority", None, None), [quote(far + "2"), quote("other")], ["1", "2"], [("s1", "q", None, "again"), ("s2", "q", None, None)], 1, "Civil Court"),
        ("c", "law", "dropped too", None, "NJ", None, None, None, None, None, None, "Supreme Court"),
        ("d", "law", "alone", None, None, None, None, None, None, None, 4, None),
    ]
    got = {r.id: r for r in dedup.merged(spark.createDataFrame(rows, ddl), spark.createDataFrame([("a", "b"), ("c", "b")], "old string, new string")).collect()}
    r = got["b"]
    assert set(got) == {"b", "d"} and (r.members, r.name, r.description, r.jurisdiction, r.court) == (3, "kept", "longer one", None, "Civil Court")
    assert [q.text for q in r.all_quotes] == [far + "1", "other"] and r.chunk_ids == ["1", "2"]
    assert [(p.source, p.title) for p in r.provenance] == [("s1", None), ("s2", None)] and r.mentions_count == 2
    assert r.attributes == {"k": "kept", "m": "more"} and r.source_metadata.source == "s2"
    assert got["d"].members == 1 and got["d"].mentions_count == 4


def test_consolidation_carries_all_columns(spark):
    nothing = dict.fromkeys(struct(ENTITIES).names)
    rows = [nothing | {"id": i, "type": "law", "name": n, "all_quotes": [(i, "s", "c", None)]} for i, n in (("l1", "Heat Code"), ("l2", "code heat"), ("l3", "other"))]
    ents = spark.createDataFrame([tuple(r.values()) for r in rows], struct(ENTITIES))
    engine, moved = Engine(ents, spark.createDataFrame([("l2", "x", "REQUIRES")], "src string, dst string, type string")).consolidate()
    assert [tuple(r) for r in moved.collect()] == [("l2", "l1")] and engine.entities.schema.names == ents.schema.names
    assert {r.id: [q.text for q in r.all_quotes] for r in engine.entities.collect()} == {"l1": ["l1", "l2"], "l3": ["l3"]}
    assert [r.src for r in engine.edges.collect()] == ["l1"]
