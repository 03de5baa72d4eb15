"""Small changes to stored tables, streams with state, priority cascades."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import tiers
from graphloom.sources.bucketed import BucketedTable, insert_edges
from graphloom.streaming import limits

SCHEMA = "id string, type string, name string, description string, jurisdiction string, chunk_ids array<string>"


def files(path):
    return {os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def rows(df):
    return sorted((r.id, r.name, r.description) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    held = BucketedTable(spark, str(tmp_path / "entities"), ["id"], SCHEMA, 8)
    held.insert_absent(spark.createDataFrame([(f"law:{i}", "law", f"n{i}", f"d{i}", None, [f"c{i}"]) for i in range(60)], SCHEMA), "first")
    return held


def test_insert_and_patch_touch_their_buckets_alone(spark, table):
    before = {b: place for b, place in table.manifest()["buckets"].items()}
    own = files(table.path)
    table.patch(spark.createDataFrame([("law:3", "law", None, "patched", None, None), ("law:900", "law", "new", None, None, ["z"])], SCHEMA), "second")
    got = {r.id: (r.name, r.description, r.chunk_ids) for r in table.read().collect()}
    assert len(got) == 61 and got["law:3"] == ("n3", "patched", ["c3"]) and got["law:900"] == ("new", None, ["z"])
    after = table.manifest()["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and own <= files(table.path)
    version = table.manifest()["version"]
    # The same change again is none; a change that finds its keys there adds nothing.
    assert table.patch(spark.createDataFrame([("law:3", "law", "x", "x", None, None)], SCHEMA), "second") == version
    table.insert_absent(spark.createDataFrame([("law:3", "law", "other", "other", None, None)], SCHEMA))
    assert {r.id: r.description for r in table.read().collect()}["law:3"] == "patched"
    assert rows(table.lookup(spark.createDataFrame([("law:5",), ("no",)], "id string"))) == [("law:5", "n5", "d5")]


def test_a_failed_write_leaves_the_old_version(spark, table):
    held, version = rows(table.read()), table.manifest()["version"]
    broken = lambda df: df.withColumn("name", F.raise_error(F.lit("the writer dies")).cast("string"))
    keys = spark.createDataFrame([("law:1",), ("law:2",)], "id string")
    with pytest.raises(Exception, match="the writer dies"):
        table.rewrite(keys, broken, "broken")
    assert rows(table.read()) == held and table.manifest()["version"] == version
    # Nor does a manifest that its writer didn't finish.
    with open(f"{table.path}/manifests/{version + 1:08}.json", "w") as f:
        f.write('{"version": 9, "buck')
    assert rows(table.read()) == held
    os.remove(f"{table.path}/manifests/{version + 1:08}.json")
    table.delete(keys, "gone")
    assert rows(table.read()) == [r for r in held if r[0] not in ("law:1", "law:2")]
    table.delete(spark.createDataFrame([(r[0],) for r in held], "id string"))
    assert rows(table.read()) == []


def test_two_writers_of_one_version(spark, table):
    version = table.manifest()["version"]
    other = BucketedTable(spark, table.path, ["id"], SCHEMA, 8)

    def slow(held):
        other.patch(spark.createDataFrame([("law:7", "law", "theirs", None, None, None)], SCHEMA))
        return held

    with pytest.raises(Exception, match=r"(?i)exist"):
        table.rewrite(spark.createDataFrame([("law:7",)], "id string"), slow)
    assert table.manifest()["version"] == version + 1
    assert {r.id: r.name for r in table.read().collect()}["law:7"] == "theirs"


def test_merged_entities_and_edges(spark, table, tmp_path):
    table.merge_entities(spark.createDataFrame([("law:4", "law:2"), ("law:9", "law:2")], "old string, new string"), "merged")
    got = {r.id: r for r in table.read().collect()}
    assert len(got) == 58 and got["law:2"].chunk_ids == ["c2", "c4", "c9"] and got["law:2"].name == "n2"
    edges = BucketedTable(spark, str(tmp_path / "edges"), ["src", "dst", "type"], "src string, dst string, type string", 4)
    new = spark.createDataFrame([("law:1", "law:2", "CITES"), ("law:1", "law:2", "CITES"), ("law:1", "law:4", "CITES"), ("no", "law:1", "CITES")], "src string, dst string, type string")
    insert_edges(edges, table, new)
    insert_edges(edges, table, new)
    assert [(r.src, r.dst, r.type) for r in edges.read().collect()] == [("law:1", "law:2", "CITES")]


def folder(spark, path, df, parts, order):
    """Files that arrive in order of time."""
    held = df.orderBy(order).collect()
    size = -(-len(held) // parts)
    for i in range(parts):
        spark.createDataFrame(held[i * size : (i + 1) * size], df.schema).coalesce(1).write.parquet(f"{path}/p{i:03}")
        part = next(n for n in os.listdir(f"{path}/p{i:03}") if n.startswith("part-"))
        os.rename(f"{path}/p{i:03}/{part}", f"{path}/f{i:03}.parquet")
        os.utime(f"{path}/f{i:03}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))


def drained(spark, source, schema, plan, out, checkpoint):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*.parquet")
    query = plan(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_limits_survive_a_restart(spark, sf, tmp_path):
    limits.with_state_store(spark)
    events = spark.read.parquet(f"{sf}/events.parquet").limit(1200)
    tier = F.when(F.col("user_id") % 3 == 0, "paid")
    width = 3_600_000
    requests = events.select(F.col("event_id").alias("request_id"), (F.col("user_id") % 7).cast("string").alias("key"), tier.alias("tier"), F.col("ts").cast("timestamp").alias("ts")).withColumn("tier", F.when(F.col("key").isin("0", "3", "6"), "paid"))
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    os.makedirs(source)
    folder(spark, source, requests, 4, "ts")
    plan = lambda s: limits.limited(s, {"paid": 6}, 3, "1 hour", width)
    for name in ("f002.parquet", "f003.parquet"):  # the first run ends before these have come
        os.rename(f"{source}/{name}", f"{tmp_path}/{name}")
    drained(spark, source, requests.schema, plan, out, checkpoint)
    for name in ("f002.parquet", "f003.parquet"):
        os.rename(f"{tmp_path}/{name}", f"{source}/{name}")
    query = drained(spark, source, requests.schema, plan, out, checkpoint)
    key = lambda df: sorted((r.request_id, r.key, r.n, r.allowed) for r in df.collect())
    want = key(limits.limited_batch(requests, {"paid": 6}, 3, width))
    assert key(spark.read.parquet(out)) == want and any(not x[3] for x in want)
    windows = requests.select("key", F.floor(F.unix_millis(F.col("ts")) / width)).distinct().count()
    live = sum(s["numRowsTotal"] for p in query.recentProgress[-1:] for s in p["stateOperators"])
    assert windows > 200 and live < windows


def test_cache_entries_expire_with_the_time_of_the_events(spark, tmp_path):
    limits.with_state_store(spark)
    at = lambda s: f"2024-01-01 00:{s // 60:02}:{s % 60:02}"
    entries = [("a", "1", at(0), at(30)), ("b", "1", at(1), None), ("c", "1", at(2), at(500)), ("a", "2", at(20), at(100)), ("d", "1", at(200), at(210)), ("e", "1", at(400), at(410))]
    df = spark.createDataFrame(entries, "key string, data string, created_at string, expires_at string").withColumns({c: F.to_timestamp(c) for c in ("created_at", "expires_at")})
    source = str(tmp_path / "in")
    os.makedirs(source)
    folder(spark, source, df, 6, "created_at")
    drained(spark, source, df.schema, limits.cached, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = sorted((r.key, r.data, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    live = {("a", "1"), ("a", "2"), ("c", "1"), ("d", "1"), ("e", "1")}
    assert {x[:2] for x in got if x[2] == "live"} == live
    assert {x[:2] for x in got if x[2] == "expired"} >= {("b", "1"), ("a", "2")} and ("a", "1", "expired") not in got and ("c", "1", "expired") not in got


def test_later_tiers_are_for_those_left_short(spark):
    asked = spark.createDataFrame([("q1", "x"), ("q2", "y"), ("q3", "z")], "query_id string, kind string")
    seen = []

    def tier(name, answers):
        def find(open_):
            seen.append((name, sorted(r.query_id for r in open_.collect())))
            return spark.createDataFrame(answers, "query_id string, id string, place int").join(open_.select("query_id"), "query_id")

        return name, find

    one = tier("one", [("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "a", 1)])
    two = tier("two", [("q1", "z", 1), ("q2", "a", 1), ("q2", "d", 2), ("q2", "d", 3), ("q2", "e", 4)])
    none = tier("none", [("q2", "n", 1), ("q3", "n", 1)])
    got = sorted((r.query_id, r.tier, r.place, r.id) for r in tiers.filled(asked, [one, two, none, tier("never", [])], 2, ("none",)).collect())
    assert got == [("q1", "one", 1, "a"), ("q1", "one", 2, "b"), ("q2", "one", 1, "a"), ("q2", "two", 1, "d"), ("q3", "none", 1, "n")]
    assert seen == [("one", ["q1", "q2", "q3"]), ("two", ["q2", "q3"]), ("none", ["q3"]), ("never", ["q3"])]
    seen.clear()
    assert tiers.filled(asked.filter("query_id = 'q1'"), [one, tier("never", [])], 2).count() == 2 and [n for n, _ in seen] == ["one"]


def test_opinion_pages_however_they_are_marked_up(spark):
    from graphloom.sources.case_pages import case_page

    long = "<p>" + "The court finds for the tenant and says why at some length. " * 3
    page = case_page(f"<html><head><meta property='og:title' content='Roe v Doe'><title>x</title></head><h1>Roe</h1><header>Court: nowhere special</header><main role=main><p>Before: Ann Lee, Bo Chan<p>No. 77-AB <h2>SYLLABUS</h2><div>{'Short and to the point, again. ' * 3}<h2>II</h2>{long}")
    assert page["name"] == "Roe v Doe" and page["court"] == "nowhere special" and page["docket"] == "77-AB" and page["judges"] == ["Ann Lee, Bo Chan"]
    assert page["summary"] == ("Short and to the point, again. " * 3).strip() and "nowhere" not in page["body"] and page["body"].count("The court finds") == 3
    dated = case_page(f"<div class='case-text'>Entered on 2020-05-06 in 2019 NY Slip Op 12345 by the Appellate Division, First Department{long}</div><div>Other</div>")
    assert (dated["date"], dated["citation"], dated["court"], dated["name"], dated["docket"]) == ("2020-05-06", "2019 NY Slip Op 12345", "Appellate Division", None, None) and "Other" not in dated["body"]
    assert case_page(None) is None and case_page("<p>short") is None and case_page("<<<>>&amp;" * 3) is None
