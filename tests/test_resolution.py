"""Candidates, containment, stored indexes, paths: against plain Python on tables worked out by hand or drawn."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as tx
from graphloom.operators import candidates, containment, graph, search
from graphloom.operators.text_index import TextIndex
from graphloom.operators.vector_index import InvertedFile


def ranked(rows, fields, k, all_words):
    """The k best other rows of each row's type by BM25 for its name, over all pairs."""
    words = {f: {r["id"]: re.findall("[a-z0-9]+", r[f].lower()) for r in rows} for f in fields}
    mean = {f: sum(map(len, words[f].values())) / len(rows) for f in fields}
    df = {f: Counter(w for x in words[f].values() for w in set(x)) for f in fields}

    def weight(term, i):
        out = 0.0
        for f in fields:
            tf = words[f][i].count(term)
            if tf:
                out += math.log(1 + (len(rows) - df[f][term] + 0.5) / (df[f][term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[f][i]) / mean[f]))
        return out

    out = {}
    for r in rows:
        asked, found = set(re.findall("[a-z0-9]+", r["name"].lower())), []
        for o in rows:
            if o["id"] != r["id"] and o["type"] == r["type"]:
                hits = [weight(w, o["id"]) for w in asked]
                if any(hits) and (all(hits) or not all_words):
                    found.append((-round(sum(hits), 9), o["id"]))
        out[r["id"]] = [i for _, i in sorted(found)[:k]]
    return out


def drawn(n, seed=0):
    """Names of a few frequent and many rare words, some equal, some long."""
    draw = random.Random(seed)
    common, rare = ["claim", "order", "court", "the"], [f"w{i}" for i in range(n // 3)]
    rows = []
    for i in range(n):
        name = " ".join(draw.choices(common, k=draw.randint(0, 3)) + draw.choices(rare, k=draw.randint(0, 2)))
        rows.append({"id": i, "type": draw.choice("xxy"), "name": name, "description": " ".join(draw.choices(common + rare[:5], k=draw.randint(0, 4)))})
    rows[0]["name"] = " ".join(f"w{i}" for i in range(candidates.LEVELS + 5)) + " claim"
    rows[1]["name"] = ""
    rows[2] |= {"name": "claim", "type": "alone"}
    for i in range(3, 40):  # a third of some names are one name
        rows[i]["name"] = "order court"
    return rows


@pytest.mark.parametrize("fields,all_words,k", [(["name"], True, 5), (["name", "description"], False, 4), (["name"], False, 20)])
def test_candidates_are_the_best_of_all_pairs(spark, fields, all_words, k):
    rows = drawn(150)
    df = spark.createDataFrame(rows, "id long, type string, name string, description string")
    found = candidates.Lexicon(df.select("id", "type", *fields), fields, k).candidates(df.select("id", "type", F.col("name").alias("text")), all_words)
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.match)
    want = {i: x for i, x in ranked(rows, fields, k, all_words).items() if x}
    assert got == want and len(want) > 50
    assert max(map(len, got.values())) <= k  # no pair beyond k a row goes on


def test_a_word_that_all_have_brings_few(spark):
    """Names of one frequent and one own word: no row meets all others."""
    df = spark.range(2000).select("id", F.lit("claim").alias("type"), F.concat(F.lit("claim "), "id").alias("name"))
    lexicon = candidates.Lexicon(df, ["name"], 5)
    found = lexicon.candidates(df.select("id", "type", F.col("name").alias("text")))
    assert found.count() == 2000 * 5
    assert {r.match for r in found.filter("id = 1999").collect()} == {0, 1, 10, 100, 1000} or found.filter("id = 1999").count() == 5


def test_resolution_and_its_recall(spark):
    """Names with misplaced words and near vectors: what all pairs of a type would merge is merged."""
    draw = np.random.default_rng(1)
    rows, base = [], draw.normal(size=(60, 16))
    for i in range(60):
        words = [f"n{i}", f"m{i % 7}", "court"]
        rows.append((2 * i, "law", " ".join(words), base[i].tolist()))
        rows.append((2 * i + 1, "law", " ".join(reversed(words)), (base[i] + draw.normal(size=16) / 10).tolist()))
    df = spark.createDataFrame(rows, "id long, type string, name string, embedding array<double>")
    got = {r.id: (r.match, r.decision) for r in candidates.resolve(df, df).collect()}
    unit = np.array([r[3] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T - 2 * np.eye(len(rows))
    wanted = {i: int(near[i].argmax()) for i in range(len(rows)) if near[i].max() >= 0.92}
    hit = sum(got[i] == (m, "merge") for i, m in wanted.items())
    assert len(wanted) > 100 and hit / len(wanted) >= 0.9
    alone = spark.createDataFrame([(900, "law", "nobody", [1.0] * 16), (901, "law", "", [1.0] * 16)], df.schema)
    assert {r.id: (r.match, r.decision) for r in candidates.resolve(alone, df).collect()} == {900: (None, "new"), 901: (None, "new")}
    twice = df.unionByName(spark.createDataFrame([(500 + r[0], *r[1:]) for r in rows[:3]], df.schema))
    cached = {r.id: (r.match, r.decision) for r in candidates.resolve_once(twice, df).collect()}
    assert all(cached[500 + r[0]] == cached[r[0]] for r in rows[:3])


def test_links_against_all_pairs(spark):
    draw = random.Random(4)
    rows = [(i, "law", f"rent law {i % 40}", f"of the {draw.choice(['city', 'state'])} {i % 40}", draw.choice(["NYC", "nyc", "NY"])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, type string, name string, description string, jurisdiction string")
    got = {r.id: r.score for r in candidates.links(df, df).collect()}
    row = F.struct("name", "description", "jurisdiction", "type")
    every = df.select("id", row.alias("x")).crossJoin(df.select(F.col("id").alias("m"), row.alias("y"))).filter("id <> m")
    best = {r.id: r.s for r in every.groupBy("id").agg(F.max(F.round(candidates.rules.entity_similarity("x", "y"), 6)).alias("s")).filter("s >= 0.85").collect()}
    assert best and sum(got.get(i) == s for i, s in best.items()) / len(best) >= 0.9


def test_containment_is_the_theta_join(spark):
    draw = random.Random(2)
    text = lambda n: "".join(draw.choices("abAB é", k=draw.randint(0, n)))
    sought, texts = [text(5) for _ in range(120)] + [None, "a", "zz", "q" * 50], [text(30) for _ in range(120)] + [None, "", "q" * 60]
    a, b = (spark.createDataFrame([(x,) for x in xs], "text string") for xs in (sought, texts))
    low = lambda xs: {x.lower() for x in xs if x}
    want = {(p, w) for p in low(sought) for w in low(texts) if p in w}
    held = containment.contained(a, b)
    found = held.collect()
    assert {(r.part, r.whole) for r in found} == want and len(found) == len(want) > 100
    assert "NestedLoop" not in held._jdf.queryExecution().toString() and "Cartesian" not in held._jdf.queryExecution().toString()
    assert containment.contained(a.limit(0), b).count() == 0
    assert {(r.a, r.b) for r in containment.related(a, b).collect()} == {(p, w) for p in low(sought) for w in low(texts) if p in w or w in p}


def test_legal_elements(spark):
    required = spark.createDataFrame([("c", "e1", "Rent records", True), ("c", "e2", "Photos", False), ("c", "e3", "Lease", True), ("d", "e1", "Rent records", True)], "key string, evidence_id string, text string, is_critical boolean")
    presented = spark.createDataFrame([("c", "e1"), ("c", "e9")], "key string, evidence_id string")
    chains = spark.createDataFrame([("c", "rent"), ("c", "PHOTOS of mold"), ("c", "heat-log of 2020"), ("c", "")], "key string, name string")
    got = {(r.key, r.element): (r.status, r.is_critical, r.verified_in_graph, r.from_graph_only) for r in containment.legal_elements(required, presented, chains).collect()}
    assert got == {("c", "Rent records"): ("satisfied", True, True, False), ("c", "Photos"): ("missing", False, True, False), ("c", "Lease"): ("missing", True, False, False), ("c", "Heat-Log Of 2020"): ("unknown", False, True, True), ("d", "Rent records"): ("missing", True, None, False)}
    shown = spark.createDataFrame([("c", "my RENT receipts"), ("c", "rent"), ("d", "rent")], "key string, text string")
    assert {(r.element, r.satisfied, tuple(r.evidence)) for r in containment.elements(chains, shown).collect()} == {("rent", True, ("my RENT receipts", "rent")), ("PHOTOS of mold", False, ()), ("heat-log of 2020", False, ())}


def test_inferred_edges_follow_the_rule(spark):
    draw = random.Random(9)
    words = [f"t{i}" for i in range(12)] + ["claim"]
    rows = [(f"e{i}", draw.choice(["law", "legal_claim", "evidence"]), draw.choice([None, "", "NYC", "nyc", "Albany"]), draw.choices(words, k=draw.randint(0, 4))) for i in range(150)]
    rules = [("law", "legal_claim", "ADDRESSES"), ("law", "evidence", "REQUIRES"), ("legal_claim", "legal_claim", "NEAR")]
    existing = [("e0", "e1", "ADDRESSES"), ("e1", "e2", "REQUIRES")]
    for least in (1, 2, 3):
        want = set()
        for a in rows:
            for b in rows:
                shared, same = len(set(a[3]) & set(b[3])), bool(a[2] and b[2] and a[2].lower() == b[2].lower())
                want |= {(a[0], b[0], r, shared) for x, y, r in rules if x == a[1] and y == b[1] and a[0] != b[0] and (a[0], b[0], r) not in existing and (shared >= least or (shared and same))}
        df = spark.createDataFrame(rows, "id string, type string, jurisdiction string, tokens array<string>")
        got = graph.typed_pairs_by_tokens(df, df, spark.createDataFrame(rules, "src_type string, dst_type string, rel string"), spark.createDataFrame(existing, "src string, dst string, type string"), least).collect()
        assert {(r.src, r.dst, r.type, r.shared) for r in got} == want and len(got) == len(want) > 50


def test_paths_meet_no_node_twice(spark):
    draw = random.Random(3)
    rows = {(f"n{draw.randint(0, 15)}", f"n{draw.randint(0, 15)}", draw.choice("AB")) for _ in range(90)} | {("n0", f"m{i:03}", "A") for i in range(200)}
    edges = spark.createDataFrame(sorted(rows), "src string, dst string, type string")

    def follow(nodes, types, depth):
        out = []
        if len(types) < depth:
            ways = sorted((d, k) for s, d, k in rows if s == nodes[-1] and d not in nodes)[:3]
            for d, k in ways:
                out += [(nodes[0], (*nodes, d), (*types, k)), *follow((*nodes, d), (*types, k), depth)]
        return out

    seeds = spark.createDataFrame([("n0",), ("n3",), ("nowhere",)], "id string")
    got = sorted((r.seed, tuple(r.nodes), tuple(r.types)) for r in graph.paths(edges, seeds, 3, 3).collect())
    assert got == sorted(follow(("n0",), (), 3) + follow(("n3",), (), 3)) and len(got) > 20


def test_stored_index_ranks_as_the_search_does(spark, tmp_path, monkeypatch):
    from graphloom.operators import text_index

    monkeypatch.setattr(text_index, "BLOCK", 4)
    draw = random.Random(6)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randint(0, 30))), " ".join(draw.choices(words[25:], k=3))) for i in range(400)], "id long, name string, description string")
    queries = spark.createDataFrame([(q, " ".join(draw.choices(words, k=draw.randint(1, 5)))) for q in range(40)] + [(90, "nowhere"), (91, "")], "query_id long, text string")
    fields = ["name", "description"]
    index = TextIndex.write(docs, fields, str(tmp_path / "index"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(index.search(queries, 7)) == rows(search.search(queries, docs, fields, 7))
    assert rows(index.search(queries, 7, all_terms=True)) == rows(search.search(queries, docs, fields, 7, all_terms=True))

    def size(terms):
        """Bytes of the files that the scan for some terms reads."""
        df = index.read(spark.createDataFrame([(x,) for x in terms], "term string"))
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("filesSize").value()

    assert 0 < size(["w1"]) < size(["w1", "w2", "w3"]) < size([f"w{i}" for i in range(60)])


def test_inverted_file_finds_nine_of_ten(spark, tmp_path):
    held = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = held.collect()
    unit = np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([r.id for r in rows])
    asked = np.flatnonzero(ids % 20 == 0)
    want = {int(ids[i]): set(ids[np.lexsort((ids, -(unit @ unit[i]).round(9)))[:10]].tolist()) for i in asked}
    path = str(tmp_path / "ivf")
    InvertedFile.write(held, path)
    index = InvertedFile.open(spark, path)
    queries = held.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in index.search(queries).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    recall = sum(len(want[q] & got[q]) for q in want) / sum(map(len, want.values()))
    share = index.candidates(queries, 60).agg(F.sum("scored")).first()[0] / (len(asked) * len(ids))
    print("recall", recall, "share scored", share)
    assert recall >= 0.9 and share < 0.7
    assert spark.read.parquet(f"{path}/cells").count() == len(ids)
    assert index.search(queries.limit(0)).collect() == []


def test_dates_dockets_and_courts(spark):
    dates = {"2020-1-5": "2020-01-05", "13/5/2020": "2020-05-13", "1/5/2020": "2020-01-05", "JANUARY 5, 2020": "2020-01-05", "5 jan 2020": "2020-01-05", "2020-01-05T10:00:00Z": "2020-01-05", "31-12-2020": "2020-12-31", "12.31.2020": "2020-12-31", "31.12.2020": "2020-12-31", "Jan. 5, 2020": "2020-01-05", "on 2020-13-01 or so": "2020-01-01", "": None, "soon": None}
    df = spark.createDataFrame(list(dates.items()), "x string, want string")
    assert {r.x: r.got for r in df.select("x", tx.parse_date("x").cast("string").alias("got")).collect()} == dates
    dockets = {"Docket No.: 12345/2020 x": "12345/2020", "INDEX NUMBER LT-1-20/NY": "LT-1-20/NY", "an LT-312456-20/NY": "312456-20/NY", "1234/2020": None, "98765/2020": "98765/2020", "": None}
    df = spark.createDataFrame(list(dockets.items()), "x string, want string")
    assert {r.x: r.got for r in df.select("x", tx.docket("x").alias("got")).collect()} == dockets
    history = spark.createDataFrame([("served on March 3, 2021; the motion on Feb 1 2021; commenced January 5, 2020, and filed on Smarch 9, 20",)], "x string").select(tx.procedural_history("x").alias("h")).first().h
    assert [(str(e.date), e.event, e.description) for e in history] == [("2020-01-05", "filed", "commenced January 5, 2020"), ("2021-02-01", "motion", "motion on Feb 1 2021"), ("2021-03-03", "served", "served on March 3, 2021")]
