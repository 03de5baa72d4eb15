"""weights meet the queries by document, once for all queries with a term."""

from graphloom.operators import search, text_index


def test_a_frequent_term_is_not_shuffled_for_each_query(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "common " + ("rare " if i % 7 == 0 else "") * (i % 3 + 1) + f"w{i % 50}") for i in range(400)], "id long, text string")
    queries = spark.createDataFrame([(q, f"common rare w{q}") for q in range(60)], "query_id long, text string")
    monkeypatch.setattr(text_index, "BLOCK", 4)
    monkeypatch.setattr(text_index, "LONG", 64)  # "common" has parts and a told frequency
    index = text_index.TextIndex.write(docs, ["text"], str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).filter("term = 'common' and first").count() > 1
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    for all_terms in (False, True):
        found = search.search(queries, docs, ["text"], 5, all_terms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any("hashpartitioning(query_id" in line and "id#" in line.split("hashpartitioning(query_id")[1].split(",")[1] for line in plan.splitlines())
        got = rows(found)
        assert got == rows(index.search(queries, 5, all_terms))
        monkeypatch.setattr(search, "SENT_TERMS", 0)  # by shuffle
        assert got == rows(search.search(queries, docs, ["text"], 5, all_terms))
        monkeypatch.setattr(search, "SENT_TERMS", 100_000)
