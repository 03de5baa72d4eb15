"""questions are dealt out, and rows without an asked word are not made into classes."""

from graphloom.operators import candidates


def test_only_asked_words_are_held(spark, monkeypatch):
    rows = [(f"r{i:03}", "claim", f"{i} {'urgent' if i % 5 == 0 else 'calm'} w{i % 3}") for i in range(300)] + [("s1", "claim", "5 urgent w2"), ("s2", "claim", "urgent urgent 7")]
    docs = spark.createDataFrame(rows, "id string, type string, name string")
    asks = spark.createDataFrame([("q1", "claim", "5 urgent"), ("q2", "claim", "urgent nowhere"), ("q3", "claim", "absent"), ("q4", "claim", "7 urgent"), ("s1", "claim", "w2 5")], "id string, type string, text string")
    got = lambda lexicon, **o: sorted(map(tuple, lexicon.candidates(asks, **o).collect()))
    whole, some = candidates.Lexicon(docs, ["name"], 4), candidates.Lexicon(docs, ["name"], 4, asks)
    for all_words in (False, True):
        want = got(whole, all_words=all_words)
        assert want and got(some, all_words=all_words) == want
        monkeypatch.setattr(candidates, "SENT_ANSWERS", 0)
        assert got(some, all_words=all_words) == want
        monkeypatch.setattr(candidates, "SENT_ANSWERS", 50_000)
    assert {r.term for r in some.postings.select("term").distinct().collect()} == {"5", "7", "urgent", "w2"}
    plan = some.candidates(asks)._jdf.queryExecution().executedPlan().toString()
    assert any("hashpartitioning(id#" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())
