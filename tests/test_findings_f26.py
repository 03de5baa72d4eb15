"""a part of a batch is made into Python's strings at a time."""

from pyspark.sql import functions as F

from graphloom.operators import chunking


def test_parts_of_a_batch(spark, monkeypatch):
    texts = [None, "", "  ", " short ", " é. " * 40] + [f"Sentence {i} of some length. " * (i % 50 + 1) for i in range(300)]
    want = [[] if not x or len(x) <= 100 and not x.strip() else [x.strip()] if len(x) <= 100 else [x[a:b].strip() for a, b in chunking.cut_points(x, 100, 10)] for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    for size in (1, 1000, 4 << 20):
        monkeypatch.setattr(chunking, "PART_BYTES", size)
        assert [r.c for r in df.select("i", chunking.cut("text", 100, 10).alias("c")).orderBy("i").collect()] == want
    assert df.filter("i < 0").select(chunking.cut("text", 100, 10)).collect() == []
    assert "pandas" not in df.select(chunking.cut("text", 100, 10))._jdf.queryExecution().executedPlan().toString().lower()
