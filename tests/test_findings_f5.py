"""texts of headings alone have no super chunk and no row."""

import glob

import duckdb

import __spark_entry__


def test_texts_of_headings_alone(spark, tmp_path):
    texts = ["20.118.1.1 Betz\nbody", "20.118.1.1 Betz das", "FIRST PART\n\n2.1 Numbered", "", "\n\n", "1. a\rb\nx", "1. a\r\nx", "ABCD \nx", "plain", None, "\n".join(f"{i}. t\n{'w' * 400}" for i in range(7))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("b4_headings", "b5_super_chunks"):
        got = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).filter("doc_id <> 9").collect())
        with duckdb.connect() as db:
            db.execute(f"CREATE VIEW documents AS SELECT * FROM '{glob.glob(str(tmp_path / 'documents.parquet/*.parquet'))[0]}'")
            assert got == sorted(db.execute(__spark_entry__.oracle_sql()[name]).fetchall())
