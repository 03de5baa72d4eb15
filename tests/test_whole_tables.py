"""Queries on rows of large keys, which a limit on keys would leave out."""

import pytest

from graphloom import plans
from graphloom.plans import catalog

plans.load()


@pytest.fixture
def run(spark, tmp_path):
    def of(name, **tables):
        for table, (rows, ddl) in tables.items():
            spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{table}.parquet"))
        return sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())

    return of


def test_token_pairs_of_large_keys(run):
    part = [(1, "red ring", "Brand#1"), (1999, "ring red", "Brand#1"), (2000, "red ring", "Brand#1"), (19_999, "red ring", "Brand#1"), (20_000, "red ring", "Brand#2")]
    assert run("g7_token_pairs", part=(part, "p_partkey long, p_name string, p_brand string")) == [(a, b, 1.0) for a, b in ((1, 1999), (1, 2000), (1, 19_999), (1999, 2000), (1999, 19_999), (2000, 19_999))]


def test_greedy_matches_of_large_keys(run):
    orders = [(k, "1-URGENT", "O") for k in (1, 300, 150_000)]
    lines = [(k, 7, n) for k in (1, 300, 150_000, 150_001) for n in (1, 2)]
    found = run("k2_greedy_matches", orders=(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string"), lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int"), part=([(7, "red widget")], "p_partkey long, p_name string"))
    assert found == [(k, "r1-URGENT", "1-7") for k in (1, 300, 150_000)]


def test_dockets_of_large_keys(run):
    keys = (3, 4, 5, 89_999, 90_000, 90_001, 120_001, 150_002)
    want = {3: "LT-3/20", 4: "10004/2021", 90_000: "LT-90000/20", 90_001: "100001/2021", 120_001: "130001/2021"}
    assert run("h5_dockets", orders=([(k,) for k in keys], "o_orderkey long")) == [(k, want.get(k)) for k in keys]
