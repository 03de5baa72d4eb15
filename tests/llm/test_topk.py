import math
from fractions import Fraction

import numpy as np

from graphloom.llm import exact_topk


def brute(rows, k=10):
    ok = [(i, j, [math.floor(1024 * Fraction(x)) for x in v]) for j, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, j, q in ok:
        if i % 100 == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(q, v)), -(2**63)), 2**63 - 1), c) for c, d, v in ok if d != j and len(v) == len(q)]
            out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, dim int, v double, turn string")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df, "vec_id % 100 = 0", **options).collect())


def test_top_k_is_brute_force(spark):
    draw = np.random.default_rng(0)
    data = draw.normal(size=(700, 16)).astype(np.float32) / 4
    data[50:90] = data[50]
    rows = [(i * 10, v.tolist()) for i, v in enumerate(data)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, candidate_block=64, query_block=7, pivots=3) == brute(rows)


def test_top_k_takes_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, -0.25]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (500, [1.0]), (600, []), (601, []), (700, [1e30, 1.0]), (9, [3e9, -1e9]), (10, [-0.0001, 0.0])]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    twice = got(spark, [*rows[:1], *rows[:1], (1, [0.0, 1.0])])
    assert twice == [(0, 1, 0, 1024 * 1024 * 5), (0, 1, 0, 1024 * 1024 * 5), (0, 2, 1, 2 * 1024 * 1024), (0, 2, 1, 2 * 1024 * 1024)]


def test_far_pivots_eliminate_nobody(spark):
    draw = np.random.default_rng(1)
    rows = [(i * 10, v.tolist()) for i, v in enumerate(draw.normal(size=(60, 8)).astype(np.float32))]
    rows += [(1000 + i, (v * 10.0 ** draw.integers(3, 30)).tolist()) for i, v in enumerate(draw.normal(size=(20, 8)))]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert got(spark, rows) == brute(rows)


def test_huge_finite_components_take_part(spark):
    draw = np.random.default_rng(3)
    for huge in (1e160, -1.7e308):
        rows = [(0, [1.0, 2.0]), (100, [huge, 1.0]), (1, [0.5, 0.5]), (2, [3.0, -1.0])]
        rows += [(10 + i, v.tolist()) for i, v in enumerate(draw.normal(size=(40, 2)))]
        assert doubles(spark, rows, candidate_block=4, query_block=1, pivots=2) == brute(rows)


def doubles(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(df, "vec_id % 100 = 0", **options).collect())


def test_large_scores_are_exact(spark):
    """Scores that doubles don't hold: neighbours differ by one in 2^60."""
    rows = [(0, [float(1 << 20), 0.0])] + [(i, [float(1 << 20) + i / 1024, 1.0]) for i in range(1, 30)] + [(100 * i, [float(1 << 30) - i, 3.0]) for i in range(1, 5)]
    assert doubles(spark, rows) == brute(rows) == doubles(spark, rows, candidate_block=3, pivots=1)


def test_blocks_that_cannot_enter_are_not_searched(spark):
    """Far clusters: most candidates are eliminated, none that counts."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8)) * 5
    rows = [(i, (centres[i % 12] + draw.normal(size=8) / 20).tolist()) for i in range(1200)]
    assert doubles(spark, rows, candidate_block=32) == brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = exact_topk.search(df, "vec_id % 100 = 0", candidate_block=32)
    assert found.agg({"evaluated": "sum"}).first()[0] < 0.5 * 12 * 1199, found.agg({"evaluated": "sum"}).first()
    assert doubles(spark, rows, candidate_block=32, ranges_block=25, query_block=2) == brute(rows)
