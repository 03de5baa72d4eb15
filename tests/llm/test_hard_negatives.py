import math
from fractions import Fraction

import numpy as np
import pytest

from graphloom.llm import hard_negatives

STOP = 2**63 - 1


def brute(rows, positives=5, negatives=10):
    ok = [(i, label, j, [math.floor(256 * Fraction(x)) for x in v]) for j, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, j, q in ok:
        if i % 100:
            continue
        scored = [(-min(max(sum(a * b for a, b in zip(q, v)), -STOP - 1), STOP), c, other) for c, other, d, v in ok if d != j and len(v) == len(q)]
        for p, c in sorted((s, c) for s, c, other in scored if other == label)[:positives]:
            found = sorted((s, n) for s, n, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p)[:negatives]
            out += [(i, c, r + 1, n, -p, -s) for r, (s, n) in enumerate(found)]
    return sorted(out)


def got(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label long, uid string, part int")
    found = hard_negatives.mine(df, "vec_id % 100 = 0", **options)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found.collect())


def made(seed, n, dim, labels=4, step=10):
    draw = np.random.default_rng(seed)
    data = draw.normal(size=(n, dim)).astype(np.float32)
    data[n // 2 : n // 2 + n // 5] = data[n // 2]
    return [(i * step, v.tolist(), int(draw.integers(labels))) for i, v in enumerate(data)]


def test_negatives_are_brute_force(spark):
    rows = made(0, 500, 12)
    want = brute(rows)
    assert len(want) > 500 and got(spark, rows, "float") == want
    assert got(spark, rows, "float", block=20, group=9, pivots=5, ranges_block=11) == want


def test_clusters_are_not_replicated_to_all(spark):
    """Far clusters: few blocks serve an anchor."""
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(10, 6)) * 4
    rows = [(i, (centres[i % 10] + draw.normal(size=6) / 30).tolist(), int(draw.integers(3))) for i in range(1000)]
    assert got(spark, rows, block=40, group=4) == brute(rows)


@pytest.mark.parametrize("huge", [1e12, 1.7e308])
def test_awkward_rows(spark, huge):
    rows = [
        (0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan"), 1.0], 1), (400, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 1.5], None),
        (0, [1.0, 2.0], 1), (7, [0.5, 1.0], 1), (8, [0.9, 1.1], 2), (8, [0.9, 1.1], 2), (9, [0.4, 1.1], 3), (500, [1.0], 1), (501, [2.0], 1), (502, [1.5], 2), (600, [], 1), (601, [], 2), (602, [], 1),
        (700, [huge, 1.0], 1), (701, [huge, 3.0], 1), (702, [-huge, 3.0], 2), (703, [huge / 2, 0.0], 2), (800, [-0.0001, 0.0], 4), (900, [-1.0, -1.0], 5), (901, [1.0, 1.0], 5), (902, [0.0, 0.0], 5), (903, [1.0, -1.0], 6),
    ]
    want = brute(rows)
    assert want and got(spark, rows) == want == got(spark, rows, block=2, group=1, pivots=2)
    assert got(spark, []) == []


def test_many_rows_of_one_id_and_label(spark):
    rows = [(100, [1.0, i / 50], 1) for i in range(40)] + [(100, [1.0, 1.0], 1)] * 20 + [(3, [0.5, i / 70], 2) for i in range(30)]
    assert got(spark, rows) == brute(rows) == got(spark, rows, block=7, group=5)


def test_shares_of_scores(spark):
    scores = [0, 1, -1, 33, -33, 99, 100, 101, -100, STOP, -STOP - 1, STOP - 7]
    found = spark.createDataFrame([(s,) for s in scores], "s long").select("s", hard_negatives._share("s", 30, 99).alias("a"), hard_negatives._share("s", 90, 0).alias("b")).collect()
    assert [(r.a, r.b) for r in found] == [(-(-30 * s // 100), 90 * s // 100) for s in scores]
