"""F8: the greedy pass over vectors goes through blocks in order of ids, without a table of pairs."""

import random

import numpy as np
import pytest

from graphloom import plans
from graphloom.operators import dedup, vectors
from graphloom.plans import catalog

plans.load()
KINDS = "grp int, id long, embedding array<double>"


def sequential(spark, rows, least):
    """The pass over the table of all pairs."""
    pairs = vectors.similar_pairs(spark.createDataFrame(rows, KINDS), least).collect()
    gone, want = set(), set()
    for r in sorted(pairs, key=lambda r: (-r.score, r.a, r.b)):
        if r.a not in gone and r.b not in gone:
            gone.add(r.b)
            want.add((r.a, r.b, r.score))
    return want


def found(df):
    return {(r.kept, r.dropped, r.score) for r in df.collect()}


@pytest.mark.parametrize("block", [16, 10_000])
def test_blocks_give_what_the_sequential_pass_gives(spark, block):
    rng = np.random.default_rng(8)
    draw = lambda: rng.normal(size=5).tolist()
    rows = [(g, 2**60 + 1000 * g + int(i), draw()) for g, n in ((1, 90), (2, 7), (3, 1)) for i in rng.permutation(n)]
    some = [rows[k][2] for k in (0, 11, 40, 63)]
    rows += [(1, 2**60 + 5000 + 7 * k, v) for k, v in enumerate(some * 12)]  # equal
    rows += [(1, 2**60 - 900 + k, [f * x for x in v]) for k, (v, f) in enumerate((v, f) for v in some for f in (2.0, 3.0, 0.1, 7.0))]  # of one direction
    rows += [(1, 2**60 + 9000 + k, [x + 1e-8 * rng.normal() for x in some[0]]) for k in range(20)]  # nearly equal
    rows += [(1, 7, [0.0] * 5), (2, 8, [0.0] * 5), (2, 9, [0.0] * 5)]
    odd = [(1, 1, [float("nan")] * 5), (1, 2, [float("inf")] + [1.0] * 4), (2, 3, [float("nan")] + [1.0] * 4), (1, 4, None), (2, 5, []), (None, 6, some[0]), (None, 10, some[0])]
    got = found(vectors.greedy_merges(spark.createDataFrame(rows + odd, KINDS), 0.3, block))
    assert got == sequential(spark, rows, 0.3) and len(got) > 100


def test_nothing_to_merge(spark):
    assert found(vectors.greedy_merges(spark.createDataFrame([], KINDS), 0.3)) == set()
    assert found(vectors.greedy_merges(spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 3, [1.0, 0.0])], KINDS), 0.3)) == set()


def test_the_query_makes_no_pairs_of_a_large_class(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) if i % 4 else np.ones(6)).tolist(), i % 2) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    single = [(g, i, np.array(v, np.float32).astype(float).tolist()) for i, v, g in rows]
    want = {(a, b, round(s, 6)) for a, b, s in sequential(spark, single, 0.3)}
    monkeypatch.setattr(vectors, "similar_pairs", lambda *_: pytest.fail("all pairs of a label were made"))
    got = found(catalog.QUERIES["g6_greedy_consolidation"](spark, str(tmp_path)))
    assert got == want and sum(a == 0 and b % 4 == 0 and s == 1 for a, b, s in got) == 299


def test_copies_go_in_one_round(spark, monkeypatch):
    draw, rounds = random.Random(4), []
    settled = dedup.settled
    monkeypatch.setattr(dedup, "settled", lambda df, label: (rounds.append(label), settled(df, label))[1])
    copies = [(a, b, 1.0) for a in range(100, 130) for b in range(a + 1, 130)]
    others = [(a, b, draw.randrange(30, 60) / 100) for a in range(60) for b in range(a + 1, 60) if draw.random() < 0.3]
    pairs = copies + others + [(a, b, draw.randrange(30, 60) / 100) for a in range(60) for b in range(100, 130) if draw.random() < 0.3]
    merges = dedup.greedy_merges(spark.createDataFrame(pairs, "a long, b long, score double"))
    gone, want = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in gone and b not in gone:
            gone.add(b)
            want.add((a, b, s))
    assert found(merges) == want and {(100, b, 1.0) for b in range(101, 130)} <= want
    assert rounds.count("merges") < 20
