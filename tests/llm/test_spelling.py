import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import spelling

from .cases import awkward, empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, damage=97, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def brute(words):
    rows, form = [], {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(v, w))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        rows.append((w, n, len(others), form[w], words[form[w]] if form[w] else None))
    out = []
    for w, n, k, f, m in rows:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, k, f, m, root))
    return sorted(out)


def result(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def made_words(seed, alphabet, n, least=1, most=9):
    draw = np.random.default_rng(seed)
    return sorted({"".join(draw.choice(list(alphabet), draw.integers(least, most))) for _ in range(n)})


@pytest.mark.parametrize("target", [10_000_000, 60, 1])
@pytest.mark.parametrize("alphabet,n", [("ab", 200), ("abcdé\U0001f600", 600)])
def test_near_pairs_are_brute_force(spark, alphabet, n, target):
    words = made_words(3, alphabet, n)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = Counter(tuple(sorted((r.word_a, r.word_b))) for r in spelling.near_pairs(df, target).collect())
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    assert set(got) == want and set(got.values()) <= {1}


def test_wavelet_tree_reports_rectangles():
    draw = np.random.default_rng(0)
    for n in (1, 2, 37, 500):
        places = draw.permutation(n)
        tree = spelling.WaveletTree(places)
        left, low = draw.integers(0, n, 50), draw.integers(0, n, 50)
        right, high = left + draw.integers(0, n + 1 - left), low + draw.integers(0, n + 1 - low)
        which, value = tree.report(left, right, low, high)
        want = {(q, int(v)) for q in range(50) for v in places[left[q] : right[q]] if low[q] <= v < high[q]}
        assert set(zip(which.tolist(), value.tolist())) == want and len(which) == len(want)


@pytest.mark.parametrize("target", [spelling.TARGET, 200])
def test_variants_are_brute_force(spark, target):
    draw = np.random.default_rng(5)
    stems = ["colour", "color", "colours", "Colour", "centre", "center", "centré", "été", "naïveté", "naivete", "aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "organise", "organize", "x" * 30]
    rows = [(i, " ".join(draw.choice(stems, 60, p=np.arange(len(stems), 0, -1) / sum(range(len(stems) + 1)))) + "× ÷!Āz 的colour") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = result(spelling.variants(df, damage=7, target=target))
    want = brute(brute_words(rows, damage=7))
    assert got == want and any(r[3] for r in want) and any(r[5] != r[3] and r[3] for r in want)


def test_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    words = brute_words(rows)
    got = {r[0]: r for r in result(spelling.op13_spelling_variants(spark, sf).select("word", "n", "n_near", "form", "form_n", "root"))}
    assert {w: r[1] for w, r in got.items()} == words
    # By deletions: words that share a deletion are near or two edits apart, so each candidate is verified.
    shared = {}
    for w in words:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared.setdefault(key, []).append(w)
    partners = {w: set() for w in words}
    for group in shared.values():
        for a in group:
            partners[a].update(b for b in group if near(a, b))
    assert {w: r[2] for w, r in got.items()} == {w: len(p) for w, p in partners.items()}
    for w, p in partners.items():
        best = min(((-words[v], v) for v in p), default=None)
        form = best[1] if best and -best[0] >= 2 * words[w] else None
        assert got[w][3:5] == (form, words[form] if form else None)
        assert got[w][5] == (got[form][5] if form else w)


def test_awkward_rows(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert result(spelling.variants(df, least_count=1)) == brute(brute_words(rows, least_count=1))
    assert result(spelling.variants(empty(spark))) == []


def test_very_long_words(spark):
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}c {long[:1000]}x{long[1001:]} short"), (None, long)]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), damage=0, least_count=1))
    assert [(len(r[0]), r[1], r[2]) for r in got] == [(40_000, 2, 2), (40_001, 1, 1), (40_000, 1, 1), (5, 1, 0)]
