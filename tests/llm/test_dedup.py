import hashlib
import itertools
import random

import numpy as np
import xxhash

from graphloom.llm import exact_dedup, simhash

from .cases import awkward, empty


def brute_prints(rows):
    out = []
    for doc_id, text in rows:
        words = [w for w in "".join(c if c not in " \t\n\v\f\r" else " " for c in (text or "")).split(" ") if w]
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        out.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes)) if codes else 0))
    return out


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            a, b = find(i), find(int(i + 1 + j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[find(i)]) for i, (d, p) in enumerate(prints)), key=str)


def got(spark, docs):
    members, groups = simhash.near_groups(docs)
    rows = members.join(groups, "fp").select("id", "fp", "component_id").collect()
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in rows), key=str)


def test_simhash_is_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spark, docs) == brute_components(brute_prints(rows))


def test_simhash_takes_awkward_rows(spark):
    docs = awkward(spark)
    assert got(spark, docs) == brute_components(brute_prints([(r.doc_id, r.text) for r in docs.collect()]))
    assert got(spark, empty(spark)) == []


def test_long_lists_lose_no_link(spark):
    draw = random.Random(5)
    base = draw.getrandbits(64)
    prints = {base}
    for step in range(300):  # chains and stars about a few centres
        at = draw.choice(sorted(prints)) if step % 3 else base
        for bit in draw.sample(range(64), draw.randint(1, 3)):
            at ^= 1 << bit
        prints.add(at)
    prints |= {base & ~0xFFFFFF | x for x in draw.sample(range(1 << 24), 200)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = brute_components([(p, p) for p in prints])
    for long_list in (20_000, 40, 8):
        roots = {r.node: r.root for r in simhash.roots(simhash.links(df, 3, long_list)).collect()}
        groups = {}
        for p in prints:
            s = p - (1 << 64) if p >> 63 else p
            groups.setdefault(roots.get(s, s), set()).add(p)
        wanted = {}
        for p, _, least in want:
            wanted.setdefault(least, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_group_gives_as_many_links_as_members(spark):
    df = spark.createDataFrame([(1 << i | 1 << j,) for i, j in itertools.combinations(range(40), 2)], "fp long")
    n = df.count()
    assert simhash.links(df).count() < 8 * n


def test_exact_dedup_is_grouping_by_text(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    owner = {}
    for i, t in rows:
        owner[t] = max((x for x in (owner.get(t), i) if x is not None), default=None)
    size = {t: sum(u == t for _, u in rows) for _, t in rows}
    out = exact_dedup.classes(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == sorted(((i, owner[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sum(r.kept for r in out) == len(owner)
    assert exact_dedup.classes(empty(spark)).count() == 0
    small = {r.text_sha256: r.keep_id for r in exact_dedup.owners(docs, keep="smallest").collect()}
    assert small[hashlib.sha256(b"a plain text of some words here").hexdigest()] == 1


def test_dropping_copies_keeps_rows_whole(spark):
    docs = awkward(spark)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted({str(r): r for r in docs.collect() if r.doc_id not in (1, 3)})
    assert exact_dedup.drop_copies(empty(spark)).count() == 0
    near = simhash.drop_near_copies(out)
    assert near.columns == docs.columns and near.count() == len({x[2] for x in got(spark, out)})


def test_trie_splits_and_finds_again():
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abcdef", b"abcxyz", b"\x00", b"\xff\xfe"]
    draw = random.Random(1)
    words += [bytes(draw.choices(b"ab", k=draw.randint(0, 9))) for _ in range(300)]
    want = {w: words.count(w) for w in words}
    trie = exact_dedup.RadixTrie()
    for w in words:
        trie.at(w)[1] += 1
    assert {w: c[1] for w, c in trie.cells()} == want
    assert trie.held == sum(map(len, exact_dedup._labels(trie.root))) < sum(map(len, want))
    trie, left = exact_dedup.RadixTrie(), {}
    for w in sorted(words):  # in byte order each text leaves once
        trie.at(w)[1] += 1
        if trie.held > 20:
            for x, c in trie.finished(w):
                assert x not in left
                left[x] = c[1]
            assert trie.held <= len(w)
    assert left | {x: c[1] for x, c in trie.cells()} == want and len(left) > 100
    trie, left = exact_dedup.RadixTrie(), dict.fromkeys(want, 0)
    for w in words:  # in any order counts add up
        trie.at(w)[1] += 1
        if trie.held > 20:
            for x, c in trie.largest(10):
                left[x] += c[1]
            assert trie.held <= 10
    for x, c in trie.cells():
        left[x] += c[1]
    assert left == want


def test_owners_under_a_small_budget(spark):
    """Subtrees leave all the time, and many texts share one trie."""
    draw = random.Random(2)
    rows = [(i, "".join(draw.choices("ab", k=draw.randint(0, 6)))) for i in range(3000)] + [(5000 + i, "the same beginning of a longer text " + str(i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.owners(docs, keep=keep, most=64).collect()}
        groups = {}
        for i, t in rows:
            groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
        assert got == {h: (best(ids), len(ids)) for h, ids in groups.items()}


def test_identifiers_that_are_strings(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), ("é", "y"), (None, "z"), (None, "z")], "doc_id string, text string")
    for keep, want in (("largest", {"x": "b", "y": "é", "z": None}), ("smallest", {"x": "a", "y": "é", "z": None})):
        got = exact_dedup.classes(docs, keep=keep).collect()
        assert {(r.text_sha256, r.keep_id) for r in got} == {(hashlib.sha256(t.encode()).hexdigest(), i) for t, i in want.items()}
        assert len(got) == 6 and sum(r.kept for r in got) == 3
    assert sorted(str(r.doc_id) for r in simhash.drop_near_copies(docs).collect()) == sorted(str(x[0]) for x in [("a",), ("é",), (None,), (None,)])


def test_the_count_filter_rejects_what_it_should():
    draw = np.random.default_rng(4)
    prints = draw.integers(0, 1 << 63, 500, np.uint64)
    near = [prints[0] ^ np.uint64(1 << 3), prints[0] ^ np.uint64(0b111 << 20), prints[0] ^ np.uint64(1 << 1 | 1 << 20 | 1 << 60), prints[0] ^ np.uint64(0b1111)]
    other = np.array([*prints[1:], *near]) ^ prints[0]
    tally = [sum((int(x) >> 8 * p) & 0xFF == 0 for p in range(8)) for x in other]
    assert simhash._shared_bytes(other).tolist() == tally
    hit = simhash._near(other, 3)
    assert hit.tolist() == [499, 500, 501] and tally[502] >= 5  # the last one passes the count and fails the verification
    assert sum(t >= 5 for t in tally) < 10


def test_rows_of_a_frequent_key_meet_in_place(spark, monkeypatch):
    from graphloom.llm import base

    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 0) for i in range(3000)], "i long, k long")
    table = rows.groupBy("k").count().withColumn("name", base.F.col("k") * 2)
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for least, part in ((100_000, 1000), (10, 2), (0, 10**6)):
        monkeypatch.setattr(base, "HOT_ROWS", least)
        monkeypatch.setattr(base, "HOT", part)
        assert sorted(map(tuple, base.meet(rows, table, "k", "count").collect())) == want
