import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import language_id, mixing, packing

from .cases import awkward, empty


def shared_out(sizes):
    """Targets by resharing round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, capped = dict.fromkeys(order, 0.0), set()
    left = float(sum(sizes.values()))
    while left > 1e-9:
        open_ = [s for s in order if s not in capped]
        if not open_:
            break
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in open_:
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                capped.add(s)
    return target


def count(text):
    return len((text or "").encode().split())


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1, None: 50, "": 3}, {"x": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 7, "c": 7, "d": 7}, {chr(97 + i): (i * 37) % 11 for i in range(20)}])
def test_targets_are_those_of_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(shared_out(sizes))


def test_mix_comes_near_its_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix(docs, range_rows=7).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert r.size == count(text[r.doc_id]) and r.taken <= 3 * r.size and r.taken == r.times * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert all(r.source_size == sizes[r.source] for r in rows)
    assert target == pytest.approx(shared_out(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    for s in sizes:  # complete epochs come first
        assert max(r.times for r in rows if r.source == s and r.size) - min(r.times for r in rows if r.source == s and r.size) <= 1
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_mix_takes_awkward_rows(spark):
    docs = awkward(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and mixing.mix(empty(spark)).count() == 0
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns and out.count() == sum(r.times for r in rows)
    assert mixing.mixed_rows(empty(spark)).count() == 0


def test_mixed_rows_are_those_that_the_mix_takes(spark, sf):
    """Repeated rows, too: the rows of a key are emitted as often as all of them are taken together."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    same = spark.createDataFrame([(1, "w " * 11, "x")] * 10 + [(2, "w " * 3, "y")] * 50 + [(3, "one", "z"), (None, "a b", None), (None, "a b", None), (4, "", "y")], "doc_id long, text string, source string").repartition(3)
    for table in (docs, same, docs.unionByName(same), docs.unionByName(docs)):
        want = Counter()
        for r in mixing.mix(table).collect():
            want[r.doc_id, r.code, r.source] += r.times
        got = Counter((r.doc_id, r.code, r.source) for r in mixing.mixed_rows(table).select("doc_id", mixing.F.xxhash64(mixing.F.coalesce("text", mixing.F.lit(""))).alias("code"), "source").collect())
        assert got == +want


def test_heavy_documents_are_taken_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s, float(q)) for i in range(3000) for s, q in [("a", 1 + 4 * (i % 2))]] + [(9000 + i, "w " * 10, "b", 1.0) for i in range(3000)], "doc_id long, text string, source string, q double")
    taken = defaultdict(int)
    for r in mixing.mix(docs, quality=mixing.F.col("q")).filter("source = 'a'").collect():
        taken[r.doc_id % 2] += r.taken
    assert taken[1] > 1.2 * taken[0]


def check_packing(docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
        for r in rows:
            if r.doc_id == d and r.doc_tokens == len(ids) and r.start == 0:
                assert zlib.crc32(ids[: r.length].tobytes()) == r.ids_crc32 or len(docs) < 20
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    padded = 0
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded / sum(r.length for r in rows)


def test_packing_places_every_token_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 300")
    rows = packing.pack(packing.pieces(docs), worker_pieces=100).collect()
    held = defaultdict(list)
    for r in rows:
        held[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for (_, n), parts in held.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n
    assert len(held) == docs.count()
    assert check_packing([(r.doc_id, r.text) for r in docs.collect()], rows) < 0.03


def test_packing_takes_awkward_rows(spark):
    docs = awkward(spark)
    rows = packing.pack(packing.pieces(docs)).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert sum(r.length for r in rows) == sum(len(packing.token_ids(r.text)) + 1 if r.text else 1 for r in docs.collect())
    assert packing.pack(packing.pieces(empty(spark))).count() == 0
    ids = packing.sequences(docs).collect()
    assert sum(len(r.ids) for r in ids) >= sum(r.length for r in rows)
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in ids)


def test_both_token_libraries_agree(spark):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    latin = "".join(map(chr, range(0x250)))
    texts = [latin, latin[::-1], " ".join(latin), "a  b   c \n\n d", "\xa0\x85x \x1f y", "it's we'LL 12³ ½ ª", "<|endoftext|>", "x <|endoftext|> y", "<|endoftext", "x" * 5000, " " * 5000 + "y", "ǅʰ ɐ 的\U0001f600", "  　z"]
    draw = random.Random(8)
    texts += ["".join(draw.choices(latin, k=draw.randint(0, 300))) for _ in range(1500)]
    texts += ["".join(draw.choices(" \n\t'sltm.,0123½éßABab-\xa0", k=draw.randint(0, 300))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, want in zip(texts, slow.encode_batch(texts, add_special_tokens=False), strict=True):
        assert packing.token_ids(text).tolist() == want.ids
    assert packing.token_ids("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]


def test_equal_rows_are_dealt_to_many_workers(spark):
    docs = spark.createDataFrame([(None, "word " * 700)] * 400 + [(7, "some " * 900)] * 400, "doc_id long, text string").repartition(4)
    rows = packing.pack(packing.pieces(docs), worker_pieces=20).collect()
    assert sum(r.length for r in rows) == sum(len(packing.token_ids(t)) + 1 for t in ["word " * 700, "some " * 900] for _ in range(400))
    assert len({r.sequence_id >> 36 & (1 << 20) - 1 for r in rows if r.sequence_id >= 0}) > 10
    assert check_packing([], rows) < 0.05


def test_cuts_fill_their_class():
    for n in range(1, 5000):
        parts = packing.cuts(n)
        assert sum(parts) == n and all((2048 // p) * p >= 0.98 * 2048 - 1 or 2048 // p > 40 for p in parts)


def test_languages_held_out(spark, sf):
    rows = language_id.op9_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    own = [lang[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(own) > 100 and np.mean(own) > 0.97


def test_languages_take_awkward_rows(spark):
    docs = awkward(spark)
    langs, profiles = language_id.prototypes(docs, language_id.F.lit(True))
    assert langs == ["en", "fr"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predict(docs, langs, profiles, carry=("doc_id", "text")).collect()}
    for (_, text), (lang, score) in got.items():
        assert (lang == "und") == (not any(c.isalpha() for c in text or ""))
        assert score == 0 or lang != "und"
    assert got[7, "un deux trois quatre cinq"][0] == "fr"
    langs, profiles = language_id.prototypes(empty(spark), language_id.F.lit(True))
    assert langs == [] and language_id.predict(docs, langs, profiles, carry=("doc_id",)).filter("lang_pred <> 'und'").count() == 0
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 4, 6, 10)").count() == 0 and kept.count() == docs.count() - 4


def test_bundles_of_slices_are_those_of_whole_texts(monkeypatch):
    text = "The quick brown fox, jumps!! over the 12 lazy dogs. " * 30
    whole = language_id.Bundler(256, 3).bundles([text, None, "", "x"])
    monkeypatch.setattr(language_id, "SLICE", 17)
    monkeypatch.setattr(language_id, "TOGETHER", 40)
    monkeypatch.setattr(language_id, "KEPT", 60)
    assert np.allclose(language_id.Bundler(256, 3).bundles([text, None, "", "x"]), whole)
    codes = np.concatenate(list(language_id.Bundler(256, 3).slices("ab")))
    assert len(codes) == 2 and not whole[1].any() and whole[3].any()


def brute_profiles(texts, dimensions, order):
    """Bundles of n-grams, letter by letter."""
    out = []
    for text in texts:
        letters, total = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " ", np.zeros(dimensions)
        while "  " in letters:
            letters = letters.replace("  ", " ")
        if letters.strip():
            for i in range(len(letters) - order + 1):
                bound = np.ones(dimensions)
                for k in range(order):
                    c = letters[i + order - 1 - k]
                    bound = bound * np.roll(language_id._letter(0 if c == " " else ord(c), dimensions).astype(float), k)
                total += bound
        out.append(total)
    return out


def test_languages_are_those_of_brute_force(spark):
    """Profiles and cosines of every text, from the definition."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    docs = docs.unionByName(awkward(spark).filter("doc_id <> 5 or doc_id is null").select(docs.columns)).cache()
    rows = docs.collect()
    langs, profiles = language_id.prototypes(docs, language_id.F.lit(True), dimensions=128)
    own = dict(zip(range(len(rows)), brute_profiles([r.text for r in rows], 128, 3), strict=True))
    sums = {}
    for i, r in enumerate(rows):
        if r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + own[i]
    want = sorted(k for k, v in sums.items() if np.any(v))
    assert langs == want and np.allclose(profiles, [sums[k] / np.linalg.norm(sums[k]) for k in want])
    got = sorted(((r.text or "", r.lang_pred, round(r.score, 4)) for r in language_id.predict(docs, langs, profiles, carry=("text",)).collect()), key=str)
    expected = []
    for i, r in enumerate(rows):
        size = np.linalg.norm(own[i])
        cosine = [float(own[i] @ profiles[j]) / size if size else 0 for j in range(len(langs))]
        expected.append((r.text or "", langs[int(np.argmax(cosine))] if size else "und", round(max(0.0, max(cosine)), 4) if size else 0.0))
    assert [g[:2] for g in got] == [e[:2] for e in sorted(expected, key=str)] and np.allclose([g[2] for g in got], [e[2] for e in sorted(expected, key=str)], atol=1e-3)


def test_the_sample_of_a_language_is_bounded(spark):
    rows = [(1, "the same row again", "en")] * 300 + [(None, f"words of number {i}", "en") for i in range(300)] + [(5, "un mot", "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, profiles = language_id.prototypes(docs, language_id.F.lit(True), per_language=40, dimensions=64)
    assert langs == ["en", "fr"]
    same = brute_profiles(["the same row again"], 64, 3)[0]
    assert profiles[0] @ same / np.linalg.norm(same) < 0.95  # so many copies are not the sample
