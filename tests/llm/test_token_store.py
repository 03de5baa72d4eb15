import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import token_store

from .cases import awkward, empty

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows, end=2):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*SLOW.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("percentile", [0.0, 0.5, 0.92, 1.0])
def test_blocks_come_back(percentile):
    draw = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 300, 50_000, 1 << 17, (1 << 32) - 1):
            ids = draw.integers(0, top, n, np.uint32)
            ids[draw.random(n) < 0.05] = top
            parts, blocks, size = token_store.encode_blocks(ids, percentile)
            held = np.frombuffer(blocks, np.uint8)
            assert (token_store.decode_blocks(parts, held, size)[:n] == ids).all()
            if n > 200:
                assert (token_store.decode_blocks(parts, held, size, 1, 2)[: n - 128] == ids[128:256]).all()
                if percentile == 0.5 and top > 2:
                    assert parts["exceptions"].sum() > 0


def test_outliers_don_t_widen_a_block():
    ids = np.arange(1280, dtype=np.uint32) % 7 + 1000
    ids[5::128] = 49_999
    parts, blocks, size = token_store.encode_blocks(ids)
    assert set(parts["width"].tolist()) == {3} and set(parts["exceptions"].tolist()) == {1} and len(blocks) == 10 * (16 * 3 + 3)


def test_whole_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(sorted(tuple(r) for r in docs.select("doc_id", "text").collect()))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.op12_token_ids(spark, sf).collect())
    assert got == [w[:4] for w in want]
    path = str(tmp_path / "ids")
    token_store.write_ids(docs, path, segment_ids=5000, shard_bytes=200_000)
    found = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in token_store.read_documents(spark, path, with_ids=True).collect())
    assert found == want
    stream = [t for w in want for t in w[4]]
    segments = token_store.index(spark, path).cache()
    assert segments.count() > 50 and sum(r.n_ids for r in segments.collect()) == len(stream) and segments.select("file").distinct().count() > 5
    for a, b in ((0, 10), (12_345, 12_346), (4_000, 60_001), (len(stream) - 3, len(stream) + 99), (len(stream), len(stream) + 5)):
        read = sorted((r.start, r.ids) for r in token_store.ids_between(spark, segments, a, b).collect())
        assert [t for _, ids in read for t in ids] == stream[a:b] and (not read or read[0][0] == a)


def test_files_are_smaller_than_plain_ids(spark, sf, tmp_path):
    path = str(tmp_path / "ids")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    token_store.write_ids(docs, path)
    size = sum(p.stat().st_size for p in (tmp_path / "ids").glob("part-*"))
    ids = token_store.read_documents(spark, path).agg({"n_tokens": "sum"}).first()[0]
    assert size < 2 * ids


def test_awkward_rows(spark, tmp_path):
    df = awkward(spark)
    path = str(tmp_path / "ids")
    token_store.write_ids(df, path, segment_ids=3)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    # Rows of one id go by a hash of their texts; here they are equal.
    want = brute(sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == [w[:4] for w in want]
    token_store.write_ids(empty(spark), str(tmp_path / "none"))
    assert token_store.read_documents(spark, str(tmp_path / "none")).collect() == []
    assert token_store.index(spark, str(tmp_path / "none")).collect() == []


def test_text_ids_and_one_id_for_all(spark, tmp_path):
    rows = [("a.b", f"text number {i} of one id") for i in range(50)] + [("", "first"), ("é", None)]
    df = spark.createDataFrame(rows, "`doc.id` string, text string")
    path = str(tmp_path / "ids")
    token_store.write_ids(df, path, id_col="doc.id", segment_ids=20, shard_bytes=100)
    got = token_store.read_documents(spark, path, "string", with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(w[4]) for w in brute(rows))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
