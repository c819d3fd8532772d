"""Token ids, packing and the store, against the library itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkrel.llm import castore, packing
from sparkrel.llm.common import shared_dir
from sparkrel.llm.tokens import Encoder, default_path

ODD = ["", " ", "\n", "a  b", "a   b", "a \n b", "a\n\nb", " a", "a ", "a\n b", "a \nb", "don't 's 've x's", "x  y", "a\tb c", "a <|endoftext|> b<|endoftext|>", "\x1c a", "日本 語 12 3.4", "a\r\nb", "word!!! (x) ...", "q's. 't", "x" * 5000]
ENCODER, LIBRARY = Encoder(default_path()), Tokenizer.from_file(default_path())
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (70, "again"), (70, "again"), (None, "no id"), (50, "long text, with words. " * 3000)]


def library(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def test_odd_texts():
    assert ENCODER.encode(ODD) == [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'st.,!  \n\té日1<|>", max_size=40), max_size=5))
def test_any_texts(texts):
    assert ENCODER.encode(texts) == [np.array(LIBRARY.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]


@pytest.mark.parametrize("longest", [1, 8, 2048])
def test_packing(spark, longest):
    df = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, length int")
    got = packing.pack(df, default_path(), longest).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    docs: dict = {}
    for r in got:
        assert r.offset == 0 and r.length == 1 << r.bucket <= longest and len(r.ids) == 4 * r.length
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    want = {}
    for i, t in ROWS:
        raw = library(t, 1)
        want.setdefault((i, len(raw) // 4), []).append(raw)
    assert docs.keys() == want.keys()
    for k, raws in want.items():
        if len(raws) == 1:
            own = sorted(docs[k])
            assert b"".join(x for _, x in own) == raws[0]
            assert [s for s, _ in own] == np.cumsum([0, *(len(x) // 4 for _, x in own[:-1])]).tolist()
            assert longest < 2048 or len(own) == (k[1] >> 11) + (k[1] & 2047).bit_count()
        else:
            assert sum(len(x) for _, x in docs[k]) == sum(map(len, raws))
    assert packing.pack(df.limit(0), default_path()).count() == 0


def test_packing_query(spark, small):
    raw = {r.doc_id: library(r.text, 1) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in packing.op3_packing(spark, small).collect():
        assert r.doc_tokens == len(raw[r.doc_id]) // 4
        assert r.ids_crc32 == zlib.crc32(raw[r.doc_id][4 * r.start : 4 * (r.start + r.length)])


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50000, 20_000).astype("<u2")
    ends = castore.chunk_ends(np.concatenate([a, a[5000:]]), np.array([20_000, 35_000]))
    names = lambda x, e: {castore.name_of(x[s:t].tobytes()) for s, t in zip([0, *e[:-1]], e, strict=True)}
    first, second = ends[0][: ends[1][0]].tolist(), (ends[0][ends[1][0] :] - 20_000).tolist()
    shared = names(a, first) & names(a[5000:], second)
    assert len(shared) >= len(second) - 8
    sizes = np.diff([0, *first])
    assert sizes.max() <= castore.MOST and sizes[:-1].min() >= castore.LEAST and first[-1] == 20_000 and second[-1] == 15_000


def test_tree():
    for n in range(20):
        leaves, tree = [bytes([i]) for i in range(n)], castore.Tree()
        for x in leaves:
            tree.add(x)
        assert tree.root() == castore.merkle(leaves)


def test_crc_shares():
    rng = np.random.default_rng(1)
    data = rng.bytes(10_000)
    cuts = [0, 3, 3, 100, 5000, 9999, 10_000]
    crc = np.array([zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
    after = np.array([10_000 - b for b in cuts[1:]])
    assert np.bitwise_xor.reduce(castore.shifted(crc, after)) == zlib.crc32(data)


def test_store_round_trip(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, name string")
    manifest = castore.write(df, shared_dir(spark, "test"), default_path())
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        raw = library(t, 2)
        want.append((i, start, len(raw) // 4, zlib.crc32(raw), raw))
        start += len(raw) // 4
    got = sorted(map(tuple, castore.read_digests(manifest).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    whole = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in castore.read_ids(manifest).collect()), key=lambda r: r[1])
    assert whole == [(w[0], w[1], w[4]) for w in want]
    names = castore.chunks(manifest).toPandas()["name"].map(bytes)
    assert names.is_unique
    assert castore.read_digests(castore.write(df.limit(0), shared_dir(spark, "test"), default_path())).count() == 0


def test_a_changed_byte_is_found(spark):
    manifest = castore.write(spark.createDataFrame([(1, "some words " * 50)], "doc_id long, text string"), shared_dir(spark, "test"), default_path())
    path = manifest.where("kind = 'pack'").first().path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[-1] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="root differs"):
        castore.read_digests(manifest).collect()


def test_a_lost_manifest_row_is_found(spark):
    path = shared_dir(spark, "test")
    manifest = castore.write(spark.createDataFrame([(i, f"some words {i} " * 50) for i in range(20)], "doc_id long, text string"), path, default_path())
    rows = manifest.collect()
    spark.createDataFrame(rows[1:], manifest.schema).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(castore.StoreError, match="manifest"):
        castore.open_store(spark, path)


def test_castore_query(spark, small):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    got, start = {r.doc_id: r for r in castore.op8_castore(spark, small).collect()}, 0
    assert len(got) == len(docs)
    for i, t in docs:
        raw = library(t, 2)
        assert tuple(got[i]) == (i, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_buckets_hold_one_length_each(spark, tmp_path):
    df = spark.createDataFrame([(i, "some words here " * i) for i in range(30)], "doc_id long, text string")
    pieces = packing.pack(df, default_path())
    packing.write_buckets(pieces, f"file://{tmp_path}/b")
    for b in {r.bucket for r in pieces.select("bucket").distinct().collect()}:
        own = spark.read.parquet(f"file://{tmp_path}/b/bucket={b}").collect()
        assert own and all(r.length == 1 << b == len(r.ids) // 4 for r in own)
    assert spark.read.parquet(f"file://{tmp_path}/b").count() == pieces.count()
