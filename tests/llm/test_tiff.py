"""TIFF: codecs, decoder, and the query against a round trip."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrel.llm import tiff

BYTES = st.one_of(st.binary(max_size=3000), st.builds(lambda a, n: a * n, st.binary(min_size=1, max_size=5), st.integers(0, 2000)))


@settings(max_examples=150, deadline=None)
@given(BYTES)
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_lzw_stream():
    # The worked example of the TIFF 6.0 text.
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    raw = (bits << 7).to_bytes(11, "big")
    assert tiff.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("layout", [{"rows_per_strip": 7}, {"tile": (16, 32)}])
@pytest.mark.parametrize("samples", [1, 3])
def test_pages_and_layouts(scheme, predictor, layout, samples):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 9, (h, w, samples), np.uint8) for h, w in ((1, 1), (50, 70), (16, 32))]
    data = tiff.encode(images, scheme, predictor, **layout)
    got = [tiff.page(data, t) for t in tiff.directories(data)]
    assert len(got) == 3 and all((a == b).all() for a, b in zip(got, images, strict=True))


def test_big_endian_16_bit_planar():
    image = np.random.default_rng(2).integers(0, 60000, (5, 4, 2)).astype(np.uint16)
    planes = [np.concatenate([image[:, :1, k], np.diff(image[:, :, k], axis=1)], axis=1).astype(">u2").tobytes() for k in range(2)]
    packed, head = [zlib.compress(p) for p in planes], 8
    tags = {256: (3, [4]), 257: (3, [5]), 258: (3, [16, 16]), 259: (3, [8]), 273: (4, [head, head + len(packed[0])]), 277: (3, [2]), 278: (3, [5]), 279: (4, [len(x) for x in packed]), 284: (3, [2]), 317: (3, [2])}
    at = head + sum(map(len, packed))
    extra, body, more = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f">{len(values)}{'HI'[kind - 3]}", *values)
        if len(raw) > 4:
            raw, extra = struct.pack(">I", more + len(extra)), extra + raw
        body += struct.pack(">HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    data = struct.pack(">2sHI", b"MM", 42, at) + b"".join(packed) + struct.pack(">H", len(tags)) + body + b"\0" * 4 + extra
    (tags_read,) = tiff.directories(data)
    assert (tiff.page(data, tags_read) == image).all()


def test_float_predictor():
    image = np.random.default_rng(3).normal(size=(3, 5)).astype("<f4")
    raw = image.astype(">f4").view(np.uint8).reshape(3, 5, 4).transpose(0, 2, 1).reshape(3, 20)
    raw = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], axis=1)
    out = tiff._unpredict(np.frombuffer(raw.tobytes(), "<u4").reshape(3, 5, 1), 3)
    assert (out[:, :, 0].astype("<u4").view("<f4") == image).all()


def test_operator_on_odd_media(spark):
    loop = bytearray(tiff.encode([np.zeros((2, 2), np.uint8)]))
    first = struct.unpack_from("<I", loop, 4)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * struct.unpack_from("<H", loop, first)[0], first)
    rows = [(1, None, "x"), (2, bytearray(b""), "x"), (3, bytearray(b"GIF89a.."), "x"), (4, loop, "y"), (5, bytearray(tiff.encode([np.ones((3, 2), np.uint8)] * 2)), "z"), (5, bytearray(tiff.encode([np.ones((3, 2), np.uint8)] * 2)), "z")]
    df = spark.createDataFrame(rows, "doc_id long, media binary, page string")
    got = [(r.doc_id, r.page, r.width, r.height, r.error) for r in tiff.pages(df, ["doc_id"]).orderBy("doc_id", "page").collect()]
    assert [g[:4] for g in got] == [(2, None, None, None), (3, None, None, None), (4, None, None, None), (4, 0, 2, 2), *[(5, 0, 2, 3)] * 2, *[(5, 1, 2, 3)] * 2]
    assert all(g[4] for g in got[:3]) and not any(g[4] for g in got[3:])
    assert tiff.pages(df.limit(0), ["doc_id"]).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in tiff.op2_tiff(spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, raw in texts.items():
        padded = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        media = tiff.encode([np.frombuffer(padded, np.uint8).reshape(-1, 64)], tiff.DEFLATE, 2)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest())


def test_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 200_000), (3, "é" * 200_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, len(r.pixels)) for r in tiff.pages(tiff.store_texts(df), ["doc_id", "n_bytes"]).collect())
    assert got == [(1, 0, 64), (2, 0, 64), (3, 400_000, 400_000), (3, 400_000, 400_000)]


def patched(data, tag, value):
    """A copy in which the first directory's *tag* has *value* (of the encoder's 32-bit values)."""
    out = bytearray(data)
    at = struct.unpack_from("<I", out, 4)[0]
    for i in range(struct.unpack_from("<H", out, at)[0]):
        p = at + 2 + 12 * i
        if struct.unpack_from("<H", out, p)[0] == tag:
            struct.pack_into("<I", out, p + 8, value)
    return bytes(out)


def test_bad_files_give_error_rows(spark):
    good = tiff.encode([np.full((40, 8), 7, np.uint8), np.full((3, 3), 9, np.uint8)], tiff.DEFLATE, 2, rows_per_strip=64)
    tiled = tiff.encode([np.ones((20, 20), np.uint8)], tiff.LZW, tile=(16, 16))
    bad = [patched(good, 278, 0), patched(good, 256, 1 << 31), patched(good, 257, 65536), patched(good, 258, 7), patched(good, 259, 77), patched(good, 277, 0), patched(good, 317, 4), patched(tiled, 322, 0), patched(tiled, 323, 1 << 30)]
    bad.append(patched(tiff.encode([np.ones((40, 8), np.uint8)], rows_per_strip=40), 278, 8))  # fewer strips than rows need
    df = spark.createDataFrame([(i, bytearray(x), 1, 2, 3) for i, x in enumerate(bad)], "page int, media binary, width int, error int, pixels int")
    out = tiff.pages(df, ["page", "width", "error", "pixels"])
    assert out.columns[:4] == ["page", "width", "error", "pixels"] and {"page_", "width_", "error_", "pixels_"} < set(out.columns)
    rows = out.collect()
    for i, x in enumerate(bad):
        own = [r for r in rows if r.page == i]
        assert own[0]["error_"] and own[0]["pixels_"] is None and own[0]["page_"] == 0, i
        if x[:200] != tiled[:200] and len(own) > 1:  # the page after it is read
            assert own[1]["page_"] == 1 and own[1]["pixels_"] == bytes([9] * 9)


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_flipped_bytes_never_raise_anything_else(data):
    scheme = data.draw(st.sampled_from([tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]))
    raw = bytearray(tiff.encode([np.arange(60, dtype=np.uint8).reshape(6, 10), np.zeros((4, 4), np.uint8)], scheme, data.draw(st.sampled_from([1, 2])), tile=data.draw(st.sampled_from([None, (4, 4)]))))
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    try:
        for tags in tiff.directories(bytes(raw)):
            try:
                tiff.average_hash(tiff.page(bytes(raw), tags))
            except tiff.BAD:
                pass
    except tiff.BAD:
        pass


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_packed_samples_and_turned_bits(bits):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 11)).astype(np.uint8)
    packed = b""
    for row in image:
        text = "".join(f"{v:0{bits}b}" for v in row)
        packed += int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
    for fill in (1, 2):
        body = packed if fill == 1 else bytes(int(f"{b:08b}"[::-1], 2) for b in packed)
        tags = {0: ("<",), 256: (11,), 257: (5,), 258: (bits,), 259: (1,), 266: (fill,), 273: (0,), 277: (1,), 278: (5,), 279: (len(body),)}
        assert (tiff.page(body, tags)[:, :, 0] == image).all()


def test_inflation_is_bounded():
    bomb = zlib.compress(bytes(50_000_000))
    tags = {0: ("<",), 256: (8,), 257: (8,), 258: (8,), 259: (8,), 273: (0,), 277: (1,), 278: (8,), 279: (len(bomb),)}
    assert tiff.page(bomb, tags).shape == (8, 8, 1) and len(tiff._unpack(bomb, tiff.DEFLATE, 64)) == 64
