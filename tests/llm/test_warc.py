"""WARC: archives hold what was put in, and the query's answer is the contract's."""

import hashlib
import io
import struct

import pytest
import zstandard

from sparkrel.llm import warc
from sparkrel.llm.common import shared_dir

LONG = "<p>" + "many words of a page, " * 80


def expected(rows):
    """The contract, row by row."""
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = max(same, default=None)
        revisit = len(raw) >= 1000 and first is not None and page_id != first
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return out


ROWS = [(1, "u1", LONG), (5, "u5", LONG), (3, None, LONG), (2, "u2", "short"), (4, "u4", "short"), (6, "u6", None), (7, "u7", ""), (None, "n", LONG), (None, "n", "é" * 600), (None, "n", "é" * 600), (8, "a\r\nb: c", "x" * 2_000_000), (9, "u9", "y" * 999), (10, "u", "y" * 999), (12, "u", "dup" * 400), (12, "u", "dup" * 400)]


def read(spark, rows):
    df = spark.createDataFrame([(*r, "other", "clash") for r in rows], "page_id long, url string, html string, payload string, d string")
    return warc.read(warc.write(df, shared_dir(spark, "test")))


def test_odd_pages(spark):
    got = read(spark, ROWS)
    key = lambda r: repr(r)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=key) == sorted(expected(ROWS), key=key)
    bodies = {(r.page_id, r.url): bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert bodies[(5, "u5")] == LONG.encode() and bodies[(8, "a%0D%0Ab: c")] == b"x" * 2_000_000 and bodies[(6, "u6")] == b""
    assert read(spark, []).count() == 0


@pytest.mark.parametrize("most", [0, 200_000])
def test_a_hot_payload(spark, monkeypatch, most):
    # One payload makes up most rows: it is told apart by the broadcast, of all repeated digests or of the hot ones.
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(i, f"u{i}", LONG if i % 3 else f"{LONG}{i // 30}") for i in range(2000)]
    got = read(spark, rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows))


def test_archive_layout():
    out = io.BytesIO()
    w = warc.Writer(out)
    recs = [warc.record("response", i, f"http://x/{i}", f"<html>page {i} {'common text ' * 30}</html>".encode(), "d", 1, None) for i in range(500)]
    for r in recs:
        w.add(r)
    w.finish()
    raw = out.getvalue()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == warc.SKIPPABLE
    data = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
    assert data.startswith(warc.DICTIONARY)
    # The last record alone, with the dictionary.
    starts = [i for i in range(8 + size, len(raw)) if raw.startswith(warc.FRAME, i)]
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)).decompress(raw[starts[-1] :])
    assert one == recs[-1]
    assert [h["warc-record-id"] for h, _ in warc.records(io.BytesIO(raw))] == [f"<urn:page:{i}>" for i in range(500)]
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in recs)
    assert len(raw) < plain / 2
    for cut in (6, 8 + size - 1, len(raw) - 3):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.records(io.BytesIO(raw[:cut])))
    assert list(warc.records(io.BytesIO(b""))) == []


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    got = warc.op1_warc(spark, small).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows))
