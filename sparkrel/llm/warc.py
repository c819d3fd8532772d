"""WARC archives with a Zstandard dictionary.

Each task writes the records of its partition to archives of bounded size.  An archive opens with a skippable
frame that holds a dictionary, built from the first records of that archive; then each record is a frame of
its own, compressed with that dictionary, so any record can be read with the dictionary and its offset alone.
Equal payloads are written once; the others are revisit records without a body.

Deciding who revisits whom takes one shuffle of digests.  The repeated ones are broadcast while there are few of
them, so pages stay where they are; beyond that pages are shuffled by digest, payloads and all, but for digests that
hold over 1/1000 of all rows (so at most 1000 of them): these are told apart by a broadcast and their revisits'
payloads dropped before, so that no task gets a hot digest's pages.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, map_batches, shared_dir, stored, table
from .files import reading, writing

# The magic of the skippable frame of a dictionary, of a dictionary, of a frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
#: Payloads below this size are never revisited.
LEAST = 1000
#: Bytes of records that an archive's dictionary is built from, and its size at most.
TRAINING, DICT_SIZE = 4 << 20, 64 << 10
#: Bytes of records, before compression, after which a new archive is begun.
ARCHIVE = 256 << 20
#: A digest with over this share of all rows is broadcast; so many repeated ones (100 bytes each) are all broadcast.
HOT, BROADCAST_ROWS = 1000, 200_000


# ---------------------------------------------------------------- records


def record(kind: str, page_id, url: str, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has no body and names the payload's digest and size."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Payload-Length", str(size))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        payload = b""
    head += [("Content-Type", "text/html;charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and body of a record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record's length differs")
    return headers, rest[:size]


def dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary trained on the samples; too few or too small ones serve as its raw content."""
    raw = b"".join(samples)
    if not raw:
        return None
    try:
        return zstandard.train_dictionary(min(DICT_SIZE, max(1024, len(raw) // 16)), samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return raw[-DICT_SIZE:]


def _loaded(data: bytes | None) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data.startswith(DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """An archive under way: the first records wait until the dictionary is built from them."""

    def __init__(self, out, level: int = 3) -> None:
        self.out, self.level, self.waiting, self.size, self.zip = out, level, [], 0, None
        self.count = self.raw = 0

    def add(self, rec: bytes) -> None:
        self.count, self.raw = self.count + 1, self.raw + len(rec)
        if self.zip:
            self.out.write(self.zip.compress(rec))
            return
        self.waiting.append(rec)
        self.size += len(rec)
        if self.size >= TRAINING:
            self._begin()

    def _begin(self) -> None:
        data = dictionary(self.waiting)
        if data:
            packed = zstandard.ZstdCompressor(level=self.level).compress(data)
            self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.zip = zstandard.ZstdCompressor(level=self.level, dict_data=_loaded(data), write_checksum=True)
        for rec in self.waiting:
            self.out.write(self.zip.compress(rec))
        self.waiting = []

    def finish(self) -> None:
        if not self.zip:
            self._begin()


def records(src) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, read as a stream."""
    pending, data = src.read(8), None
    if len(pending) == 8 and struct.unpack_from("<I", pending)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", pending, 4)[0]
        data, pending = src.read(size), b""
        if len(data) != size:
            raise ValueError("the dictionary is cut off")
        if data.startswith(FRAME):
            data = zstandard.ZstdDecompressor().decompress(data)
    unzip, one, parts = zstandard.ZstdDecompressor(dict_data=_loaded(data)), None, []
    while pending := pending or src.read(256 << 10):
        one = one or unzip.decompressobj()
        parts.append(one.decompress(pending))
        pending = one.unused_data if one.eof else b""
        if one.eof:
            yield parse(b"".join(parts))
            one, parts = None, []
    if one:
        raise ValueError("a record is cut off")


# ---------------------------------------------------------------- the operator

MANIFEST = "path string, records long, raw_bytes long"


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary; null where another record has it), payload_bytes, payload_digest,
    record_type and refers_to of every row of *pages* (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    long = F.col("payload_bytes") >= LEAST
    sums = rows.where(long).groupBy(F.col("payload_digest").alias("d")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sums = stored(sums, "warc-digests")
    if sums.count() <= BROADCAST_ROWS:
        return _told(rows.join(F.broadcast(sums.select("d", "first")), long & (F.col("payload_digest") == F.col("d")), "left"))
    total = pages.count()
    hot = sums.where(F.col("n") > total / HOT).select(F.col("d").alias("hot_d"), F.col("first").alias("hot_first"))
    rest = sums.where(F.col("n") <= total / HOT).select("d", F.col("first").alias("rest_first"))
    # At most HOT digests are that common: the broadcast is bounded.
    told = rows.join(F.broadcast(hot), long & (rows["payload_digest"] == hot["hot_d"]), "left")
    # A row whose digest is settled, or too short to be revisited, joins on a key of its own.
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "payload_digest", "url"))
    told = told.withColumn("key", F.when(long & F.col("hot_d").isNull(), F.col("payload_digest")).otherwise(own))
    revisits = F.col("hot_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot_first"))
    told = told.withColumn("payload", F.when(~revisits, F.col("payload")))
    return _told(told.join(rest, told["key"] == rest["d"], "left").withColumn("first", F.coalesce("hot_first", "rest_first")))


def _told(joined: DataFrame) -> DataFrame:
    """The columns of roles(), from rows with the largest page_id of their payload, if it is repeated."""
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Archive every row of *pages* (page_id, url, html) under *path*; return the manifest (path, records, raw_bytes).

    A null html is an empty payload, a null url an empty one.  Of equal payloads of at least 1000 bytes the
    rows with the largest page_id are responses, the others revisits of it; a null page_id is never the
    largest, and equal payloads under null ids alone are all responses.  Rows that repeat a response (same id)
    are responses too.  Other columns are ignored.  An empty table gives no archives.
    """
    rows = roles(pages).sortWithinPartitions("page_id", "payload_digest", "url")
    schema = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        from pyspark import TaskContext

        part, k, made = TaskContext.get().partitionId(), 0, []
        open_file = writer = uri = None
        try:
            for batch in batches:
                for page_id, url, payload, size, digest, kind, refers in zip(*(column(batch, c).to_pylist() for c in schema), strict=True):
                    if writer is None:
                        uri = f"{path}/part-{part:06d}-{k:04d}.warc.zst"
                        open_file = writing(uri)
                        writer = Writer(open_file.__enter__())
                    writer.add(record(kind, "null" if page_id is None else page_id, url or "", payload or b"", digest, size, refers))
                    if writer.raw >= ARCHIVE:
                        writer.finish()
                        open_file.__exit__(None, None, None)
                        made.append((uri, writer.count, writer.raw))
                        writer, k = None, k + 1
            if writer:
                writer.finish()
                open_file.__exit__(None, None, None)
                made.append((uri, writer.count, writer.raw))
        except BaseException as e:
            if writer:
                open_file.__exit__(type(e), e, e.__traceback__)
            raise
        if made:
            a, b, c = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["path", "records", "raw_bytes"])

    map_batches(rows, MANIFEST, run).write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row a record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    A response's digest and size are computed from its body; one that differs from its header is an error.
    """
    parts = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    files = manifest.select("path").repartition(parts, "path")
    number = lambda x: None if x in (None, "<urn:page:null>") else int(x[len("<urn:page:") : -1])

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, held = [], 0
                with reading(uri) as src:
                    for head, body in records(src):
                        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["payload-length"])
                        if head["warc-type"] == "response":
                            found = hashlib.sha1(body).hexdigest()
                            if (found, len(body)) != (digest, size):
                                raise ValueError(f"{uri}: a payload differs from its digest")
                        rows.append((number(head["warc-record-id"]), head["warc-target-uri"], size, digest, head["warc-type"], number(head.get("warc-refers-to")), body))
                        held += len(body)
                        if held > 4 << 20 or len(rows) > 4000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return map_batches(files, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary", run)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, then list what the archives hold."""
    return read(write(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))).drop("payload", "url")
