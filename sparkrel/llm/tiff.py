"""TIFF media columns: encode bytes as images, decode images to one row per page.

The decoder walks the chain of image directories (classic and BigTIFF, either byte order), reads strips
or tiles, undoes PackBits, LZW or deflate, then the predictor.  All of it works on one value in memory;
rows are independent, so the operator is a map without any shuffle.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, table

# Fixed values of the format (TIFF 6.0): compression schemes and the sizes of field types.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: Columns of a decoded page.
PAGE_SCHEMA = "page int, width long, height long, samples int, bits int, compression int, predictor int, pixels binary, ahash string, error string"


class TiffError(ValueError):
    """The bytes are not a TIFF that this decoder reads."""


# ---------------------------------------------------------------- codecs


def packbits_decode(data: bytes, size: int | None = None) -> bytes:
    """The bytes of packed runs, up to the run that completes *size* of them."""
    out, i, n, made = [], 0, len(data), 0
    while i < n and (size is None or made < size):
        head = data[i]
        if head < 128:
            run = data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            run = data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            run = b""
            i += 1
        out.append(run)
        made += len(run)
    return b"".join(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + run
        while j < n and j - i < 128 and data[j : j + 1] * 3 != data[j : j + 3]:
            j += 1
        j = min(j, i + 128)
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early, up to *size* bytes or little more."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, made = base[:], [], 0
    bits = width = at = 0
    width, last = 9, b""
    for byte in data:
        bits = (bits << 8 | byte) & 0xFFFFFFFF
        at += 8
        if at < width:
            continue
        at -= width
        code = bits >> at & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            words, width, last = base[:], 9, b""
            continue
        if not last:
            if code > 255:
                raise TiffError("LZW code beyond the table")
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code beyond the table")
            words.append(last + word[:1])
            if len(words) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        last = word
        made += len(word)
        if size is not None and made >= size:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, at, width = bytearray(), 0, 0, 9
    words = {bytes((i,)): i for i in range(256)}
    free = 258

    def put(code: int) -> None:
        nonlocal bits, at
        bits, at = bits << width | code, at + width
        while at >= 8:
            at -= 8
            out.append(bits >> at & 255)
        bits &= (1 << at) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = free
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
        if free >= 4094:
            put(256)
            words, free, width = {bytes((j,)): j for j in range(256)}, 258, 9
        word = data[i : i + 1]
    if word:
        put(words[word])
        free += 1
        if free + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if at:
        out.append(bits << 8 - at & 255)
    return bytes(out)


def _unpack(data: bytes, scheme: int, size: int) -> bytes:
    """At least *size* bytes, if there are so many; never many more."""
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if scheme == PACKBITS:
        return packbits_decode(data, size)
    return lzw_decode(data, size)


#: Bytes that one byte of each scheme can stand for at most (LZW: a code of 9 bits for a word of 4096).
RATIO = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
#: Each byte with its bits in the opposite order.
TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _pack(data: bytes, scheme: int, level: int) -> bytes:
    return {NONE: bytes, DEFLATE: lambda x: zlib.compress(x, level), PACKBITS: packbits_encode, LZW: lzw_encode}[scheme](data)


# ---------------------------------------------------------------- encoder


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, level: int = 1) -> bytes:
    """8-bit pages (height x width or height x width x samples) as one little-endian TIFF.

    Directories are chained; image data are strips of *rows_per_strip* rows, or *tile* (height, width) tiles
    padded with zeros.  Predictor 2 stores differences along a row.
    """
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in pages:
        image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None], np.uint8)
        height, width, samples = image.shape
        th, tw = tile or (min(rows_per_strip, max(height, 1)), width)
        offsets, counts = [], []
        for y in range(0, max(height, 1), th):
            for x in range(0, max(width, 1), tw):
                part = image[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                packed = _pack(part.tobytes(), compression, level)
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        tags = {256: [width], 257: [height], 258: [8] * samples, 259: [compression], 262: [2 if samples == 3 else 1], 277: [samples]}
        tags |= {322: [tw], 323: [th], 324: offsets, 325: counts} if tile else {273: offsets, 278: [th], 279: counts}
        tags |= {317: [predictor]} if predictor != 1 else {}
        body, extra, at = bytearray(), bytearray(), len(out) + 2 + 12 * len(tags) + 4
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(packed) > 4:
                packed, extra = struct.pack("<I", at + len(extra)), extra + packed
            body += struct.pack("<HHI", tag, 4, len(values)) + packed
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(body)
        out += struct.pack("<H", len(tags)) + body + b"\0\0\0\0" + extra
    return bytes(out)


# ---------------------------------------------------------------- decoder


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """The tags of each image directory, in the order of the chain; a loop in the chain is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    inline, head = struct.calcsize(word), struct.calcsize(count)
    at, seen = struct.unpack_from(order + word, data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        tags = {0: (order,)}
        for i in range(n):
            p = at + head + i * entry
            tag, kind = struct.unpack_from(order + "HH", data, p)
            many = struct.unpack_from(order + word, data, p + 4)[0]
            size, p = TYPE_SIZE.get(kind, 0) * many, p + 4 + inline
            if size > inline:
                p = struct.unpack_from(order + word, data, p)[0]
            if kind in TYPE_CODE:
                tags[tag] = struct.unpack_from(f"{order}{many}{TYPE_CODE[kind]}", data, p)
        yield tags
        at = struct.unpack_from(order + word, data, at + head + n * entry)[0]


def _unpredict(part: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 2:
        return np.add.accumulate(part, axis=1, dtype=part.dtype)
    if predictor == 3:
        rows, width, samples = part.shape
        size = part.dtype.itemsize
        planes = np.add.accumulate(part.reshape(rows, -1).view(np.uint8).reshape(rows, -1, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, width * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(f">u{size}").astype(part.dtype).reshape(part.shape)
    return part


def _samples(raw: bytes, rows: int, per_row: int, bits: int, kind: np.dtype) -> np.ndarray:
    """rows x per_row samples; those of less than a byte are packed row by row."""
    if bits >= 8:
        return np.frombuffer(raw, kind, rows * per_row).reshape(rows, per_row)
    packed = np.frombuffer(raw, np.uint8, rows * -(-per_row * bits // 8)).reshape(rows, -1)
    single = np.unpackbits(packed, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    return (single << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one directory's image: height x width x samples; 1, 2 and 4 bits become a byte.

    An image that its bytes cannot hold, or whose strips or tiles are not all there, is an error.
    """
    one = lambda tag, default: tags.get(tag, (default,))[0]
    order, width, height, samples = tags[0][0], one(256, 0), one(257, 0), one(277, 1)
    depths, scheme, predictor, planar, fill = tags.get(258, (1,)), one(259, 1), one(317, 1), one(284, 1), one(266, 1)
    bits = depths[0]
    for what, fine in (("bits a sample", bits in (1, 2, 4, 8, 16, 32, 64) and set(depths) == {bits}), ("compression", scheme in RATIO), ("planes", planar in (1, 2)), ("order of bits", fill in (1, 2)), ("samples", samples > 0), ("predictor", predictor == 1 or predictor == 2 and bits >= 8 or predictor == 3 and bits >= 16)):
        if not fine:
            raise TiffError(f"{what} not read: {dict(zip((258, 259, 284, 266, 277, 317), (depths[:8], scheme, planar, fill, samples, predictor), strict=True))}")
    kind, deep = np.dtype(f"{order}u{max(8, bits) // 8}"), samples if planar == 1 else 1
    tiled = 324 in tags
    th, tw = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width)
    offsets, counts = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
    if not height or not width:
        return np.zeros((height, width, samples), kind.newbyteorder("="))
    if min(th, tw) <= 0:
        raise TiffError("strips or tiles of no size")
    down, across = -(-height // th), -(-width // tw)
    planes = 1 if planar == 1 else samples
    if len(offsets) != len(counts) or len(offsets) != down * across * planes:
        raise TiffError(f"{len(offsets)} strips or tiles of {down * across * planes}")
    stored = sum(max(0, min(n, len(data) - at)) for at, n in zip(offsets, counts, strict=True))
    if width * height * samples * bits // 8 > stored * RATIO[scheme] or tiled and th * tw * deep * bits // 8 > max(counts) * RATIO[scheme]:
        raise TiffError("the bytes cannot hold an image of that size")
    image = np.zeros((height, width, samples), kind.newbyteorder("="))
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        plane, rest = divmod(i, down * across)
        y, x = rest // across * th, rest % across * tw
        rows = th if tiled else min(th, height - y)
        raw = data[at : at + n]
        raw = _unpack(raw.translate(TURNED) if fill == 2 else raw, scheme, rows * -(-tw * deep * bits // 8))
        part = _samples(raw, rows, tw * deep, bits, kind).reshape(rows, tw, deep)
        part = _unpredict(part.astype(kind.newbyteorder("=")) if predictor != 3 else part, predictor)
        part = part[: height - y, : width - x]
        if planar == 1:
            image[y : y + part.shape[0], x : x + part.shape[1]] = part
        else:
            image[y : y + part.shape[0], x : x + part.shape[1], plane] = part[:, :, 0]
    return image


def average_hash(image: np.ndarray) -> str:
    """64 bits: which of 8 x 8 cells of the first sample are brighter than the mean cell."""
    plane = image[:, :, 0].astype(np.float64)
    if not plane.size:
        return "0" * 16
    ys, xs = (np.arange(8) * s // 8 for s in plane.shape)
    cells = np.add.reduceat(np.add.reduceat(plane, np.minimum(ys, plane.shape[0] - 1), axis=0), np.minimum(xs, plane.shape[1] - 1), axis=1)
    return np.packbits(cells > cells.mean()).tobytes().hex()


#: What bad bytes may raise on the way.
BAD = (TiffError, struct.error, zlib.error, ValueError, IndexError, KeyError, OverflowError, MemoryError)
#: Bytes of pixels that are gathered before they are handed on.
HELD = 16 << 20


def pages(media: DataFrame, keep: list[str], column_name: str = "media") -> DataFrame:
    """One row for each page of the TIFFs in a binary column, after the columns named in *keep*.

    Null media give no row.  A page that cannot be read gives a row with its number and the error, and the pages
    after it are read; a broken chain of directories ends with a row without a number.  Bytes that are no TIFF
    give that row alone.  Names of *keep* stay; the page's own columns get underscores where they meet them.
    Repeated rows give repeated pages; no rows give none.  Values of any size are read whole; pages are handed on
    after every 16 MB of pixels.
    """
    taken = {c.lower() for c in keep}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_"
        return name

    inner = free("media")
    src = media.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column_name}`").alias(inner))
    own = [x.strip().split() for x in PAGE_SCHEMA.split(",")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), *(f"{free(n)} {k}" for n, k in own)])
    names = [*keep, *(free(n) for n, _ in own)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]

    def read(data: bytes):
        k = None
        try:
            for k, tags in enumerate(directories(data)):
                try:
                    image = page(data, tags)
                    get = lambda tag, tags=tags: tags.get(tag, (1,))[0]
                    yield k, image.shape[1], image.shape[0], image.shape[2], get(258), get(259), get(317), image.tobytes(), average_hash(image), None
                except BAD as e:
                    yield k, *[None] * 8, str(e) or type(e).__name__
        except BAD as e:
            yield *[None] * 9, str(e) or type(e).__name__

    def run(batches):
        for batch in batches:
            at, rows, held = [], [], 0

            def made(batch=batch):
                kept = [batch.column(j).take(pa.array(at, pa.int32())) for j in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

            for i, data in enumerate(batch.column(len(keep))):
                for row in read(data.as_py()) if data.is_valid else ():
                    at.append(i)
                    rows.append(row)
                    held += len(row[7] or b"")
                    if held > HELD:
                        yield made()
                        at, rows, held = [], [], 0
            if rows:
                yield made()

    return map_batches(src, schema, run)


def store_texts(docs: DataFrame, width: int = 64, compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) in UTF-8, zero-padded to a positive multiple of
    *width*, as a one-page grey TIFF of that width."""
    src = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw = column(batch, "raw").to_pylist()
            media = []
            for x in raw:
                n = max(1, -(-len(x) // width))
                media.append(encode([np.frombuffer(x.ljust(n * width, b"\0"), np.uint8).reshape(n, width)], compression, predictor))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(src, f"doc_id {kind}, n_bytes long, media binary", run)


def op2_tiff(spark, sf_dir: str) -> DataFrame:
    """Every text as a TIFF and back, with digests of what was read."""
    media = store_texts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "media", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    read = pages(media, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return read.select(
        "doc_id", "n_bytes", F.length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.concat_ws(":", F.lit("tiff"), "width", "height", "compression", "predictor", "ahash").alias("feature"),
    )
