"""Content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of the last ids meets a mask, so equal passages give
equal chunks wherever they stand.  Chunks are named by the BLAKE2b hash of their ids; packs hold each chunk
once.  A recipe lists a document's chunks; recipe files hold documents in ascending doc_id order.  Merkle
trees run from chunk hashes over documents to files, and one over the manifest's files to the store's root, which is
kept beside it; reading recomputes all of them, so a lost file or manifest row is an error.

One shuffle carries chunks (to the pack that their hash names) and recipes (to the file of their doc_id
range).  Copies of a chunk are dropped before the shuffle, in each task, so that a passage that all documents
hold reaches its pack once a task at most; packs drop the rest as they stream by in order.

File layout, little-endian: 8 bytes of magic; blocks of u32 packed size, u32 raw size, zstd frame; a block of
packed size 0; the file's 32-byte Merkle root.  A pack's raw block: entries of 16-byte hash, u32 count of ids,
u8 id width, ids.  A recipe's raw block: entries of u8 has-id, i64 doc_id, u64 ids, u32 chunks, 32-byte root,
then per chunk 16-byte hash and u32 count of ids.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, map_batches, shared_dir, table, texts
from .files import reading, writing
from .tokens import default_path, encoder, slices

PACK, RECIPES = b"IDPACK01", b"IDRECP01"
#: Chunk sizes in ids: least, usual, most.
LEAST, USUAL, MOST = 64, 256, 1024
WINDOW, BASE = 8, 0x9E3779B97F4A7C15
BLOCK = 1 << 20
#: Names of chunks that a task remembers having sent, twice (some 100 bytes each); more are sent again, to no harm.
SEEN = 100_000
ENTRY, RECIPE = "<16sIB", "<BqQI32s"

# ---------------------------------------------------------------- chunks and trees


def chunk_ends(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of every document, and how many chunks each has; *bounds* are the documents' ends."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)
    mixed ^= mixed >> np.uint64(29)
    rolled, factor = mixed.copy(), 1
    for j in range(1, WINDOW):
        factor = factor * 0xBF58476D1CE4E5B9 % (1 << 64)
        rolled[j:] += mixed[:-j] * np.uint64(factor)
    marks = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(usual - 1) == 0) + 1
    marks = marks.tolist()
    ends, counts, start, m = [], [], 0, 0
    for bound in bounds.tolist():
        before = len(ends)
        while start < bound:
            low, high = start + least, min(start + most, bound)
            while m < len(marks) and marks[m] < low:
                m += 1
            end = marks[m] if m < len(marks) and marks[m] < high else high
            ends.append(end)
            start = end
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def name_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves in order; a leaf and a node are hashed apart; the root of none is of the empty string."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Tree:
    """The Merkle root of leaves that arrive one by one, in memory that grows with their logarithm."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.stack and self.stack[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.stack.pop()[1] + node).digest()
            height += 1
        self.stack.append((height, node))

    def root(self) -> bytes:
        if not self.stack:
            return merkle([])
        node = self.stack[-1][1]
        for _, left in self.stack[-2::-1]:
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


class StoreError(ValueError):
    """What is stored does not match its hashes."""


# ---------------------------------------------------------------- writing


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], packs: int, recipes: int) -> DataFrame:
    """Chunks to slots 0 to packs - 1, recipes to the slots after them."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        enc = encoder(tokenizer)
        end, limits = np.array([end_id], enc.dtype).tobytes(), np.array(bounds, np.int64)
        width = enc.dtype.itemsize
        seen: dict[bytes, None] = {}
        older: dict[bytes, None] = {}
        for batch in batches:
            all_texts, doc_ids = texts(batch), column(batch, "doc_id").to_pylist()
            # Runs small enough that the rolling hash stays in the processor's cache.
            for lo, hi in slices(all_texts, 500_000):
                found = enc.encode(all_texts[lo:hi])
                n = np.fromiter(map(len, found), np.int64, len(found)) // width + 1
                raw = end.join([*found, b""])
                ids = np.frombuffer(raw, enc.dtype)
                wide = memoryview(ids.astype("<u4")).cast("B")
                ends, counts = chunk_ends(ids, np.cumsum(n))
                starts = np.concatenate([[0], ends[:-1]])
                names = [name_of(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                sizes = (ends - starts).astype("<u4")
                once = {x: i for i, x in enumerate(names) if x not in seen and x not in older}
                if len(seen) > SEEN:
                    seen, older = {}, seen
                seen.update(dict.fromkeys(names))
                at = list(once.values())
                yield _rows([int.from_bytes(x[:4], "little") % packs for x in once], list(once), [None] * len(at), sizes[at].astype(np.int64), [raw[width * starts[i] : width * ends[i]] for i in at])
                listed, bodies, c = [x + s.tobytes() for x, s in zip(names, sizes, strict=True)], [], 0
                for k in counts.tolist():
                    bodies.append(b"".join(listed[c : c + k]))
                    c += k
                known = np.array([-(1 << 63) if x is None else x for x in doc_ids[lo:hi]], np.int64)
                slots = packs + np.searchsorted(limits, known, "right")
                yield _rows(slots, [None] * len(slots), doc_ids[lo:hi], n, bodies)

    return map_batches(src, "slot int, name binary, doc_id long, n long, body binary", run)


def _rows(slots, names, doc_ids, n, bodies) -> pa.RecordBatch:
    cols = [pa.array(slots, pa.int32()), pa.array(names, pa.binary()), pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["slot", "name", "doc_id", "n", "body"])


class _File:
    """A file of blocks under way."""

    def __init__(self, out, magic: bytes) -> None:
        import zstandard

        self.out, self.tree, self.pending, self.size = out, Tree(), [], 0
        self.zip = zstandard.ZstdCompressor(level=3)
        out.write(magic)

    def add(self, leaf: bytes, entry: bytes) -> None:
        self.tree.add(leaf)
        self.pending.append(entry)
        self.size += len(entry)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            raw = b"".join(self.pending)
            packed = self.zip.compress(raw)
            self.out.write(struct.pack("<II", len(packed), len(raw)) + packed)
            self.pending, self.size = [], 0

    def finish(self) -> bytes:
        self.flush()
        root = self.tree.root()
        self.out.write(struct.pack("<I", 0) + root)
        return root


def _blocks(src, magic: bytes) -> Iterator[bytes]:
    """The raw blocks of a file; the last item is its root, marked by a list."""
    import zstandard

    if src.read(8) != magic:
        raise StoreError("no such file kind")
    unzip = zstandard.ZstdDecompressor()
    while size := struct.unpack("<I", src.read(4))[0]:
        raw = struct.unpack("<I", src.read(4))[0]
        yield unzip.decompress(src.read(size), max_output_size=raw)
    yield [src.read(32)]


MANIFEST = "path string, kind string, slot int, entries long, n_ids long, root binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode and store every document of *docs* (doc_id, text; null: empty) under *path*; return the manifest.

    Documents without an id come first; equal ids keep an order given by their content.  Repeated rows are
    stored as documents of their own that share chunks.  An empty table gives files without entries or none.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, parts)
    both = _tokenized(docs, tokenizer, end_id, bounds, parts, len(bounds) + 1)
    dealt = both.repartitionById(parts + len(bounds) + 1, F.col("slot")).sortWithinPartitions("slot", "name", "doc_id", "n", "body")
    width = 2 if encoder(tokenizer).dtype.itemsize == 2 else 4

    def run(batches):
        current = file = stack = last = None
        made = []

        def close():
            root = file.finish()
            stack.__exit__(None, None, None)
            made.append((*current, root))

        rows = ((*r,) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        entries = n_ids = 0
        try:
            for slot, name, doc_id, n, body in rows:
                kind = "recipes" if name is None else "pack"
                if current is None or current[2] != slot:
                    if current is not None:
                        current = (*current[:3], entries, n_ids)
                        close()
                    uri = f"{path}/{kind}-{slot:08d}"
                    current, entries, n_ids, last = (uri, kind, slot), 0, 0, None
                    stack = writing(uri)
                    file = _File(stack.__enter__(), RECIPES if name is None else PACK)
                if name is not None:
                    if name == last:
                        continue
                    last = name
                    file.add(name, struct.pack(ENTRY, name, n, width) + body)
                else:
                    own = [body[i : i + 16] for i in range(0, len(body), 20)]
                    root = merkle(own)
                    file.add(root, struct.pack(RECIPE, doc_id is not None, doc_id or 0, n, len(own), root) + body)
                entries += 1
                n_ids += n
            if current is not None:
                current = (*current[:3], entries, n_ids)
                close()
        except BaseException as e:
            if stack is not None:
                stack.__exit__(type(e), e, e.__traceback__)
            raise
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["path", "kind", "slot", "entries", "n_ids", "root"])

    map_batches(dealt, MANIFEST, run).write.parquet(f"{path}/manifest")
    with writing(f"{path}/root") as f:
        f.write(_root(spark, path))
    return open_store(spark, path)


def _root(spark: SparkSession, path: str) -> bytes:
    """The Merkle root over the manifest; the driver reads one row a file."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("slot").collect()
    return merkle([struct.pack("<iqq", r.slot, r.entries, r.n_ids) + r.kind.encode() + bytes(r.root) for r in rows])


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a stored set of documents, after it was held against the store's root."""
    with reading(f"{path}/root") as f:
        if f.read() != _root(spark, path):
            raise StoreError(f"{path}: the manifest differs from the store's root")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ids that cut doc_id into ranges of about equal counts."""
    if parts < 2:
        return []
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), F.lit([i / parts for i in range(1, parts)]), F.lit(max(1000, 10 * parts)))).first()[0]
    return sorted(set(cuts or ()))


# ---------------------------------------------------------------- reading


def chunks(manifest: DataFrame) -> DataFrame:
    """name, n, crc of every stored chunk, after its hash and its pack's root were recomputed."""
    src = manifest.where("kind = 'pack'").select("path", "root", "entries")

    def run(batches):
        for uri, root, entries in _each(batches):
            tree, rows, n_rows = Tree(), [], 0
            with reading(uri) as f:
                for raw in _blocks(f, PACK):
                    if isinstance(raw, list):
                        if not raw[0] == root == tree.root() or n_rows != entries:
                            raise StoreError(f"{uri}: root differs")
                        continue
                    for name, ids in _entries(raw):
                        if name_of(ids) != name:
                            raise StoreError(f"{uri}: a chunk differs from its name")
                        tree.add(name)
                        n_rows += 1
                        rows.append((name, len(ids) // 4, zlib.crc32(ids)))
                    yield _table(rows, [pa.binary(), pa.int64(), pa.int64()], ["name", "n", "crc"])
                    rows = []

    return map_batches(_spread(src), "name binary, n long, crc long", run)


def _entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    i = 0
    while i < len(raw):
        name, n, width = struct.unpack_from(ENTRY, raw, i)
        i += struct.calcsize(ENTRY)
        yield name, np.frombuffer(raw, f"<u{width}", n, i).astype("<u4").tobytes()
        i += n * width


def recipe_rows(manifest: DataFrame) -> DataFrame:
    """One row a chunk of each document: file, place (of the document in it), doc_id, start (ids of all documents
    before it), n_tokens, n_chunks, name, n, after (ids of the document after this chunk)."""
    files = manifest.where("kind = 'recipes'")
    # One row a file: the running sum sees the manifest, not the documents.
    files = files.withColumn("start", F.coalesce(F.sum("n_ids").over(W.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    src = files.select("path", "root", "entries", "slot", "start")

    def run(batches):
        for uri, root, entries, slot, start in _each(batches):
            tree, place, rows = Tree(), 0, []
            with reading(uri) as f:
                for raw in _blocks(f, RECIPES):
                    if isinstance(raw, list):
                        if not raw[0] == root == tree.root() or place != entries:
                            raise StoreError(f"{uri}: root differs")
                        continue
                    i = 0
                    while i < len(raw):
                        has, doc_id, n, k, own = struct.unpack_from(RECIPE, raw, i)
                        i += struct.calcsize(RECIPE)
                        names = [raw[j : j + 16] for j in range(i, i + 20 * k, 20)]
                        sizes = [int.from_bytes(raw[j + 16 : j + 20], "little") for j in range(i, i + 20 * k, 20)]
                        i += 20 * k
                        if merkle(names) != own or sum(sizes) != n:
                            raise StoreError(f"{uri}: a document's root differs")
                        tree.add(own)
                        after = n
                        for name, size in zip(names, sizes, strict=True):
                            after -= size
                            rows.append((slot, place, doc_id if has else None, start, n, k, name, size, after))
                        start += n
                        place += 1
                        if len(rows) > 20_000:
                            yield _table(rows, RECIPE_KINDS, RECIPE_NAMES)
                            rows = []
            if rows:
                yield _table(rows, RECIPE_KINDS, RECIPE_NAMES)

    return map_batches(_spread(src), "file int, place long, doc_id long, start long, n_tokens long, n_chunks long, name binary, n long, after long", run)


RECIPE_NAMES = ["file", "place", "doc_id", "start", "n_tokens", "n_chunks", "name", "n", "after"]
RECIPE_KINDS = [pa.int32(), *[pa.int64()] * 5, pa.binary(), *[pa.int64()] * 2]


def _spread(files: DataFrame) -> DataFrame:
    """A file a task, about: names are few and short, what they name is not."""
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def _each(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _table(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _crc_tables(power: int) -> np.ndarray:
    """For each byte of a CRC (4 x 256), what 2**power zero bytes after the data make of it."""
    table_ = np.array([[zlib.crc32(b"\0", v << 8 * k ^ 0) for v in range(256)] for k in range(4)], np.uint64)
    # zlib inverts before and after: the linear part is crc(v) xor crc(0).
    table_ ^= np.uint64(zlib.crc32(b"\0", 0))
    for _ in range(power):
        table_ = _through(table_, table_.ravel()).reshape(4, 256)
    return table_


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint64(255)]
    for k in range(1, 4):
        out = out ^ tables[k][crc >> np.uint64(8 * k) & np.uint64(255)]
    return out


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The share of data with this CRC in the CRC of the data with so many bytes after it; shares add by xor."""
    crc, zeros = crc.astype(np.uint64), zeros.astype(np.uint64)
    power = 0
    while zeros.any():
        odd = zeros & np.uint64(1) == 1
        if odd.any():
            if power not in _TABLES:
                _TABLES[power] = _crc_tables(power)
            crc[odd] = _through(_TABLES[power], crc[odd])
        zeros, power = zeros >> np.uint64(1), power + 1
    return crc


_TABLES: dict[int, np.ndarray] = {}


def read_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of all its ids, 32 bits each) of every stored document.

    Chunks join recipes by name; a common chunk makes one key hot, which the engine splits, as both sides of
    the join are plain exchanges.  CRCs of chunks add up to the document's by xor, so no document's ids are
    gathered.  A missing chunk is an error.
    """
    stored = chunks(manifest).withColumnsRenamed({"n": "stored_n", "name": "stored_name"})
    rows = recipe_rows(manifest)
    joined = rows.join(stored.hint("merge"), (rows["name"] == stored["stored_name"]) & (rows["n"] == stored["stored_n"]), "left")
    joined = joined.select("file", "place", "doc_id", "start", "n_tokens", "n_chunks", "crc", "after")

    def run(batches):
        for b in batches:
            if b.num_rows:
                crc = column(b, "crc")
                if crc.null_count:
                    raise StoreError("a chunk is missing")
                share = shifted(crc.to_numpy(zero_copy_only=False), column(b, "after").to_numpy() * 4)
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(share.astype(np.int64))], names=["file", "place", "doc_id", "start", "n_tokens", "n_chunks", "share"])

    shares = map_batches(joined, "file int, place long, doc_id long, start long, n_tokens long, n_chunks long, share long", run)
    docs = shares.groupBy("file", "place", "doc_id", "start", "n_tokens", "n_chunks").agg(F.bit_xor("share").alias("ids_crc32"), F.count(F.lit(1)).alias("found"))
    whole = F.when(F.col("found") == F.col("n_chunks"), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document lacks chunks")).cast("long"))
    return docs.select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of every stored document, reassembled from its chunks."""
    src = manifest.where("kind = 'pack'").select("path")

    def run(batches):
        for (uri,) in _each(batches):
            with reading(uri) as f:
                for raw in _blocks(f, PACK):
                    if isinstance(raw, bytes):
                        yield _table(list(_entries(raw)), [pa.binary(), pa.binary()], ["stored_name", "body"])

    stored = map_batches(_spread(src), "stored_name binary, body binary", run)
    rows = recipe_rows(manifest)
    joined = rows.join(stored.hint("merge"), rows["name"] == stored["stored_name"])
    parts = F.sort_array(F.collect_list(F.struct((-F.col("after")).alias("at"), "body")))
    docs = joined.groupBy("file", "place", "doc_id", "start").agg(parts.alias("parts"))
    return docs.select("doc_id", "start", F.expr("unhex(concat_ws('', transform(parts, p -> hex(p.body))))").alias("ids"))


def op8_castore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's ids, then read the store back."""
    return read_digests(write(table(spark, sf_dir, "documents"), shared_dir(spark, "castore"), default_path()))
