"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 3 bits are found where balls of half that radius meet.  Balls of radius 1 meet
for fingerprints up to 2 bits apart; the odd third bit is left out: of three blocks of bits one holds a third
of the difference, so with each block masked in turn the other bits differ in 2 places at most.  Each distinct
fingerprint thus emits, for each masked block, the kept bits and all their variants within radius 1: 132 keys
of 42 or 43 bits (whole balls of radius 2 would take 2081).  Keys are shuffled; within a key pairs are
verified on all 64 bits, and only links that connect the key's members are kept, never all pairs of a group.

Copies share a fingerprint, so they are one key member however many they are.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_batches, stored, table
from .components import components

RADIUS = 3
#: The blocks of bits that are masked in turn.
BLOCKS = ((0, 21), (21, 42), (42, 64))
#: Members of a key up to which all its pairs are compared directly.
DIRECT = 4096


# ---------------------------------------------------------------- fingerprints


def hashes(text: str, width: int, seed: int) -> list[int]:
    """XXH64 of every word shingle, repeats included; fewer words: of all words; none: nothing."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, seed)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Majority bits of each document's hashes: a bit is 1 if set in over half of them; no hashes: zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(found.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(sums * 2 > counts[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (as a signed long) of every row; a null text has no words."""
    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got, pending, counts = [], [], []

            def flush():
                got.append(fingerprint(np.array(pending, np.uint64), np.array(counts, np.int64)))
                pending.clear()
                counts.clear()

            for text in column(batch, "text").to_pylist():
                own = hashes(text or "", width, seed)
                pending.extend(own)
                counts.append(len(own))
                if len(pending) > 200_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.concatenate(got).view(np.int64))], names=["doc_id", "fingerprint"])

    return map_batches(src, f"doc_id {kind}, fingerprint long", run)


# ---------------------------------------------------------------- links


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants() -> list[tuple[int, int, int]]:
    """(masked block, bits to keep, bits to flip) of every key that a fingerprint emits."""
    out = []
    for j, (low, high) in enumerate(BLOCKS):
        keep = ~((1 << high) - (1 << low)) & (1 << 64) - 1
        out += [(j, _signed(keep), 0)] + [(j, _signed(keep), _signed(1 << b)) for b in range(64) if not low <= b < high]
    return out


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(prints: np.ndarray, key: int, block: int) -> list[tuple[int, int]]:
    """Index pairs of verified links that connect what the links among *prints* connect: the members of one key
    of the block that is masked."""
    n, union, out = len(prints), _Union(len(prints)), []

    def link(a, b):
        near = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
        for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if union.join(i, j):
                out.append((i, j))

    if n <= DIRECT:
        for i in range(0, n, 512):
            near = np.bitwise_count(prints[i : i + 512, None] ^ prints[None, :]) <= RADIUS
            a, b = np.nonzero(near)
            a = a + i
            link(a[a < b], b[a < b])
        return out
    # Many members: their kept bits are at most one flip from the key, so links follow from the masked bits.
    low, high = BLOCKS[block]
    mask = np.uint64((1 << high) - (1 << low))
    flips = (prints ^ np.uint64(key)) & ~mask
    inner = (prints & mask) >> np.uint64(low)
    # Up to one masked bit apart, members are linked whatever their flips.
    order = np.argsort(inner, kind="stable")
    values, first = np.unique(inner[order], return_index=True)
    link(order[first[np.searchsorted(values, inner)]], np.arange(n))
    for b in range(high - low):
        to = values ^ np.uint64(1 << b)
        at = np.minimum(np.searchsorted(values, to), len(values) - 1)
        hit = values[at] == to
        link(order[first[hit]], order[first[at[hit]]])
    # Two apart: the same flip, or one side is the key itself.  Three apart: the same flip.
    flip = np.where(flips == 0, 0, np.bitwise_count(flips - np.uint64(1)) + 1).astype(np.uint64)
    code = flip << np.uint64(22) | inner
    order = np.argsort(code, kind="stable")
    values = code[order]

    def probe(sought, who):
        at = np.minimum(np.searchsorted(values, sought), n - 1)
        hit = values[at] == sought
        link(who[hit], order[at[hit]])

    every = np.arange(n)
    for bits in combinations(range(high - low), 2):
        x = np.uint64(sum(1 << b for b in bits))
        probe(code ^ x, every)
        probe(inner ^ x, every)
    for bits in combinations(range(high - low), 3):
        probe(code ^ np.uint64(sum(1 << b for b in bits)), every)
    return out


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fingerprint) that connect all pairs within 3 bits."""
    shapes = F.array(*[F.struct(F.lit(j).cast("byte").alias("j"), F.lit(k).cast("long").alias("k"), F.lit(x).cast("long").alias("x")) for j, k, x in variants()])
    keys = prints.select("fingerprint", F.explode(F.transform(shapes, lambda s: F.struct(s.j.alias("block"), F.col("fingerprint").bitwiseAND(s.k).bitwiseXOR(s.x).alias("key")))).alias("k")).select("fingerprint", "k.block", "k.key")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartition(parts, "key").sortWithinPartitions("key", "block", "fingerprint")

    def run(batches):
        rest = [np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64)]
        for batch in batches:
            k, b, p = (np.concatenate([r, column(batch, c).to_numpy()]) for r, c in zip(rest, ("key", "block", "fingerprint"), strict=True))
            # The last key may go on in the next batch.
            other = np.flatnonzero((k != k[-1]) | (b != b[-1])) if len(k) else ()
            whole = int(other[-1]) + 1 if len(other) else 0
            rest = [k[whole:], b[whole:], p[whole:]]
            yield from _within(k[:whole], b[:whole], p[:whole])
        yield from _within(*rest)

    return map_batches(dealt, "a long, b long", run).distinct()


def _within(k: np.ndarray, blocks: np.ndarray, p: np.ndarray):
    if len(k) < 2:
        return
    p = p.view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (blocks[1:] != blocks[:-1])]))
    sizes = np.diff(np.append(starts, len(k)))
    small = np.repeat(sizes <= 64, sizes)
    a, b = [], []
    for d in range(1, int(sizes[sizes <= 64].max(initial=0))):
        near = (k[d:] == k[:-d]) & (blocks[d:] == blocks[:-d]) & small[d:]
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[np.bitwise_count(p[at] ^ p[at + d]) <= RADIUS]
        a.append(p[at])
        b.append(p[at + d])
    for s, n in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        own = p[s : s + n]
        if pairs := spanning(own, int(k[s]) & (1 << 64) - 1, int(blocks[s])):
            i, j = np.array(pairs).T
            a.append(own[i])
            b.append(own[j])
    if a:
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0]).view(np.int64)), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], names=["a", "b"])


# ---------------------------------------------------------------- groups


def groups(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (long), component_id: the smallest doc_id of all that links reach.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows appear each time.
    A null doc_id takes part; a group of null ids alone has a null component_id.
    """
    return _rooted(docs, width, seed).select("doc_id", "fingerprint", "component_id")


def _rooted(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """The columns of groups(), and root: the fingerprint that names the group."""
    prints = stored(fingerprints(docs, width, seed), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(distinct))
    placed = distinct.join(roots, distinct["fingerprint"] == roots["id"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    least = least.select(F.col("root").alias("of"), "component_id")
    known = stored(placed.join(least, placed["root"] == least["of"]).select(F.col("fingerprint").alias("print"), "component_id", "root"), "fingerprint-groups")
    # Both sides are read from files: a fingerprint of very many copies is split by the join.
    return prints.join(known, prints["fingerprint"] == known["print"]).select("doc_id", "fingerprint", "component_id", "root")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


#: Ids of so many documents to remove (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def dedup(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """*docs* with one document of each near-duplicate group: the one with the smallest doc_id.

    Of rows that share a doc_id one stays in each group.  Rows without a doc_id cannot be told apart by it, and stay.
    """
    # Inner names are free of the columns of *docs*.
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(names)])
    return _deduped(docs, width, seed).toDF(*names)


def _deduped(docs: DataFrame, width: int, seed: int) -> DataFrame:
    found = stored(_rooted(docs, width, seed), "simhash-groups")
    # An id with texts in several groups can be the smallest of one and not of another: its rows are told by text.
    mixed = stored(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__mixed")).agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("__mixed"), "simhash-mixed")
    if mixed.isEmpty():
        return _dedup(docs, found)
    apart = docs.join(mixed, docs["doc_id"] == mixed["__mixed"], "left_semi")
    prints = fingerprints(apart.select(F.col("text").alias("doc_id"), "text").distinct(), width, seed).select(F.col("doc_id").alias("__text"), F.col("fingerprint").alias("__print"))
    firsts = found.where("doc_id = component_id").select(F.col("doc_id").alias("__of"), F.col("fingerprint").alias("__first"), F.col("root").alias("__root")).distinct()
    told = apart.join(prints, apart["text"].eqNullSafe(F.col("__text"))).join(firsts, (F.col("doc_id") == F.col("__of")) & (F.col("__print") == F.col("__first")))
    told = told.dropDuplicates(["__of", "__root"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    rest = docs.join(mixed, docs["doc_id"] == mixed["__mixed"], "left_anti")
    return _dedup(rest, found.join(mixed, found["doc_id"] == mixed["__mixed"], "left_anti")).unionByName(told)


def _dedup(docs: DataFrame, found: DataFrame) -> DataFrame:
    """dedup() where the rows of each doc_id are in one group."""
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "simhash-gone")
    few = gone.count() <= BROADCAST_ROWS
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["__gone"], "left_anti")
    twice = stored(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__twice")), "simhash-twice")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept["doc_id"] == twice["__twice"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, kept["doc_id"] == twice["__twice"], "left_anti").unionByName(again)
