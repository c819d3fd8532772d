"""SimHash groups against brute force on all pairs."""

import re

import numpy as np
import xxhash

from sparkrel.llm import simhash
from sparkrel.llm.components import components


def slow_print(text, width=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints):
    up = list(range(len(prints)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                a_, b_ = find(i), find(j)
                up[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(prints))]


TEXTS = [None, "", " \t\n", "one", "One", "two words", "  nbsp is no space", "A b C d", "a B c D", "É a b", "é a b", "x " * 5000, "same text here", "same text here"]


def test_fingerprints(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r.fingerprint % 2**64 for r in simhash.fingerprints(df).collect()}
    assert got == {i: slow_print(t) for i, t in enumerate(TEXTS)}


def linked(spark, prints):
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    pairs = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(p) for p in prints]


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    rng = np.random.default_rng(0)
    prints = {0, (1 << 64) - 1}
    for _ in range(40):
        center = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        for _ in range(12):
            p = center
            for b in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                p ^= 1 << int(b)
            prints.add(p)
    center = int(rng.integers(0, 1 << 63))
    for _ in range(500):  # a dense ball
        p = center
        for b in rng.choice(20, 3, replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    want = roots(prints)
    assert same(want, linked(spark, prints))


def test_large_keys_take_another_way():
    rng = np.random.default_rng(1)
    key = int(rng.integers(0, 1 << 63)) & ~((1 << 21) - 1)
    prints = set()
    for _ in range(900):
        p = key ^ (1 << int(rng.integers(21, 64)) if rng.random() < 0.7 else 0)
        for b in rng.choice(21, int(rng.integers(0, 9)), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = np.array(sorted(prints), np.uint64)
    found = []
    for most in (4096, 10):
        simhash.DIRECT, kept = most, simhash.DIRECT
        try:
            found.append(simhash.spanning(prints, key, 0))
        finally:
            simhash.DIRECT = kept
    parts = []
    for pairs in found:
        up = list(range(len(prints)))
        for i, j in pairs:
            assert int(prints[i] ^ prints[j]).bit_count() <= 3
            a, b = i, j
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[a] = b
        def root(i):
            while up[i] != i:
                i = up[i]
            return i
        parts.append([root(i) for i in range(len(prints))])
    assert same(*parts) and same(parts[0], roots([int(p) for p in prints]))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(-5, 7), (-5, -5), (None, 3)] + [(5000, i) for i in range(5001, 5400)]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_dedup(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "same text here"), (None, "lonely text without id"), (40, "only twice"), (40, "only twice")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, root int, first int")
    r = roots([slow_print(t) for _, t in rows])
    want = []
    for i, (doc, t) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if r[j] == r[i] and rows[j][0] is not None]
        want.append((doc, slow_print(t), min(ids, default=None)))
    got = [(x.doc_id, x.fingerprint % 2**64, x.component_id) for x in simhash.groups(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id for x in kept.collect() if x.doc_id is not None)) == sorted({c for d, _, c in want if d is not None})
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.dedup(df.limit(0)).count() == 0


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = [slow_print(t) for _, t in rows]
    r = roots(prints)
    want = {d: (f"{p:016x}", min(rows[j][0] for j in range(len(rows)) if r[j] == r[i])) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))}
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.op9_simhash(spark, small).collect()} == want


def test_an_id_with_texts_in_two_groups(spark):
    a, b = "first text of words that are quite its own", "another passage which has nothing at all in common"
    rows = [(5, a), (9, a), (5, b), (2, b), (7, "a lonely third one over here"), (5, a), (None, a)]
    kept = simhash.dedup(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int"))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, a), (2, b), (7, "a lonely third one over here"), (None, a)], key=repr)


def test_a_key_that_two_blocks_share(spark, monkeypatch):
    monkeypatch.setattr(simhash, "DIRECT", 10)
    rng = np.random.default_rng(7)
    base, prints = int(rng.integers(0, 1 << 62)), set()
    # Two families that meet in one key value: what either has outside of its own masked block is the same.
    for low, high in ((0, 21), (21, 42)):
        kept = base & ~((1 << high) - (1 << low)) & (1 << 64) - 1
        kept &= ~((1 << 42) - 1)
        for _ in range(150):
            prints.add(kept | int(rng.integers(0, 1 << 21)) << low)
        for _ in range(40):
            prints.add(kept | (int(rng.integers(0, 1 << 21)) & 0b111111) << low)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint long")
    for r in simhash.links(df).collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3
    assert same(roots(prints), linked(spark, prints))


def test_dedup_keeps_clashing_names(spark):
    names = ["__gone", "__mixed", "__twice", "c0", "fingerprint", "root", "component_id"]
    rows = [(1, "one two three four"), (2, "one two three four"), (3, "something else altogether here"), (None, None)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = simhash.dedup(df)
    assert got.columns == df.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]
