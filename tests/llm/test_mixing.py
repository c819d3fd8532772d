"""Mixtures: targets, draws, the splitting tree, and whole mixtures."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkrel.llm import mixing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    levels = {round(t / w, 6) for t, s, w in zip(got, sizes, weights, strict=True) if t < 3 * s - 1e-6}
    assert len(levels) <= 1 and all(3 * s / w <= max(levels) + 1e-3 for t, s, w in zip(got, sizes, weights, strict=True) if levels and t >= 3 * s - 1e-6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=60), st.floats(0, 3))
def test_draws(sizes, ratio):
    target = ratio * sum(sizes)
    got = mixing.draws(sizes, target)
    assert len(set(got)) == len(got) and all(0 <= e < 3 for _, e in got)
    assert abs(sum(sizes[i] for i, _ in got) - target) <= max(sizes) / 2 + 1e-6


def test_split_is_exact_and_even():
    quotas = np.array([1000, 10, 0, 3333])
    got = mixing.split(quotas, 7, 3)
    assert (got.sum(axis=0) == quotas).all() and (got >= 0).all()
    assert got.sum(axis=1).max() - got.sum(axis=1).min() <= 3
    assert (got == mixing.split(quotas, 7, 3)).all() and (got != mixing.split(quotas, 7, 4)).any()
    # In expectation each shard has the mixture of the whole.
    many = np.mean([mixing.split(quotas, 4, s)[0] for s in range(300)], axis=0)
    assert np.allclose(many, quotas / 4, rtol=0.05, atol=0.6)
    assert mixing.split(np.array([0]), 3, 0).tolist() == [[0], [0], [0]]


def sized(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_query_follows_the_contract(spark, small):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = mixing.op10_mixing(spark, small).collect()
    assert {r.doc_id for r in got} == rows.keys() and len(got) == len(rows)
    sources = sorted({r.source for r in rows.values()}, key=lambda s: (s is None, s.encode() if s else b""))
    totals = {s: sum(sized(r.text) for r in rows.values() if r.source == s) for s in sources}
    want = dict(zip(sources, mixing.targets([totals[s] for s in sources], [1 + i % 3 for i in range(len(sources))]), strict=True))
    taken = dict.fromkeys(sources, 0)
    for r in got:
        own = rows[r.doc_id]
        assert (r.size, r.source_size) == (sized(own.text), totals[own.source]) and r.target == pytest.approx(want[own.source])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[own.source] += r.taken
    for s in sources:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + max(sized(r.text) for r in rows.values() if r.source == s) / 2
    again = {r.doc_id: r.taken for r in mixing.op10_mixing(spark, small).repartition(3).collect()}
    assert again == {r.doc_id: r.taken for r in got}


ROWS = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (4, "x " * 50_000, "big"), (5, "one two", "S"), (6, "one two", "S"), (6, "one two", "S"), (None, "no id", "s"), *[(10 + i, f"w{i} v", "hot") for i in range(300)]]


def test_odd_tables_and_the_mixture_itself(spark):
    df = spark.createDataFrame([(*r, 7, "d") for r in ROWS], "doc_id long, text string, source string, size int, draws string")
    planned = mixing.plan(df, shards=4, blocks=16)
    assert planned.columns == [*df.columns, "size_", "source_size", "target", "draws_"] and planned.count() == len(ROWS)
    assert {(r.source, r.source_size) for r in planned.collect()} == {(None, 3), ("s", 2), ("big", 50_000), ("S", 6), ("hot", 600)}
    mixed = mixing.mix(df, shards=4, blocks=16)
    assert mixed.columns == df.columns
    drawn = sorted((repr(tuple(r)) for r in mixed.collect()))
    want = sorted(repr((*[r[c] for c in df.columns],)) for r in planned.collect() for _ in r["draws_"])
    assert drawn == want == sorted(repr(tuple(r)) for r in mixing.mix(df.repartition(5), shards=4, blocks=16).collect())
    for empty in (mixing.plan(df.limit(0)), mixing.mix(df.limit(0))):
        assert empty.count() == 0


def test_shards_get_disjoint_draws(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9 + 1), f"s{i % 5}") for i in range(500)], "doc_id long, text string, source string")
    seen = [(r.doc_id, d.epoch) for r in mixing.plan(df, shards=8, blocks=32).collect() for d in r.draws]
    assert len(seen) == len(set(seen))
    shards = {d.shard for r in mixing.plan(df, shards=8, blocks=32).collect() for d in r.draws}
    assert shards == set(range(8))


def test_rows_without_an_id_come_near_their_target(spark):
    rows = [(None, " ".join(["w"] * (1 + i % 5)) + f" n{i}", "a") for i in range(200)] + [(7, f"b{i} c d", "b") for i in range(400)] + [(i, "x y z", "c") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df, blocks=64).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * len(r.draws) for r in own) - own[0].target) <= 12


def test_shards_are_those_of_the_tree(spark, small):
    rows = mixing.op10_mixing(spark, small).collect()
    assert all(r.taken == r["size"] * len(r.shards) for r in rows)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    dealt = mixing.mix(docs).select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.doc_id, r.p) for r in dealt) == sorted((r.doc_id, s) for r in rows for s in r.shards)
    # By hand: the tree's shares of each source's block draws, in the order of a fresh permutation for each epoch.
    draws = mixing.plan(docs).select("source", F.xxhash64("doc_id", "text", F.lit(0)).alias("h"), F.explode("draws").alias("d")).select("source", F.pmod("h", F.lit(512)).alias("b"), "d.*").distinct().collect()
    sources = sorted({r.source for r in draws}, key=lambda s: (s is None, (s or "").encode()))
    per = np.array([sum(r.source == s for r in draws) for s in sources])
    want = mixing.split(per, mixing.SHARDS, 0)
    assert [[sum(r.source == s and r.shard == i for r in draws) for s in sources] for i in range(mixing.SHARDS)] == want.tolist()


def test_clashing_names(spark):
    names = ["__block", "block", "of_source", "of_block", "draw", "__draw", "target", "k", "b"]
    df = spark.createDataFrame([(i, f"w{i} v", "s", *range(len(names))) for i in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    assert mixing.mix(df, shards=2).columns == df.columns and set(df.columns) <= set(mixing.plan(df, shards=2).columns)
    assert all(tuple(r)[3:] == tuple(range(len(names))) for r in mixing.mix(df, shards=2).collect())
