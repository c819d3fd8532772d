"""The pipeline: each stage on its predecessor's rows, against brute force or its operator's promise."""

import corpus_pipeline
from pyspark.sql import functions as F

from sparkrel.llm import queries
from sparkrel.llm.common import stored

from .test_lines import brute
from .test_simhash import roots, slow_print
from .test_tokens import library


def test_stages(spark, small):
    docs, seen = spark.read.parquet(f"{small}/documents.parquet"), []
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, small), f"test-{name}")
        seen.append((name, before.collect(), docs.collect()))
        assert name == "packing" or docs.columns == names
    (_, all_docs, good), (_, _, deduped), (_, lined, apart), (_, single, mixed), (_, packed_from, pieces) = seen
    assert 0.5 < len(good) / len(all_docs) < 1 and {r.doc_id for r in good} <= {r.doc_id for r in all_docs}
    # Lines: every line that stays, and no other, in order.
    want = brute([(r.doc_id, r.text) for r in good if r.doc_id % 4 == 0])
    part = spark.createDataFrame([r for r in good if r.doc_id % 4 == 0])
    for r in corpus_pipeline.line_stage(spark, part, small).collect():
        text = next(g.text for g in good if g.doc_id == r.doc_id)
        assert r.text == "\n".join(x for i, x in enumerate(text.split("\n")) if want.get((r.doc_id, i), (0, True))[1])
    assert len(deduped) == len(good) and sum(len(r.text) for r in deduped) < sum(len(r.text) for r in good)
    # Near-duplicates: the smallest id of each group.
    r = roots([slow_print(d.text) for d in lined])
    groups = {}
    for d, g in zip(lined, r, strict=True):
        groups[g] = min(groups.get(g, d.doc_id), d.doc_id)
    assert sorted(d.doc_id for d in apart) == sorted(groups.values())
    # Mixing: rows of the input, each three times at most.
    known = {d.doc_id: d for d in single}
    times = {}
    for d in mixed:
        assert known[d.doc_id] == d
        times[d.doc_id] = times.get(d.doc_id, 0) + 1
    assert max(times.values()) <= 3
    # Packing: all ids of all rows.
    assert sum(p.length for p in pieces) == sum(len(library(d.text, 1)) // 4 for d in packed_from)
    assert {p.length.bit_count() for p in pieces} == {1}


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small)
    assert got.agg(F.sum("length")).first()[0] > 0 and got.select("sequence_id").distinct().count() == got.count()


def test_names():
    import __spark_entry__ as entry

    assert {*queries.queries(), "pipeline"} <= entry.queries().keys() and queries.oracle_sql().keys() <= entry.oracle_sql().keys()
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
