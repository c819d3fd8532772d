"""Line dedup against brute force on all pairs."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkrel.llm import lines


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rng, text, n):
    for _ in range(n):
        text = text or "z"
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "z", text[i] + "q"]) + text[i + rng.choice([0, 1]) :]
    return text


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_distance(spark, limit):
    rng = random.Random(limit)
    base = ["", "a", "kitten", "x" * 40, "".join(rng.choices("abc", k=70)), "é日本" * 20]
    pairs = [(a, mutate(rng, a, n) if a else "b" * n) for a in base for n in range(5) for _ in range(6)] + [(a, b) for a in base for b in base]
    df = spark.createDataFrame(pairs, "x string, y string").withColumn("near", lines.within("x", "y", limit))
    for r in df.collect():
        assert r.near == (edits(r.x, r.y) <= limit), (r.x, r.y)


def linked(a, b):
    return max(len(a), len(b)) >= 15 and abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2


def brute(rows):
    """(doc_id, line_no) to (links, stays) by comparing all lines."""
    at = {}
    for doc, text in rows:
        for i, x in enumerate((text or "").split("\n")):
            x = re.sub(" +", " ", x.replace("\r", " ").replace("\t", " ")).strip(" ").lower()
            if x:
                at.setdefault(x, set()).add((doc is None, doc or 0, i))
    texts = list(at)
    up, links = {t: t for t in texts}, dict.fromkeys(texts, 0)

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if linked(a, b):
                links[a] += 1
                links[b] += 1
                up[find(a)] = find(b)
    firsts = {}
    for t in texts:
        firsts[find(t)] = min(firsts.get(find(t), (2,)), min(at[t]))
    return {(None if p[0] else p[1], p[2]): (links[t], p == firsts[find(t)]) for t in texts for p in at[t]}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, line string")
    got = lines.memberships(df).collect()
    assert {(r.doc_id, r.line_no): (r.links, r.stays) for r in got} == brute(rows)
    return df


def test_odd_documents(spark):
    s = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"{s}\n\n  short\n{s.upper()} "), (2, f"short\r\n{s}!\n{s[:20]}X{s[21:]}"), (3, None), (4, ""), (5, "\n\n"), (6, f"{s} and more than two"), (None, s), (7, "tail é" * 10), (8, "tail e" * 1 + "tail é" * 9), (9, "w " * 30_000), (10, "w " * 30_000)]
    df = check(spark, rows)
    kept = lines.dedup(df)
    out = {r.doc_id: r.text for r in kept.collect()}
    assert out[1] == f"{s}\n\n  short" and out[2] == "" and out[3] is None and out[4] == "" and out[5] == "\n\n" and out[None] == "" and out[10] == "" and out[9] == "w " * 30_000
    assert kept.columns == df.columns
    assert lines.memberships(df.limit(0)).count() == 0 and lines.dedup(df.limit(0)).count() == 0


def test_hot_and_similar_lines(spark):
    rng = random.Random(5)
    base = "".join(rng.choices("abcdefgh ", k=60)).strip()
    rows = [(i, f"every document has this very line in it\n{mutate(rng, base, rng.choice([0, 1, 2, 3, 9]))}") for i in range(150)]
    check(spark, rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line that is long enough to count"), (1, "a line that is long enough to count"), (2, "a line that is long enough to count")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup(df).collect()) == ["", "a line that is long enough to count", "a line that is long enough to count"]


def test_query_has_every_line(spark, small):
    want = duckdb.sql(f"SELECT count(*), count(DISTINCT l) FROM (SELECT lower(trim(replace(replace(unnest(string_split(text, chr(10))), chr(13), ' '), chr(9), ' '))) l FROM '{small}/documents.parquet') WHERE l <> ''").fetchall()[0]
    got = lines.op4_lines(spark, small)
    assert tuple(got.agg(F.count("*"), F.countDistinct("line_id")).first()) == want


@pytest.mark.parametrize("dense", [24])
def test_crowded_keys_are_divided(spark, monkeypatch, dense):
    monkeypatch.setattr(lines, "DENSE", dense)
    rng = random.Random(dense)
    rows = [(i, f"record number {rng.randrange(10**5):08d} of the long list") for i in range(120)]
    rows += [(200 + i, "".join(rng.choices("ab", k=rng.randrange(13, 18)))) for i in range(60)]
    check(spark, rows)


def test_lines_that_differ_in_digits_make_few_pairs(spark):
    rng = random.Random(3)
    numbers = rng.sample(range(10**8), 5000)
    df = spark.createDataFrame([(i, f"record number {n:08d} of the list of all records that there are") for i, n in enumerate(numbers)], "doc_id long, text string")
    rows, classes, collided = lines._indexed(df)
    pairs = lines._pairs(lines._candidates(df, rows, collided)).count()
    text = [f"{n:08d}" for n in numbers]
    near = 0
    for i in range(8):  # two substitutions leave six digits equal, so keys of six digits find all of them
        for j in range(i):
            seen = {}
            for t in text:
                seen.setdefault(t[:j] + t[j + 1 : i] + t[i + 1 :], []).append(t)
            near += sum(len(x) > 1 for x in seen.values())
    assert near > 50 and pairs < 60 * len(numbers)  # of 12.5 million


def test_different_lines_with_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lines, "identity", lambda line: F.pmod(F.xxhash64(line), F.lit(5)))
    rows = [(i, f"{'abcdefghijklmnop'[i]} line of its own {i * 7919}\nthe same line in all of them\nthe same line in all of tham") for i in range(12)]
    check(spark, rows)


def test_clashing_names_and_null_ids(spark):
    names = ["row", "of", "gone", "lines", "of_id", "key", "id", "check", "line", "keys", "first", "line_no", "stays"]
    rows = [(None, "a line that all have\nthe first of its own"), (None, "a line that all have\nsecond"), (4, "a line that all have"), (4, "another one"), (None, None)]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = lines.dedup(df)
    assert out.columns == df.columns
    # Of equal lines in documents without an id only one stays; two texts under one id are two documents.
    assert sorted(str(r.text) for r in out.collect()) == ["None", "a line that all have", "another one", "second", "the first of its own"]
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())


def test_query_against_brute_force(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500").select("doc_id", "text").collect()[:60]
    rows = [tuple(r) for r in rows] + [(10_000 + i, r.text.replace("the", "teh", 1)) for i, r in enumerate(rows[:20])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.line_no): (r.links, r.stays) for r in lines.op4_lines(spark, str(tmp_path)).collect()}
    assert got == brute(rows) and any(n for n, _ in got.values())


def test_short_lines_within_two_edits_are_linked(spark):
    texts = ["are, is anwh reenen.", "are is anwh reenen.", "then the erbles", "then the erble", "then the erb", "a line of 29 characters, here", "a line of 29 characters, heres!", "page 12", "page 13"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.links for r in lines.memberships(df).collect()}
    long = lambda a, b: max(len(a), len(b)) >= 15 and edits(a, b) <= 2
    assert got == {i: sum(long(a, b) for b in texts if a != b) for i, a in enumerate(texts)} and got == dict(enumerate([1, 1, 1, 1, 0, 1, 1, 0, 0]))
