"""Statements end to end: types, constraints, updates, transactions, reopening, errors."""

import os

import pytest
from pyspark.sql import functions as F

from sparkrel import ConstraintError, Database, EngineError, ParseError, StorageError, TransactionError, TypeMismatchError
from sparkrel.sql import nodes as n
from sparkrel.sql.lexer import complete, statements, tokenize
from sparkrel.sql.parse import parse


def rows(db, sql):
    return db.execute(sql).rows


# ---------------------------------------------------------------- front end


def test_tokens_have_places():
    t = tokenize("SELECT a -- note\n  FROM 'it''s'")
    assert [(x.kind, x.value, x.line, x.col) for x in t] == [("key", "SELECT", 1, 1), ("name", "a", 1, 8), ("key", "FROM", 2, 3), ("text", "it's", 2, 8), ("end", "", 2, 15)]


@pytest.mark.parametrize("text, kind", [("1", "int"), ("1.5", "float"), ("1.", "float"), (".5", "float"), ("1e5", "float"), ("'x'", "text")])
def test_literals(text, kind):
    (s,) = parse(f"SELECT {text} FROM t")
    assert s.items[0][0].kind == kind


def test_precedence():
    (s,) = parse("SELECT a FROM t WHERE NOT a = 1 + 2 * -3 OR b AND c")
    assert s.where == n.Binary("OR", n.Unary("NOT", n.Binary("=", n.Name("a"), n.Binary("+", n.Literal("int", 1), n.Binary("*", n.Literal("int", 2), n.Unary("-", n.Literal("int", 3)))))), n.Binary("AND", n.Name("b"), n.Name("c")))


@pytest.mark.parametrize(
    "sql",
    ["SELECT 1", "SELECT a b FROM t", "SELECT a FROM t OFFSET 1 LIMIT 2", "SELECT a FROM t WHERE a = b = c", "SELECT a FROM t WHERE a != 1", "SELECT a FROM t JOIN u", "SELECT a FROM t HAVING a", "SELECT MAX(a) FROM t", "SELECT SUM(*) FROM t", "SELECT a FROM t WHERE a IN (1)", "SELECT a FROM t WHERE a IS NULL", "SELECT a FROM t UNION SELECT a FROM t", ";;", "INSERT INTO t VALUES (1), (2)", "CREATE TABLE t (a BLOB)", "CREATE TABLE t (a INT, a INT)", "CREATE INDEX i ON t", "CHECKPOINT", "SELECT a FROM t LIMIT -1", "SELECT 'open FROM t", "SELECT date FROM t", "SELECT a FROM t WHERE a % 2", "WITH x AS (SELECT a FROM t) SELECT a FROM x"],
)
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_reserved_word_is_named():
    with pytest.raises(ParseError, match="reserved.*rename") as e:
        parse("CREATE TABLE t (order INT)")
    assert (e.value.line, e.value.col) == (1, 17)


def test_statement_ends():
    assert statements("a 'x;y'; b -- c;\n; d") == ["a 'x;y'", " b -- c;\n", " d"]
    assert complete("SELECT ';';") and not complete("SELECT ';'") and complete("x; -- end")


# ---------------------------------------------------------------- types


GOOD = [
    ("INT", "9007199254740993", "9007199254740993"), ("FLOAT", "1", "1"), ("FLOAT", "1.25", "1.25"), ("DOUBLE", "-0.5", "-0.5"), ("TEXT", "'你好'", "你好"), ("BOOL", "TRUE", "TRUE"), ("BOOLEAN", "FALSE", "FALSE"),
    ("VARCHAR(3)", "'你'", "你"), ("CHAR(3)", "'a'", "a  "), ("DATE", "'2024-02-29'", "2024-02-29"), ("TIME", "'13:45'", "13:45:00"), ("TIMESTAMP", "'2025-01-15'", "2025-01-15T00:00:00+00:00"), ("TIMESTAMP", "'2025-01-15T01:00:00.9+02:00'", "2025-01-14T23:00:00+00:00"),
    ("DECIMAL(4, 2)", "'12.50'", "12.50"), ("DECIMAL(4, 2)", "'+.50'", "0.50"), ("SMALLINT", "-32768", "-32768"), ("BIGINT", "9223372036854775807", "9223372036854775807"), ("INT(5)", "7", "7"), ("INT", "NULL", ""),
]
BAD = [
    ("INT", "1.5"), ("INT", "TRUE"), ("INT", "'1'"), ("FLOAT", "'1'"), ("TEXT", "1"), ("BOOL", "1"), ("VARCHAR(3)", "'你好'"), ("VARCHAR", "'a'"), ("CHAR(2)", "'abc'"), ("DATE", "'yesterday'"), ("DATE", "'2025-1-5'"), ("DATE", "'2025-02-30'"),
    ("TIME", "'25:00'"), ("TIMESTAMP", "'soon'"), ("DECIMAL(4, 2)", "12.5"), ("DECIMAL(4, 2)", "'12.5'"), ("DECIMAL(4, 2)", "'123.45'"), ("DECIMAL(4, 2)", "'01.00'"), ("DECIMAL(4, 2)", "'-0.00'"), ("SMALLINT", "32768"), ("BIGINT", "9223372036854775808"), ("INT", "9223372036854775808"),
]


def test_types_take_and_render(db):
    db.execute(f"CREATE TABLE t ({', '.join(f'c{i} {t}' for i, (t, _, _) in enumerate(GOOD))})")
    db.execute(f"INSERT INTO t VALUES ({', '.join(v for _, v, _ in GOOD)})")
    assert rows(db, "SELECT * FROM t") == [[out for _, _, out in GOOD]]
    db.compact()
    assert rows(db, "SELECT * FROM t") == [[out for _, _, out in GOOD]]


def test_types_reject(db):
    db.execute(f"CREATE TABLE t ({', '.join(f'c{i} {t}' for i, (t, _) in enumerate(BAD))})")
    for i, (_, v) in enumerate(BAD):
        with pytest.raises(TypeMismatchError):
            db.execute(f"INSERT INTO t (c{i}) VALUES ({v})")
    assert rows(db, "SELECT COUNT(*) FROM t") == [["0"]]


def test_filters_on_every_type(db):
    db.execute("CREATE TABLE t (id INT, v VARCHAR(9), c CHAR(4), d DATE, ts TIMESTAMP, p DECIMAL(6, 2), s SMALLINT, b BIGINT)")
    db.execute("INSERT INTO t VALUES (1, 'x', 'ab', '2025-01-01', '2025-01-01T10:00:00', '9.00', 1, 2); INSERT INTO t VALUES (2, 'y', 'b', '2025-06-01', '2025-06-01T10:00:00', '10.00', 3, 4)")
    for where, want in [("v = 'x'", "1"), ("c = 'ab'", "1"), ("d < '2025-03-01'", "1"), ("ts > '2025-03-01'", "2"), ("p > '9.50'", "2"), ("'9.50' > p", "1"), ("s + b > 6", "2"), ("p < 9.5", "1")]:
        assert rows(db, f"SELECT id FROM t WHERE {where}") == [[want]], where
    assert rows(db, "SELECT id FROM t WHERE d = 'never'") == []
    assert rows(db, "SELECT SUM(p), SUM(s), AVG(b) FROM t") == [["19.00", "4", "3"]]
    assert rows(db, "SELECT id FROM t ORDER BY p DESC") == [["2"], ["1"]]
    with pytest.raises(TypeMismatchError):
        db.execute("SELECT id + v FROM t")


# ---------------------------------------------------------------- changes


def test_constraints(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT NOT NULL, mail TEXT UNIQUE)")
    db.execute("INSERT INTO t VALUES (1, 'a', 'm'); INSERT INTO t (id, name) VALUES (2, 'b'); INSERT INTO t (id, name) VALUES (3, 'c')")
    for bad in ["(1, 'x', 'n')", "(9, NULL, 'n')", "(NULL, 'x', 'n')", "(9, 'x', 'm')", "(9, 'x')"]:
        with pytest.raises(ConstraintError):
            db.execute(f"INSERT INTO t VALUES {bad}")
    db.compact()
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (1, 'x', 'n')")
    with pytest.raises(StorageError):
        db.execute("INSERT INTO t (id, nope) VALUES (9, 1)")
    with pytest.raises(ConstraintError):
        db.execute("CREATE TABLE t (a INT)")
    with pytest.raises(ConstraintError):
        db.execute("CREATE TABLE u (a INT PRIMARY KEY, b INT PRIMARY KEY)")
    with pytest.raises(StorageError):
        db.execute("DROP TABLE nope")
    assert rows(db, "SELECT COUNT(*) FROM t") == [["3"]]


def test_update(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, txt TEXT NOT NULL, n INT)")
    for i in (1, 2, 3):
        db.execute(f"INSERT INTO t VALUES ({i}, 'a long text', {i * 10})")
    assert db.execute("UPDATE t SET txt = 's' WHERE n > 10").rows_affected == 2
    assert db.execute("UPDATE t SET id = id + 1, n = id").rows_affected == 3  # ends unique, from the old row
    assert rows(db, "SELECT * FROM t") == [["2", "a long text", "1"], ["3", "s", "2"], ["4", "s", "3"]]
    for bad in ["id = 5", "txt = NULL"]:
        with pytest.raises(ConstraintError):
            db.execute(f"UPDATE t SET {bad}")
    with pytest.raises(StorageError):
        db.execute("UPDATE t SET nope = 1")
    with pytest.raises(TypeMismatchError):
        db.execute("UPDATE t SET n = 'x'")
    assert db.execute("UPDATE t SET n = 0 WHERE id = 99").rows_affected == 0
    assert db.execute("DELETE FROM t WHERE n = NULL").rows_affected == 0
    assert db.execute("DELETE FROM t WHERE n <= 2").rows_affected == 2
    assert rows(db, "SELECT id FROM t") == [["4"]]


def test_update_checks_the_type(db):
    db.execute("CREATE TABLE t (s SMALLINT, v VARCHAR(2), w TEXT, c CHAR(3), n INT); INSERT INTO t VALUES (1, 'a', 'long', 'x', 40000)")
    for bad in ["v = w", "s = n"]:
        with pytest.raises(TypeMismatchError):
            db.execute(f"UPDATE t SET {bad}")
    db.execute("UPDATE t SET c = v")
    assert rows(db, "SELECT c FROM t") == [["a  "]]


def test_transactions(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1)")
    db.execute("BEGIN; INSERT INTO t VALUES (2); UPDATE t SET id = id + 10; CREATE TABLE u (a INT); INSERT INTO u VALUES (5)")
    assert rows(db, "SELECT id FROM t") == [["11"], ["12"]]
    with pytest.raises(TransactionError):
        db.begin()
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t VALUES (11)")
    db.rollback()
    assert rows(db, "SELECT id FROM t") == [["1"]] and db.tables() == ["t"]
    db.execute("BEGIN; INSERT INTO t VALUES (2); CREATE TABLE u (a INT); INSERT INTO u VALUES (5); COMMIT")
    for stray in (db.commit, db.rollback):
        with pytest.raises(TransactionError):
            stray()
    assert rows(db, "SELECT id FROM t") == [["1"], ["2"]] and rows(db, "SELECT a FROM u") == [["5"]]


def test_reopen(spark, tmp_path):
    path = str(tmp_path / "s")
    with Database(path, spark) as db:
        db.execute("CREATE TABLE t (id INT PRIMARY KEY, d DATE, p DECIMAL(5, 2)); INSERT INTO t VALUES (1, '2025-01-01', '1.50')")
        db.execute("BEGIN; INSERT INTO t VALUES (2, NULL, NULL); COMMIT; INSERT INTO t VALUES (3, NULL, NULL)")
        with pytest.raises(TransactionError):
            Database(path, spark)
        db.execute("BEGIN; INSERT INTO t VALUES (4, NULL, NULL)")
    with pytest.raises(EngineError, match="closed"):
        db.execute("SELECT id FROM t")
    # A crash: a torn line in a log, a snapshot that no manifest names.
    with Database(path, spark) as db:
        live = db.store.tables["t"].live
        os.makedirs(f"{path}/data/rows-stray")
        with open(f"{path}/data/{live}", "a") as f:
            f.write("[9, 9")
    with Database(path, spark) as db:
        assert rows(db, "SELECT * FROM t") == [["1", "2025-01-01", "1.50"], ["2", "", ""], ["3", "", ""]]
        assert not os.path.exists(f"{path}/data/rows-stray")
        db.execute("INSERT INTO t VALUES (8, NULL, NULL)")  # not onto the torn line
        db.close()
    with Database(path, spark) as db:
        db.execute("DELETE FROM t WHERE id = 8")
        db.execute("DELETE FROM t WHERE id = 2; INSERT INTO t VALUES (7, NULL, NULL)")
    with Database(path, spark) as db:
        assert rows(db, "SELECT id FROM t") == [["1"], ["3"], ["7"]]
        db.close()
        db.close()


def test_future_version_is_refused(spark, tmp_path):
    path = tmp_path / "s"
    Database(str(path), spark).close()
    manifest = path / (path / "CURRENT").read_text()
    manifest.write_text(manifest.read_text().replace('"version": 1', '"version": 99'))
    with pytest.raises(StorageError):
        Database(str(path), spark)


def test_load(spark, db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, c CHAR(3) NOT NULL, s SMALLINT); INSERT INTO t VALUES (1, 'a', 1)")
    frame = spark.range(10, 500).selectExpr("'b' AS c", "id", "cast(id AS int) AS s")
    assert db.load("t", frame) == 490
    db.execute("INSERT INTO t VALUES (2, 'z', NULL)")
    assert rows(db, "SELECT COUNT(*), SUM(s) FROM t") == [["492", str(1 + sum(range(10, 500)))]]
    assert rows(db, "SELECT id, c FROM t LIMIT 2") == [["1", "a  "], ["10", "b  "]] and rows(db, "SELECT id FROM t OFFSET 491") == [["2"]]
    for bad, error in [("id - 9 AS id, 'b' AS c, 1 AS s", ConstraintError), ("id + 1000 AS id, NULLIF('b', 'b') AS c, 1 AS s", ConstraintError), ("1000 AS id, 'b' AS c, 1 AS s", ConstraintError), ("id + 1000 AS id, 'long' AS c, 1 AS s", TypeMismatchError), ("id + 1000 AS id, 'b' AS c, 99999 AS s", TypeMismatchError), ("id", ConstraintError)]:
        with pytest.raises(error):
            db.load("t", spark.range(10, 20).selectExpr(*bad.split(", ") if "NULLIF" not in bad else ["id + 1000 AS id", "NULLIF('b', 'b') AS c", "1 AS s"]))
    assert rows(db, "SELECT COUNT(*) FROM t") == [["492"]]
    db.begin()
    db.load("t", spark.range(1000, 1005).selectExpr("id", "'q' AS c", "NULL AS s").withColumn("s", F.col("s").cast("int")))
    db.rollback()
    assert rows(db, "SELECT COUNT(*) FROM t") == [["492"]]


# ---------------------------------------------------------------- queries


def test_output_names_and_duplicates(db):
    db.execute("CREATE TABLE t (a INT, b INT); INSERT INTO t VALUES (1, 2)")
    r = db.execute("SELECT a, a, a + b, -a, 5, COUNT(*), SUM(b), AVG(a + b) FROM t GROUP BY a, b")
    assert r.columns == ["a", "a", "BinaryOp", "UnaryOp", "Literal", "COUNT(*)", "SUM(b)", "AVG(BinaryOp)"]
    assert r.rows == [["1", "1", "3", "-1", "5", "1", "2", "3"]]
    assert db.execute("SELECT a FROM t WHERE FALSE").columns == ["a"]
    assert db.execute("").columns == [] and len(db.executemany("SELECT a FROM t; SELECT b FROM t;")) == 2


def test_groups(db):
    db.execute("CREATE TABLE t (g TEXT, v INT)")
    assert rows(db, "SELECT COUNT(*), SUM(v), AVG(v) FROM t") == [["0", "", ""]] and rows(db, "SELECT g, COUNT(*) FROM t GROUP BY g") == []
    for g, v in [("'b'", 1), ("NULL", 2), ("'a'", "NULL"), ("NULL", 4), ("'b'", 6)]:
        db.execute(f"INSERT INTO t VALUES ({g}, {v})")
    assert rows(db, "SELECT g, COUNT(*), COUNT(v), SUM(v) FROM t GROUP BY g") == [["b", "2", "2", "7"], ["", "2", "2", "6"], ["a", "1", "0", ""]]
    assert rows(db, "SELECT g, SUM(v) + 1 AS s FROM t GROUP BY g ORDER BY SUM(v) DESC") == [["a", ""], ["b", "8"], ["", "7"]]
    assert rows(db, "SELECT g FROM t GROUP BY g ORDER BY g DESC") == [[""], ["b"], ["a"]]
    with pytest.raises(EngineError):
        db.execute("SELECT g FROM t WHERE COUNT(*) > 1")
    with pytest.raises(StorageError):
        db.execute("SELECT nope FROM t")
    with pytest.raises(EngineError, match="zero"):
        db.execute("SELECT v / 0 FROM t")
    with pytest.raises(EngineError, match="range"):
        db.execute("SELECT v * 9223372036854775807 FROM t")


def test_attached(spark, small):
    db = Database(spark=spark)
    db.attach_parquet(small, ["nation", "embeddings"])
    assert db.execute("SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1").rows
    assert db.table("nation").count() == 25
    assert "PushedFilters: [IsNotNull(n_nationkey), GreaterThan(n_nationkey,3)]" in db.explain("SELECT n_name FROM nation WHERE n_nationkey > 3")
    assert len(db.execute("SELECT * FROM embeddings LIMIT 2").rows) == 2
    for bad, error in [("INSERT INTO nation VALUES (1)", StorageError), ("CREATE TABLE x (a INT)", StorageError), ("SELECT embedding + 1 FROM embeddings", TypeMismatchError)]:
        with pytest.raises(error):
            db.execute(bad)


def test_store_given_by_uri(spark, tmp_path, monkeypatch):
    from sparkrel.sources import files, store

    monkeypatch.setattr(store, "opened", files.Remote)
    path = f"file://{tmp_path}/s"
    with Database(path, spark) as db:
        db.execute("CREATE TABLE t (id INT PRIMARY KEY, b TEXT); INSERT INTO t VALUES (1, 'x'); INSERT INTO t VALUES (2, 'y')")
        db.execute("BEGIN; INSERT INTO t VALUES (3, 'z'); COMMIT; INSERT INTO t VALUES (4, NULL); UPDATE t SET b = 'w' WHERE id = 2; INSERT INTO t VALUES (5, 'v')")
        with pytest.raises(TransactionError):
            Database(path, spark)
    with Database(path, spark) as db:
        assert rows(db, "SELECT * FROM t") == [["1", "x"], ["2", "w"], ["3", "z"], ["4", ""], ["5", "v"]]
        before = set(os.listdir(tmp_path / "s" / "data"))
        db.compact()
        assert not before & set(os.listdir(tmp_path / "s" / "data"))
        db.execute("INSERT INTO t VALUES (6, 'u')")
    with Database(path, spark) as db:
        assert rows(db, "SELECT id FROM t OFFSET 4") == [["5"], ["6"]]


def test_row_number_name(spark, db):
    with pytest.raises(ConstraintError):
        db.execute("CREATE TABLE t (__rowid INT)")
    db.attach("a", spark.sql("SELECT 3 AS `__rowid`, 4 AS v UNION ALL SELECT 1, 5"))
    assert sorted(rows(db, "SELECT * FROM a")) == [["1", "5"], ["3", "4"]]


def test_rows_one_by_one(db):
    db.execute("CREATE TABLE t (id INT); INSERT INTO t VALUES (2); INSERT INTO t VALUES (1)")
    assert list(db.iterate("SELECT id FROM t")) == [["2"], ["1"]]


def test_fold_within_a_transaction(spark, tmp_path, monkeypatch):
    from sparkrel.sources import store

    monkeypatch.setattr(store, "FOLD", 3)
    path = str(tmp_path / "s")
    with Database(path, spark) as db:
        db.execute("CREATE TABLE t (id INT); INSERT INTO t VALUES (1); BEGIN")
        for i in range(2, 9):
            db.execute(f"INSERT INTO t VALUES ({i})")
        assert len(db.store.tables["t"].rows) < 3
        db.execute("ROLLBACK")
        assert rows(db, "SELECT id FROM t") == [["1"]]
        db.execute("BEGIN")
        for i in range(2, 9):
            db.execute(f"INSERT INTO t VALUES ({i})")
        db.execute("COMMIT")
    with Database(path, spark) as db:
        assert rows(db, "SELECT id FROM t") == [[str(i)] for i in range(1, 9)]
