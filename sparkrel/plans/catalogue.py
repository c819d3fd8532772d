"""The registered queries of the engine and their SQL.

Each runs a statement of the dialect through the engine, over attached tables or over tables that it makes.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..database import Database
from ..errors import EngineError

TABLES = "region nation customer supplier part orders lineitem events".split()

FLAGSHIP = """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty FROM lineitem
WHERE l_quantity < 25 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""

#: name: (statement, its SQL where that differs).
READS: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, None),
    "seq_scan": ("SELECT * FROM supplier", None),
    "project_cols": ("SELECT o_orderkey, o_orderstatus FROM orders", None),
    "project_expr": ("SELECT o_orderkey, o_totalprice * 2 AS x FROM orders", None),
    "project_star_mixed": ("SELECT *, r_regionkey + 1 AS next_key FROM region", "SELECT *, CAST(r_regionkey + 1 AS BIGINT) AS next_key FROM region"),
    "project_literals": ("SELECT s_suppkey, 1 AS i, 1.5 AS f, 'it''s' AS t, TRUE AS b FROM supplier", "SELECT s_suppkey, CAST(1 AS BIGINT) AS i, CAST(1.5 AS DOUBLE) AS f, 'it''s' AS t, TRUE AS b FROM supplier"),
    "alias": ("SELECT c_name AS customer_name FROM customer", None),
    "qualified": ("SELECT orders.o_orderkey, orders.o_custkey FROM orders WHERE orders.o_totalprice > 100000", None),
    "filter_eq": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_ne": ("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'", None),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 10", None),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 10", None),
    "filter_gt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 40", None),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 40", None),
    "filter_and": ("SELECT p_partkey FROM part WHERE p_size > 10 AND p_size < 20", None),
    "filter_or": ("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45", None),
    "filter_not": ("SELECT p_partkey FROM part WHERE NOT p_size < 25", None),
    "filter_paren": ("SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT (p_retailprice > 1000)", None),
    "filter_precedence": ("SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45 AND p_retailprice > 1000", None),
    "filter_truth": ("SELECT n_name FROM nation WHERE n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey <> 0"),
    "range_pushdown": ("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 200", None),
    "range_open": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 14000", None),
    "range_empty": ("SELECT o_orderkey FROM orders WHERE o_orderkey > 200 AND o_orderkey < 100", None),
    "lookup_eq": ("SELECT * FROM orders WHERE o_orderkey = 77", None),
    "flip_operand": ("SELECT p_partkey FROM part WHERE 45 < p_size", None),
    "text_cmp": ("SELECT c_custkey FROM customer WHERE c_mktsegment > 'B'", None),
    "bool_literal": ("SELECT r_name FROM region WHERE TRUE", None),
    "int_float_cmp": ("SELECT p_partkey FROM part WHERE p_size > 24.5", None),
    "timestamp_cmp": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= '1996-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'"),
    "mixed_types_unknown": ("SELECT r_name FROM region WHERE r_name = 1", "SELECT r_name FROM region WHERE FALSE"),
    "arith_add": ("SELECT p_partkey, p_size + 1 AS x FROM part", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS x FROM part"),
    "arith_sub": ("SELECT p_partkey, p_size - 1 AS x FROM part", "SELECT p_partkey, CAST(p_size - 1 AS BIGINT) AS x FROM part"),
    "arith_mul": ("SELECT p_partkey, p_size * p_size AS x FROM part", "SELECT p_partkey, CAST(p_size * p_size AS BIGINT) AS x FROM part"),
    "arith_div": ("SELECT p_partkey, p_size / 2 AS h FROM part", None),
    "neg": ("SELECT p_partkey, -p_size AS x FROM part", "SELECT p_partkey, CAST(-p_size AS BIGINT) AS x FROM part"),
    "precedence": ("SELECT p_partkey, 1 + p_size * 2 - -3 AS x FROM part", "SELECT p_partkey, CAST(1 + p_size * 2 + 3 AS BIGINT) AS x FROM part"),
    "count_star": ("SELECT COUNT(*) AS n FROM lineitem", None),
    "count_col": ("SELECT COUNT(l_shipdate) AS n FROM lineitem", None),
    "sum_int": ("SELECT SUM(p_size) AS s FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS s FROM part"),
    "sum_float": ("SELECT SUM(l_quantity) AS s FROM lineitem", None),
    "avg": ("SELECT AVG(p_size) AS a FROM part", None),
    "agg_expr": ("SELECT SUM(p_size * 2) AS s FROM part", "SELECT CAST(SUM(p_size * 2) AS BIGINT) AS s FROM part"),
    "agg_inside": ("SELECT SUM(p_size) + COUNT(*) AS s FROM part", "SELECT CAST(SUM(p_size) + COUNT(*) AS BIGINT) AS s FROM part"),
    "agg_filtered": ("SELECT COUNT(*) AS n, AVG(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R'", None),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(p_size) AS s, AVG(p_size) AS a FROM part WHERE p_size > 1000", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s, AVG(p_size) AS a FROM part WHERE p_size > 1000"),
    "group_one": ("SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", None),
    "group_many": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, AVG(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_noagg": ("SELECT o_orderstatus FROM orders GROUP BY o_orderstatus", None),
    "group_empty": ("SELECT event_type, COUNT(*) AS n FROM events WHERE user_id < 0 GROUP BY event_type", None),
    "group_alias": ("SELECT o_orderpriority AS p, COUNT(*) AS orders_n FROM orders GROUP BY o_orderpriority ORDER BY p", None),
    "group_where": ("SELECT n_regionkey, COUNT(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey", None),
    "order_asc": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25", None),
    "order_desc": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25", None),
    "order_multi": ("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 40", None),
    "order_expr": ("SELECT c_custkey FROM customer ORDER BY 0 - c_custkey LIMIT 10", None),
    "order_hidden_col": ("SELECT c_name FROM customer ORDER BY c_custkey DESC LIMIT 15", None),
    "order_literal": ("SELECT o_orderkey FROM orders ORDER BY 1, o_orderkey DESC LIMIT 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5"),
    "order_by_agg": ("SELECT p_size, COUNT(*) AS n FROM part GROUP BY p_size ORDER BY COUNT(*) DESC, p_size LIMIT 10", None),
    "limit": ("SELECT event_id FROM events ORDER BY event_id LIMIT 7", None),
    "offset": ("SELECT s_suppkey FROM supplier ORDER BY s_suppkey OFFSET 5", None),
    "limit_offset": ("SELECT event_id FROM events ORDER BY event_id LIMIT 7 OFFSET 11", None),
    "limit_zero": ("SELECT event_id FROM events LIMIT 0", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "distinct_one": ("SELECT DISTINCT event_type FROM events", None),
    "distinct_many": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "distinct_order": ("SELECT DISTINCT p_size FROM part ORDER BY p_size DESC LIMIT 5", None),
    "distinct_hidden_order": ("SELECT DISTINCT o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 2", "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus ORDER BY min(o_orderkey) LIMIT 2"),
}

_NULLS = "CREATE TABLE t (id INT PRIMARY KEY, a INT, b TEXT, c BOOL); INSERT INTO t VALUES (1, 10, 'x', TRUE); INSERT INTO t VALUES (2, NULL, 'y', FALSE); INSERT INTO t VALUES (3, 30, NULL, NULL); INSERT INTO t VALUES (4, NULL, NULL, TRUE)"
_NULLS_SQL = "WITH t(id, a, b, c) AS (SELECT CAST(id AS BIGINT), CAST(a AS BIGINT), b, c FROM (VALUES (1, 10, 'x', TRUE), (2, NULL, 'y', FALSE), (3, 30, NULL, NULL), (4, NULL, NULL, TRUE)) v(id, a, b, c)) "
_TYPES = """CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(20), c CHAR(3), d DATE, tm TIME, ts TIMESTAMP, p DECIMAL(10, 2), n SMALLINT, f FLOAT, x DOUBLE, b BOOLEAN)
INSERT INTO t VALUES (1, 'hello', 'ab', '2025-01-15', '13:45:30', '2025-01-15T13:45:30Z', '12.50', 7, 1.5, 2, TRUE)
INSERT INTO t VALUES (2, 'world', 'abc', '2024-02-29', '00:00', '2024-02-29T23:00:00+02:00', '9.00', -7, 0.25, 3.5, FALSE)"""
_TYPES_SQL = """WITH t(id, v, c, d, tm, ts, p, n, f, x, b) AS (SELECT CAST(1 AS BIGINT), 'hello', 'ab ', DATE '2025-01-15', 49530, TIMESTAMP '2025-01-15 13:45:30', CAST('12.50' AS DECIMAL(10, 2)), CAST(7 AS SMALLINT), CAST(1.5 AS DOUBLE), CAST(2 AS DOUBLE), TRUE
UNION ALL SELECT CAST(2 AS BIGINT), 'world', 'abc', DATE '2024-02-29', 0, TIMESTAMP '2024-02-29 21:00:00', CAST('9.00' AS DECIMAL(10, 2)), CAST(-7 AS SMALLINT), CAST(0.25 AS DOUBLE), CAST(3.5 AS DOUBLE), FALSE) """

#: name: (statements before, statement, SQL).
WRITES: dict[str, tuple[str, str, str]] = {
    "null_eq": (_NULLS, "SELECT id FROM t WHERE a = NULL", _NULLS_SQL + "SELECT id FROM t WHERE FALSE"),
    "null_arith": (_NULLS, "SELECT id, a + 1 AS x, a / 4 AS y FROM t", _NULLS_SQL + "SELECT id, a + 1 AS x, a / 4 AS y FROM t"),
    "null_and_or": (_NULLS, "SELECT id, c AND a > 5 AS x, c OR a > 5 AS y FROM t", _NULLS_SQL + "SELECT id, c AND a > 5 AS x, c OR a > 5 AS y FROM t"),
    "null_not": (_NULLS, "SELECT id FROM t WHERE NOT c", _NULLS_SQL + "SELECT id FROM t WHERE NOT c"),
    "null_where": (_NULLS, "SELECT id FROM t WHERE b <> 'x'", _NULLS_SQL + "SELECT id FROM t WHERE b <> 'x'"),
    "null_aggregates": (_NULLS, "SELECT COUNT(*) AS n, COUNT(a) AS k, SUM(a) AS s, AVG(a) AS m FROM t", _NULLS_SQL + "SELECT COUNT(*) AS n, COUNT(a) AS k, CAST(SUM(a) AS BIGINT) AS s, AVG(a) AS m FROM t"),
    "group_null": (_NULLS, "SELECT a, COUNT(*) AS n FROM t GROUP BY a", _NULLS_SQL + "SELECT a, COUNT(*) AS n FROM t GROUP BY a"),
    "group_first_row": (_NULLS, "SELECT c, id AS first_id, COUNT(*) AS n FROM t GROUP BY c", _NULLS_SQL + "SELECT c, min(id) AS first_id, COUNT(*) AS n FROM t GROUP BY c"),
    "nulls_asc": (_NULLS, "SELECT id FROM t ORDER BY a, id LIMIT 2", _NULLS_SQL + "SELECT id FROM t ORDER BY a ASC NULLS LAST, id LIMIT 2"),
    "nulls_desc": (_NULLS, "SELECT id FROM t ORDER BY a DESC, id LIMIT 2", _NULLS_SQL + "SELECT id FROM t ORDER BY a DESC NULLS FIRST, id LIMIT 2"),
    "insertion_order": (_NULLS, "SELECT id FROM t LIMIT 2", _NULLS_SQL + "SELECT id FROM t ORDER BY id LIMIT 2"),
    "insert_cols": (_NULLS + "; INSERT INTO t (b, id) VALUES ('new', 9)", "SELECT * FROM t WHERE id = 9", "SELECT CAST(9 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS a, 'new' AS b, CAST(NULL AS BOOLEAN) AS c"),
    "update_where": (_NULLS + "; UPDATE t SET b = 'z' WHERE a > 5", "SELECT id, b FROM t", _NULLS_SQL + "SELECT id, CASE WHEN a > 5 THEN 'z' ELSE b END AS b FROM t"),
    "update_expr": (_NULLS + "; UPDATE t SET id = id + 1, a = a * 2 - id", "SELECT id, a FROM t", _NULLS_SQL + "SELECT id + 1 AS id, a * 2 - id AS a FROM t"),
    "delete_where": (_NULLS + "; DELETE FROM t WHERE a < 20", "SELECT id FROM t", _NULLS_SQL + "SELECT id FROM t WHERE NOT coalesce(a < 20, FALSE)"),
    "txn_commit": (_NULLS + "; BEGIN; DELETE FROM t WHERE id = 1; INSERT INTO t (id) VALUES (8); COMMIT", "SELECT id FROM t", _NULLS_SQL + "SELECT id FROM t WHERE id > 1 UNION ALL SELECT CAST(8 AS BIGINT)"),
    "txn_rollback": (_NULLS + "; BEGIN; DELETE FROM t; INSERT INTO t (id) VALUES (8); DROP TABLE t; ROLLBACK", "SELECT id FROM t", _NULLS_SQL + "SELECT id FROM t"),
    "sum_exact": ("CREATE TABLE t (v INT); INSERT INTO t VALUES (9007199254740993); INSERT INTO t VALUES (1)", "SELECT SUM(v) AS s FROM t", "SELECT CAST(9007199254740994 AS BIGINT) AS s"),
    "type_roundtrip": (_TYPES, "SELECT * FROM t", _TYPES_SQL + "SELECT * FROM t"),
    "type_filter": (_TYPES, "SELECT id FROM t WHERE d > '2024-12-31' AND p > '10.00' AND c = 'ab' AND ts < '2025-02-01' AND tm > '12:00' AND n = 7", _TYPES_SQL + "SELECT id FROM t WHERE d > '2024-12-31' AND p > 10 AND n = 7"),
}

WRITES |= {
    "not_null": (_NULLS + "\nFAIL INSERT INTO t (a) VALUES (5)\nCREATE TABLE u (v INT NOT NULL)\nFAIL INSERT INTO u VALUES (NULL)\nINSERT INTO u VALUES (3)", "SELECT v FROM u", "SELECT CAST(3 AS BIGINT) AS v"),
    "unique": (_NULLS + "\nFAIL INSERT INTO t (id) VALUES (2)\nCREATE TABLE u (v INT UNIQUE)\nINSERT INTO u VALUES (3)\nINSERT INTO u VALUES (NULL)\nINSERT INTO u VALUES (NULL)\nFAIL INSERT INTO u VALUES (3)", "SELECT v FROM u", "SELECT CAST(v AS BIGINT) AS v FROM (VALUES (3), (NULL), (NULL)) x(v)"),
    "update_constraints": (_NULLS + "\nFAIL UPDATE t SET id = 7\nFAIL UPDATE t SET id = NULL WHERE a = 10\nUPDATE t SET id = 7 WHERE a = 10", "SELECT id FROM t", _NULLS_SQL + "SELECT CASE WHEN a = 10 THEN 7 ELSE id END AS id FROM t"),
    "txn_own_writes": (_NULLS + "\nBEGIN\nINSERT INTO t (id, a) VALUES (5, 50)\nUPDATE t SET a = a + 1 WHERE id = 5\nDELETE FROM t WHERE a = 51\nINSERT INTO t (id, a) VALUES (5, 52)", "SELECT id, a FROM t", _NULLS_SQL + "SELECT id, a FROM t UNION ALL SELECT CAST(5 AS BIGINT), CAST(52 AS BIGINT)"),
    "txn_failed_statement": (_NULLS + "\nBEGIN\nINSERT INTO t (id) VALUES (5)\nFAIL INSERT INTO t (id) VALUES (5)\nINSERT INTO t (id) VALUES (6)\nCOMMIT\nREOPEN", "SELECT id FROM t", _NULLS_SQL + "SELECT id FROM t UNION ALL SELECT CAST(5 AS BIGINT) UNION ALL SELECT CAST(6 AS BIGINT)"),
    "txn_close": (_NULLS + "\nBEGIN\nDELETE FROM t WHERE id > 1\nINSERT INTO t (id) VALUES (9)\nREOPEN", "SELECT id FROM t", _NULLS_SQL + "SELECT id FROM t"),
    "txn_recreate": ("CREATE TABLE t (id INT PRIMARY KEY)\nINSERT INTO t VALUES (1)\nBEGIN\nDROP TABLE t\nCREATE TABLE t (id INT PRIMARY KEY)\nINSERT INTO t VALUES (1)\nINSERT INTO t VALUES (2)\nCOMMIT\nREOPEN", "SELECT id FROM t", "SELECT CAST(id AS BIGINT) AS id FROM (VALUES (1), (2)) x(id)"),
    "reopen": (_TYPES + "\nREOPEN\nDELETE FROM t WHERE id = 1\nREOPEN", "SELECT * FROM t", _TYPES_SQL + "SELECT * FROM t WHERE id = 2"),
    "decimal_number": (_TYPES, "SELECT id, p FROM t WHERE p > '9' AND p + 1 > '13.4' AND p * 2 < '25.001'", _TYPES_SQL + "SELECT id, p FROM t WHERE p > 9 AND p + 1 > 13.4 AND p * 2 < 25.001"),
}

_ORDERS = "CREATE TABLE orders (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT NOT NULL, o_orderstatus CHAR(1), o_totalprice DOUBLE, o_orderpriority VARCHAR(20))\nLOAD\n"
_ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"

#: The same over a table that holds the whole of ``orders``.
WHOLE: dict[str, tuple[str, str, str]] = {
    "load": ("REOPEN", "SELECT * FROM orders", _ORDERS_SQL),
    "update_whole": ("UPDATE orders SET o_orderstatus = 'X', o_custkey = o_custkey + 1 WHERE o_orderpriority = '1-URGENT'\nREOPEN", "SELECT * FROM orders", "SELECT o_orderkey, o_custkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderpriority FROM orders"),
    "delete_whole": ("DELETE FROM orders WHERE o_totalprice < 100000", "SELECT o_orderkey FROM orders", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 100000, FALSE)"),
    "txn_whole": ("BEGIN\nDELETE FROM orders WHERE o_orderstatus = 'F'\nINSERT INTO orders VALUES (-1, 5, 'N', 1.5, NULL)\nCOMMIT\nREOPEN\nBEGIN\nDELETE FROM orders\nROLLBACK", "SELECT o_orderkey, o_custkey FROM orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT CAST(-1 AS BIGINT), CAST(5 AS BIGINT)"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(FLAGSHIP)(spark, sf_dir)


def _read(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark=spark)
        db.attach_parquet(sf_dir, [t for t in TABLES if f"FROM {t}" in sql])
        return db.query(sql)

    return run


def _base(spark: SparkSession) -> str:
    """The shared folder; where none is set (tests, one machine) a temporary one becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparkrel-')}")
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def _write(before: str, sql: str, loads: tuple[str, ...] = ()) -> Callable[[SparkSession, str], DataFrame]:
    """Statements over a store, then a SELECT.  REOPEN closes the store and opens it again, LOAD fills the tables
    of *loads* from the files of the same name, and a line that starts with FAIL must end in an error of the engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_base(spark)}/store-{uuid.uuid4().hex}"
        db = Database(path, spark)
        try:
            for part in before.split("\n"):
                if part == "REOPEN":
                    db.close()
                    db = Database(path, spark)
                elif part == "LOAD":
                    for name in loads:
                        db.load(name, spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*[c.name for c in db.columns(name)]))
                elif part.startswith("FAIL "):
                    with contextlib.suppress(EngineError):
                        db.execute(part.removeprefix("FAIL "))
                        raise AssertionError(f"no error: {part}")
                else:
                    db.execute(part)
            return db.query(sql)
        finally:
            db.close()

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    whole = {k: _write(_ORDERS + a, b, ("orders",)) for k, (a, b, _) in WHOLE.items()}
    return {k: _read(sql) for k, (sql, _) in READS.items()} | {k: _write(a, b) for k, (a, b, _) in WRITES.items()} | whole


def oracle_sql() -> dict[str, str]:
    return {k: sql if other is None else other for k, (sql, other) in READS.items()} | {k: c for k, (_, _, c) in (WRITES | WHOLE).items()}
