"""The command line, fed from text."""

import io
import subprocess
import sys

from sparkrel import cli, render
from sparkrel.database import ResultSet


def run(spark, path, text):
    out = io.StringIO()
    assert cli.repl(str(path), io.StringIO(text), out, spark) == 0
    return out.getvalue()


def test_session(spark, tmp_path):
    out = run(spark, tmp_path / "s", "CREATE TABLE t (id INT PRIMARY KEY,\n name TEXT NOT NULL);\n\nINSERT INTO t VALUES (1, 'a;b');\nSELECT id,\n name\nFROM t;\n.tables\n.schema t\n.schema nope\n.nope\n.help\nSELECT * FROM nope;\n.exit\nSELECT 1;\n")
    assert cli.PROMPT in out and cli.MORE in out
    assert "1 row affected" in out and "| 1  | a;b  |" in out and "(1 row)" in out
    assert "CREATE TABLE t (\n    id INT PRIMARY KEY,\n    name TEXT NOT NULL\n);" in out
    assert out.count("error: no such table: nope") == 2 and "unknown command" in out and ".quit" in out


def test_end_of_input_runs_what_is_held(spark, tmp_path):
    run(spark, tmp_path / "s", "CREATE TABLE t (a INT)")
    assert "t\n" in run(spark, tmp_path / "s", ".tables\n.quit\n")


def test_script_goes_on_after_errors(spark, tmp_path):
    out = io.StringIO()
    cli.script(str(tmp_path / "s"), "SELECT * FROM nope; CREATE TABLE t (a INT); INSERT INTO t VALUES (2); SELECT a FROM t; .tables; .exit; nonsense", out, spark)
    assert "error:" in out.getvalue() and "| 2 |" in out.getvalue() and out.getvalue().endswith("t\n")


def test_usage():
    p = subprocess.run([sys.executable, "-m", "sparkrel"], capture_output=True, text=True, timeout=120)
    assert p.returncode == 2 and "usage" in p.stderr


def test_grid():
    assert render.grid([], []) == "(empty result set)\n"
    assert render.grid(["a", "bb"], [["xyz", ""]]) == "+-----+----+\n| a   | bb |\n+-----+----+\n| xyz |    |\n+-----+----+\n(1 row)\n"
    assert render.result(ResultSet(rows_affected=5)) == "5 rows affected\n" and render.result(ResultSet()) == ""
