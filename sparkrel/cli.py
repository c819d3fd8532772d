"""The command line: statements that may span lines, and commands that begin with a dot."""

from __future__ import annotations

import sys
from typing import TextIO

from . import render
from .database import Database
from .errors import EngineError
from .sql.lexer import complete, statements

PROMPT, MORE = "sparkrel> ", "      ... "
HELP = """Commands:
  .tables         list tables
  .schema <name>  show the CREATE TABLE of a table
  .help           this text
  .exit, .quit    leave
"""


def schema(db: Database, name: str) -> str:
    columns, marks = [], []
    for c in db.columns(name):
        params = f"({', '.join(map(str, c.params))})" if c.params else ""
        rules = [r for r, on in (("PRIMARY KEY", c.primary_key), ("NOT NULL", c.not_null), ("UNIQUE", c.unique)) if on]
        columns.append(" ".join([f"    {c.name} {c.type}{params}", *rules]))
        if c.primary_key or c.unique:
            marks.append(f"-- unique: {c.name}")
    return "\n".join([f"CREATE TABLE {name} (", ",\n".join(columns), ");", *marks]) + "\n"


def command(db: Database, text: str) -> tuple[bool, str]:
    """Whether to go on, and what to print."""
    name, _, rest = text.strip().partition(" ")
    name, rest = name.lower(), rest.strip()
    if name in (".exit", ".quit"):
        return False, ""
    if name == ".tables":
        return True, "".join(f"{t}\n" for t in db.tables()) or "(no tables)\n"
    if name == ".help":
        return True, HELP
    if name == ".schema":
        if not rest:
            return True, "usage: .schema <name>\n"
        try:
            return True, schema(db, rest)
        except EngineError as e:
            return True, f"error: {e}\n"
    return True, f"unknown command {name!r} (try .help)\n"


def statement(db: Database, sql: str) -> str:
    try:
        return render.result(db.execute(sql))
    except Exception as e:  # noqa: BLE001  the prompt outlives any statement
        return f"error: {e}\n"


def repl(path: str, source: TextIO | None = None, out: TextIO | None = None, spark=None) -> int:
    """Read statements until the end or ``.exit``."""
    source, out = source or sys.stdin, out or sys.stdout
    out.write(f"sparkrel: {path}\nType .help for commands, .exit to leave.\n")
    with Database(path, spark) as db:
        held = ""
        while True:
            out.write(MORE if held else PROMPT)
            out.flush()
            try:
                line = source.readline()
            except (EOFError, KeyboardInterrupt):
                out.write("\n")
                return 0
            if not line:
                if held.strip():
                    out.write(statement(db, held))
                return 0
            if not held and line.strip() in ("", ";"):
                continue
            if not held and line.lstrip().startswith("."):
                on, text = command(db, line)
                out.write(text)
                if not on:
                    return 0
                continue
            held += line
            if complete(held):
                out.write(statement(db, held))
                held = ""


def script(path: str, text: str, out: TextIO | None = None, spark=None) -> int:
    """Run a text of statements and commands; an error does not stop it."""
    out = out or sys.stdout
    with Database(path, spark) as db:
        for part in statements(text):
            part = part.strip()
            if part.startswith("."):
                on, said = command(db, part)
                out.write(said)
                if not on:
                    return 0
            elif part:
                out.write(statement(db, part))
    return 0


def main(args: list[str]) -> int:
    if len(args) != 1:
        sys.stderr.write("usage: python -m sparkrel <folder>\n")
        return 2
    return repl(args[0])
