"""The engine's face: a store, attached tables, and statements."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, StorageError, TransactionError, TypeMismatchError
from .functions.types import Kind, kind_of, render
from .operators import dml
from .plans import bind
from .session import SETTINGS, get_session
from .sources.store import Store
from .sql import nodes as n
from .sql.parse import parse


@dataclass
class ResultSet:
    """Column names and rows of texts, or the number of rows affected; *df* is the result as a DataFrame."""

    columns: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    rows_affected: int = 0
    df: DataFrame | None = field(default=None, repr=False, compare=False)


@contextlib.contextmanager
def _translated():
    """Spark's errors as the engine's."""
    try:
        yield
    except PySparkException as e:
        text = str(e)
        if "TypeMismatch: " in text:
            raise TypeMismatchError(text.partition("TypeMismatch: ")[2].split("\n")[0].split(" SQLSTATE")[0]) from e
        what = "division by zero" if "DIVIDE_BY_ZERO" in text else "number out of range" if "OVERFLOW" in text or "NUMERIC_VALUE_OUT_OF_RANGE" in text else text.split("\n")[0]
        raise EngineError(what) from e


class Database:
    """A store under *path* (made if it is not there), or, without one, attached tables alone."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None, *, buffer_capacity: int | None = None) -> None:
        """*buffer_capacity* is accepted and not used: Spark and the system cache pages."""
        self.spark = spark or get_session()
        for k, v in SETTINGS.items():
            if self.spark.conf.get(k, None) != v:
                self.spark.conf.set(k, v)
        self.path, self.closed = path, False
        self.store = Store(path, self.spark) if path is not None else None
        self.attached: dict[str, DataFrame] = {}

    # ------------------------------------------------------------ life

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Roll an open transaction back and free the store; closing again does nothing."""
        if not self.closed and self.store:
            if self.store.active:
                self.store.rollback()
            self.store.close()
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise EngineError("database is closed")

    def _own(self) -> Store:
        if self.store is None:
            raise StorageError("this database has attached tables only")
        return self.store

    # ------------------------------------------------------------ tables

    def attach(self, name: str, frame: DataFrame) -> None:
        """Make a DataFrame readable as a table."""
        self._open()
        self.attached[name] = frame

    def attach_parquet(self, folder: str, names: list[str]) -> None:
        """Make ``folder/<name>.parquet`` readable as tables; no table is read until it is used."""
        for name in names:
            self.attach(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def tables(self) -> list[str]:
        """Names of the store's tables, in order."""
        self._open()
        return sorted(self.store.tables) if self.store else []

    def columns(self, name: str) -> list[n.ColumnDef]:
        self._open()
        return list(self._own().table(name).columns)

    def table(self, name: str) -> DataFrame:
        """A table as a DataFrame, for all of Spark's operations."""
        frame, columns = self._source(name)
        return frame.select(*[F.col(f"`{c}`") for c in columns])

    def _source(self, name: str) -> tuple[DataFrame, dict[str, Kind]]:
        self._open()
        if self.store and name in self.store.tables:
            t = self.store.tables[name]
            return self.store.scan(t), t.kinds
        if name in self.attached:
            frame = self.attached[name]
            return frame, {f.name: kind_of(f.dataType) for f in frame.schema.fields}
        raise StorageError(f"no such table: {name}")

    # ------------------------------------------------------------ statements

    def execute(self, sql: str) -> ResultSet:
        """Run the statements in *sql*; the last one's result."""
        return ([ResultSet()] + self.executemany(sql))[-1]

    def executemany(self, sql: str) -> list[ResultSet]:
        """Run the statements in *sql*; every result."""
        self._open()
        return [self._run(s) for s in parse(sql)]

    def query(self, sql: str) -> DataFrame:
        """The DataFrame of one SELECT; nothing is computed yet.  Rows come in an order only if the statement has one."""
        return self._one(sql, False).named()

    def iterate(self, sql: str) -> Iterator[list[str]]:
        """The rows of one SELECT as ``execute`` gives them, one partition in memory at a time."""
        plan = self._one(sql, True)
        with _translated():
            for r in plan.frame.toLocalIterator():
                yield [render(v, k) for v, k in zip(r, plan.kinds, strict=True)]

    def _one(self, sql: str, in_order: bool) -> bind.Plan:
        self._open()
        stmts = parse(sql)
        if len(stmts) != 1 or not isinstance(stmts[0], n.Select):
            raise EngineError("one SELECT is needed")
        return self._select(stmts[0], in_order)

    def explain(self, sql: str) -> str:
        """Spark's plan of one SELECT."""
        return self.query(sql)._jdf.queryExecution().toString()

    def begin(self) -> None:
        self._open()
        self._own().begin()

    def commit(self) -> None:
        self._open()
        self._own().commit()

    def rollback(self) -> None:
        self._open()
        self._own().rollback()

    def compact(self, name: str | None = None) -> None:
        """Fold a table's log (or every table's) into one sorted snapshot and remove what nothing refers to any more;
        not within a transaction.  Frames made before over the tables' older states end with it."""
        self._open()
        if self._own().active:
            raise TransactionError("a transaction is active")
        with _translated():
            for x in [name] if name else self.tables():
                self.store.compact(x)
            self.store.sweep()

    def load(self, name: str, frame: DataFrame) -> int:
        """Add all rows of a DataFrame to a table, with every check; the number of rows."""
        self._open()
        with _translated():
            return dml.load(self._own(), name, frame)

    def _select(self, stmt: n.Select, in_order: bool = True) -> bind.Plan:
        with _translated():
            return bind.select(stmt, *self._source(stmt.table), in_order)

    def _run(self, stmt) -> ResultSet:
        if isinstance(stmt, n.Select):
            plan = self._select(stmt)
            with _translated():
                rows = plan.frame.collect()
            return ResultSet(plan.names, [[render(v, k) for v, k in zip(r, plan.kinds, strict=True)] for r in rows], 0, plan.named())
        if isinstance(stmt, n.Transaction):
            {"BEGIN": self.begin, "COMMIT": self.commit, "ROLLBACK": self.rollback}[stmt.action]()
            return ResultSet()
        target = getattr(stmt, "table", None)
        if target in self.attached and not (self.store and target in self.store.tables):
            raise StorageError(f"{target} is attached and cannot be changed")
        with _translated():
            return ResultSet(rows_affected=dml.run(self._own(), stmt))
