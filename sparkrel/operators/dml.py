"""INSERT, UPDATE and DELETE: all checks come before any change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintError, EngineError, StorageError
from ..functions.types import Kind, coerce, kind_of, stored
from ..plans.bind import NULL, ROW, Scope, Typed, truth
from ..sources.store import Store, Table
from ..sql import nodes as n


def required(c: n.ColumnDef) -> bool:
    return c.not_null or c.primary_key


def single(c: n.ColumnDef) -> bool:
    return c.unique or c.primary_key


def scope(t: Table) -> Scope:
    return Scope({c: Typed(F.col(f"`{c}`"), k) for c, k in t.kinds.items()})


def insert(store: Store, stmt: n.Insert) -> int:
    t = store.table(stmt.table)
    kinds = t.kinds
    names = list(stmt.columns) if stmt.columns is not None else list(kinds)
    for c in names:
        if c not in kinds:
            raise StorageError(f"no such column: {c}")
    if len(set(names)) != len(names):
        raise ConstraintError("a column is named twice")
    if len(names) != len(stmt.values):
        raise ConstraintError(f"{len(names)} columns but {len(stmt.values)} values")
    given = {c: _value(store, node, kinds[c]) for c, node in zip(names, stmt.values, strict=True)}
    row = tuple(given.get(c) for c in kinds)
    for c, v in zip(t.columns, row, strict=True):
        if v is None and required(c):
            raise ConstraintError(f"{c.name} must not be NULL")
    for i, c in enumerate(t.columns):
        if single(c) and row[i] is not None and _present(store, t, i, c, row[i]):
            raise ConstraintError(f"{c.name} = {row[i]!r} is there already")
    store.append(t, row)
    return 1


def _value(store: Store, node, kind: Kind):
    if isinstance(node, n.Literal):
        return coerce(node.value, kind)
    if isinstance(node, n.Unary) and node.op == "-" and isinstance(node.arg, n.Literal) and node.arg.kind in ("int", "float"):
        return coerce(-node.arg.value, kind)
    bound = Scope({}).bind(node)
    return coerce(store.spark.range(1).select(bound.column.alias("v")).first()[0], kind)


def _present(store: Store, t: Table, i: int, c: n.ColumnDef, value) -> bool:
    if any(r[i + 1] == value for r in t.rows):
        return True
    if not t.snapshots:
        return False
    rest = t.clone()
    rest.rows = []
    # The filter reaches the files, whose statistics skip row groups.
    return not store.scan(rest).where(F.col(f"`{c.name}`") == F.lit(value).cast(Kind(c.type, c.params).spark)).isEmpty()


def _hit(t: Table, where) -> Column:
    return F.coalesce(truth(scope(t).bind(where)), F.lit(False)) if where is not None else F.lit(True)


def update(store: Store, stmt: n.Update) -> int:
    t = store.table(stmt.table)
    kinds, own = t.kinds, scope(t)
    new: dict[str, Column] = {}
    for c, node in stmt.assignments:
        if c not in kinds:
            raise StorageError(f"no such column: {c}")
        if isinstance(node, n.Literal):
            value = coerce(node.value, kinds[c])
            new[c] = F.lit(value).cast(kinds[c].spark)
        else:
            bound = own.bind(node)
            if bound.value and bound.kind is not NULL:
                new[c] = F.lit(coerce(bound.value[0], kinds[c])).cast(kinds[c].spark)
            else:
                new[c] = stored(bound.column, bound.kind, kinds[c])
    rows, hit = store.scan(t), _hit(t, stmt.where)
    count = rows.where(hit).count()
    if not count:
        return 0
    after = rows.select(ROW, *[(F.when(hit, new[c]).otherwise(F.col(f"`{c}`")) if c in new else F.col(f"`{c}`")).alias(c) for c in kinds])
    # Written once; the checks read what is written, which no table names before they pass.
    folder, total = store.stage(after), t.count
    _check(t, store.staged(t, folder), set(new))
    store.become(t, folder, total)
    return count


def _check(t: Table, after: DataFrame, changed: set[str]) -> None:
    """NOT NULL and uniqueness of the changed columns, on the rows as they will be."""
    for c in t.columns:
        if c.name not in changed:
            continue
        column = F.col(f"`{c.name}`")
        if required(c) and not after.where(column.isNull()).isEmpty():
            raise ConstraintError(f"{c.name} must not be NULL")
        if single(c) and not after.where(column.isNotNull()).groupBy(column).count().where("count > 1").isEmpty():
            raise ConstraintError(f"{c.name} would not be unique")


def load(store: Store, name: str, frame: DataFrame) -> int:
    """Add a DataFrame's rows to a table in one step; its columns are named as the table's, in any order.

    The rows are written once, checked as written, and only then become part of the table.
    """
    t = store.table(name)
    if sorted(frame.columns) != sorted(t.kinds):
        raise ConstraintError(f"columns differ from {name}'s")
    cells = [stored(F.col(f"`{c}`"), kind_of(frame.schema[c].dataType), k).alias(c) for c, k in t.kinds.items()]
    folder = store.stage(frame.select((F.monotonically_increasing_id() + t.next_row).alias(ROW), *cells))
    new = store.staged(t, folder)
    for c in t.columns:
        column = F.col(f"`{c.name}`")
        if required(c) and not new.where(column.isNull()).isEmpty():
            raise ConstraintError(f"{c.name} must not be NULL")
        if single(c):
            both = new.select(column).unionAll(store.scan(t).select(column)).where(column.isNotNull())
            if not both.groupBy(column).count().where("count > 1").isEmpty():
                raise ConstraintError(f"{c.name} would not be unique")
    before = t.count
    store.extend(t, folder)
    return t.count - before


def delete(store: Store, stmt: n.Delete) -> int:
    t = store.table(stmt.table)
    rows, hit = store.scan(t), _hit(t, stmt.where)
    count = rows.where(hit).count()
    if count:
        store.become(t, store.stage(rows.where(~hit)), t.count - count)
    return count


def run(store: Store, stmt) -> int:
    """Rows affected."""
    if isinstance(stmt, n.CreateTable):
        for c in stmt.columns:
            if c.type not in ("VARCHAR", "CHAR", "DECIMAL"):
                continue
            Kind(c.type, c.params).spark  # noqa: B018  a DECIMAL beyond 38 digits is an error
        store.create(stmt.name, list(stmt.columns))
        return 0
    if isinstance(stmt, n.DropTable):
        store.drop(stmt.name)
        return 0
    for kind, do in ((n.Insert, insert), (n.Update, update), (n.Delete, delete)):
        if isinstance(stmt, kind):
            return do(store, stmt)
    raise EngineError("no such statement")
