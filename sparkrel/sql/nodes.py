"""What a statement is parsed into."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """kind: int, float, text, bool or null."""

    kind: str
    value: object


@dataclass(frozen=True)
class Name:
    column: str


@dataclass(frozen=True)
class Star:
    pass


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    """COUNT, SUM or AVG."""

    function: str
    arg: object


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    params: tuple[int, ...] = ()
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    values: tuple


@dataclass(frozen=True)
class Update:
    table: str
    assignments: tuple[tuple[str, object], ...]
    where: object = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Select:
    items: tuple  # (expression, alias or None)
    table: str
    distinct: bool = False
    where: object = None
    group_by: tuple[str, ...] = ()
    order_by: tuple = ()  # (expression, descending)
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class Transaction:
    """BEGIN, COMMIT or ROLLBACK."""

    action: str
    extra: dict = field(default_factory=dict, compare=False)


def walk(node):
    """The node and all expressions below it."""
    yield node
    for x in ("arg", "left", "right"):
        if (below := getattr(node, x, None)) is not None:
            yield from walk(below)
