"""From expressions to typed Spark columns, and from SELECT to a DataFrame.

Rules that differ from Spark's own: NULL is the largest in any order, integers are 64-bit and literals with a
point are doubles, comparison across types is unknown instead of an error, text literals take the type of the
column they meet, and any value can stand as a condition by its truth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ParseError, StorageError, TypeMismatchError
from ..functions.types import FROM_TEXT, INTEGERS, NUMBERS, TEXTS, Kind, coerce, number
from ..sql import nodes as n

BOOL, INT, FLOAT, TEXT, NULL = Kind("BOOL"), Kind("INT"), Kind("FLOAT"), Kind("TEXT"), Kind("NULL")
ROW = "__rowid"
_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}


@dataclass(frozen=True)
class Typed:
    """A column with its kind; *value* of a literal, in a one-element tuple."""

    column: Column
    kind: Kind
    value: tuple | None = None


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def literal(node: n.Literal) -> Typed:
    kind = {"int": INT, "float": FLOAT, "text": TEXT, "bool": BOOL, "null": NULL}[node.kind]
    if node.kind == "int" and not -(1 << 63) <= node.value < 1 << 63:
        raise TypeMismatchError(f"integer {node.value} is beyond 64 bits")
    column = F.lit(None) if kind is NULL else F.lit(node.value).cast(kind.spark)
    return Typed(column, kind, (node.value,))


class Scope:
    """Names to typed columns."""

    def __init__(self, columns: dict[str, Typed]) -> None:
        self.columns = columns

    def name(self, name: str) -> Typed:
        if name not in self.columns:
            raise StorageError(f"no such column: {name}")
        return self.columns[name]

    def call(self, node: n.Call) -> Typed:
        raise EngineError(f"{node.function} is not allowed here")

    def bind(self, node) -> Typed:
        if isinstance(node, n.Literal):
            return literal(node)
        if isinstance(node, n.Name):
            return self.name(node.column)
        if isinstance(node, n.Call):
            return self.call(node)
        if isinstance(node, n.Unary):
            return negated(self.bind(node.arg)) if node.op == "-" else Typed(~truth(self.bind(node.arg)), BOOL)
        if isinstance(node, n.Binary):
            left, right = self.bind(node.left), self.bind(node.right)
            if node.op in ("AND", "OR"):
                a, b = truth(left), truth(right)
                return Typed(a & b if node.op == "AND" else a | b, BOOL)
            return Typed(compare(node.op, left, right), BOOL) if node.op in _COMPARE else arithmetic(node.op, left, right)
        raise ParseError("* is not allowed here")


def truth(x: Typed) -> Column:
    """A condition from any value: numbers by <> 0, texts by <> ''."""
    name = x.kind.name
    if name == "BOOL":
        return x.column
    if name == "NULL":
        return unknown()
    if name in NUMBERS:
        return x.column != 0
    if name in TEXTS:
        return x.column != ""
    if name == "OTHER":
        raise TypeMismatchError("this column's type has no operators")
    return F.when(x.column.isNotNull(), F.lit(True))


def negated(x: Typed) -> Typed:
    if x.value and x.kind in (INT, FLOAT):
        return Typed(F.lit(-x.value[0]).cast(x.kind.spark), x.kind, (-x.value[0],))
    return arithmetic("-", literal(n.Literal("int", 0)), x)


def compare(op: str, left: Typed, right: Typed) -> Column:
    a, b = left.kind.name, right.kind.name
    if "OTHER" in (a, b):
        raise TypeMismatchError("this column's type has no operators")
    if "NULL" in (a, b):
        return unknown()
    if left.value and not right.value and left.kind is TEXT and b in FROM_TEXT:
        return compare(_FLIP.get(op, op), right, left)
    if right.value and right.kind is TEXT and a in FROM_TEXT and not (left.value and left.kind is TEXT):
        if a == "VARCHAR":
            return _COMPARE[op](left.column, right.column)
        if a == "CHAR":
            # Padded to the column's length; a longer text still has its place in the order.
            return _COMPARE[op](left.column, F.lit(right.value[0].ljust(left.kind.params[0] if left.kind.params else 0)))
        if a == "DECIMAL":
            # A number whatever its scale, for columns and for what is computed from them.
            value = number(right.value[0])
            if value is None:
                return unknown()
            wide = len(value.as_tuple().digits) > 38 or abs(value.as_tuple().exponent) > 38
            return _COMPARE[op](left.column.cast("double"), F.lit(float(value))) if wide else _COMPARE[op](left.column, F.lit(value))
        try:
            value = coerce(right.value[0], left.kind)
        except TypeMismatchError:
            return unknown()
        return _COMPARE[op](left.column, F.lit(value).cast(left.kind.spark))
    if a in NUMBERS and b in NUMBERS:
        if "FLOAT" in (a, b):
            return _COMPARE[op](left.column.cast("double"), right.column.cast("double"))
        return _COMPARE[op](left.column, right.column)
    if (a in TEXTS and b in TEXTS) or a == b:
        return _COMPARE[op](left.column, right.column)
    return unknown()


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    a, b = left.kind.name, right.kind.name
    for x in (a, b):
        if x not in (*NUMBERS, "NULL"):
            raise TypeMismatchError(f"{op} takes numbers, not {x}")
    whole = a in (*INTEGERS, "NULL") and b in (*INTEGERS, "NULL")
    exact = "FLOAT" not in (a, b) and op != "/"
    if "NULL" in (a, b):
        return Typed(F.lit(None).cast("bigint" if whole and op != "/" else "double"), INT if whole and op != "/" else FLOAT)
    if exact:
        x, y = (t.column.cast("bigint") if t.kind.name in INTEGERS else t.column for t in (left, right))
    else:
        x, y = left.column.cast("double"), right.column.cast("double")
    out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[op]()
    if not exact:
        return Typed(out, FLOAT)
    return Typed(out, INT if whole else Kind("DECIMAL"))


class Grouped(Scope):
    """Names and calls over groups: calls and other columns become aggregates on the way."""

    def __init__(self, base: Scope, keys: tuple[str, ...], ordered: bool) -> None:
        super().__init__(base.columns)
        self.base, self.keys, self.ordered, self.aggregates = base, keys, ordered, {}

    def _aggregate(self, what, column: Column, kind: Kind) -> Typed:
        if what not in self.aggregates:
            self.aggregates[what] = (f"__agg{len(self.aggregates)}", column)
        return Typed(F.col(self.aggregates[what][0]), kind)

    def name(self, name: str) -> Typed:
        found = self.base.name(name)
        if name in self.keys:
            return Typed(F.col(f"__key{self.keys.index(name)}"), found.kind)
        # Of other columns the group's first row counts.
        first = F.min_by(found.column, F.col(ROW)) if self.ordered else F.first(found.column)
        return self._aggregate(("first", name), first, found.kind)

    def call(self, node: n.Call) -> Typed:
        if isinstance(node.arg, n.Star):
            return self._aggregate(node, F.count(F.lit(1)), INT)
        if any(isinstance(x, n.Call) for x in n.walk(node.arg)):
            raise EngineError("aggregates do not nest")
        arg = self.base.bind(node.arg)
        if node.function == "COUNT":
            return self._aggregate(node, F.count(arg.column), INT)
        if arg.kind.name not in (*NUMBERS, "NULL"):
            raise TypeMismatchError(f"{node.function} takes numbers, not {arg.kind}")
        if arg.kind is NULL:
            return Typed(F.lit(None).cast("bigint" if node.function == "SUM" else "double"), INT if node.function == "SUM" else FLOAT)
        if node.function == "AVG":
            return self._aggregate(node, F.avg(arg.column.cast("double")), FLOAT)
        if arg.kind.name in INTEGERS:
            # Summed wide, so that only a total beyond 64 bits is an error.
            return self._aggregate(node, F.sum(arg.column.cast("decimal(38,0)")).cast("bigint"), INT)
        return self._aggregate(node, F.sum(arg.column), FLOAT if arg.kind is FLOAT or arg.kind.name == "FLOAT" else Kind("DECIMAL"))


def label(node) -> str:
    """The name of an output without alias."""
    if isinstance(node, n.Name):
        return node.column
    if isinstance(node, n.Call):
        inner = "*" if isinstance(node.arg, n.Star) else label(node.arg)
        return f"{node.function}({inner})"
    return {"Literal": "Literal", "Unary": "UnaryOp", "Binary": "BinaryOp"}[type(node).__name__]


@dataclass(frozen=True)
class Plan:
    """A bound SELECT: a DataFrame whose columns are in the order of *names* and *kinds*."""

    frame: DataFrame
    names: list[str]
    kinds: list[Kind]

    def named(self) -> DataFrame:
        return self.frame.toDF(*self.names)


def select(stmt: n.Select, frame: DataFrame, columns: dict[str, Kind], in_order: bool = True) -> Plan:
    """Scan, filter, group, project, distinct, sort, offset, limit.

    *frame* may have a row number (``__rowid``): rows without another order come in it, and it breaks ties.
    Without *in_order* a statement that neither sorts nor cuts leaves its rows as they come, unsorted.
    """
    base = Scope({c: Typed(F.col(f"`{c}`"), k) for c, k in columns.items()})
    numbered = ROW in frame.columns and ROW not in columns
    if stmt.where is not None:
        frame = frame.where(truth(base.bind(stmt.where)))
    items: list[tuple[object, str]] = []
    for node, alias in stmt.items:
        items += [(n.Name(c), c) for c in columns] if isinstance(node, n.Star) else [(node, alias or label(node))]
    grouped = bool(stmt.group_by) or any(isinstance(x, n.Call) for node, _ in items for x in n.walk(node)) or any(isinstance(x, n.Call) for node, _ in stmt.order_by for x in n.walk(node))
    if grouped and any(isinstance(node, n.Star) for node, _ in stmt.items) and not stmt.group_by:
        raise EngineError("* does not go with aggregates")
    scope: Scope = Grouped(base, stmt.group_by, numbered) if grouped else base
    outputs = [scope.bind(node) for node, _ in items]
    sort: list[tuple[Typed, bool]] = []
    aliases = {name: out for (_, name), out in reversed(list(zip(items, outputs, strict=True)))}
    for node, down in stmt.order_by:
        if isinstance(node, n.Name) and node.column in aliases and (grouped or node.column not in columns):
            key = aliases[node.column]
        else:
            key = scope.bind(node)
        if key.value is None and key.kind is not NULL:  # constants order nothing
            if key.kind.name == "OTHER":
                raise TypeMismatchError("this column's type has no order")
            sort.append((key, down))
    if grouped:
        keys = [F.col(f"`{c}`").alias(f"__key{i}") for i, c in enumerate(stmt.group_by) if base.name(c)]
        made = [column.alias(name) for name, column in scope.aggregates.values()]
        if numbered:
            made.append(F.min(ROW).alias(ROW))
        frame = frame.groupBy(*keys).agg(*made) if made else frame.select(*keys).distinct()
    width = len(outputs)
    hidden = [k.column.alias(f"s{i}") for i, (k, _) in enumerate(sort)]
    frame = frame.select(*[o.column.alias(f"c{i}") for i, o in enumerate(outputs)], *hidden, *([F.col(ROW)] if numbered else []))
    if stmt.distinct:
        best = [(F.max if down else F.min)(f"s{i}").alias(f"s{i}") for i, (_, down) in enumerate(sort)]
        best += [F.min(ROW).alias(ROW)] if numbered else []
        cells = [f"c{i}" for i in range(width)]
        frame = frame.groupBy(*cells).agg(*best) if best else frame.distinct()
    order = [F.col(f"s{i}").desc_nulls_first() if down else F.col(f"s{i}").asc_nulls_last() for i, (_, down) in enumerate(sort)]
    if numbered and (in_order or order or stmt.limit is not None or stmt.offset is not None):
        order.append(F.col(ROW).asc())
    if order:
        frame = frame.orderBy(*order)
    if stmt.offset is not None:
        frame = frame.offset(stmt.offset)
    if stmt.limit is not None:
        frame = frame.limit(stmt.limit)
    kinds = [Kind("TEXT") if o.kind is NULL else o.kind for o in outputs]
    return Plan(frame.select(*[F.col(f"c{i}").cast("string") if outputs[i].kind is NULL else F.col(f"c{i}") for i in range(width)]), [name for _, name in items], kinds)
