"""Declared types: Spark types, coercion of literals and columns, rendering."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError

INTEGERS, TEXTS = ("INT", "SMALLINT", "BIGINT"), ("TEXT", "VARCHAR", "CHAR")
NUMBERS = (*INTEGERS, "FLOAT", "DECIMAL")
#: Types whose text literals are read as values of the type.
FROM_TEXT = ("VARCHAR", "CHAR", "DATE", "TIME", "TIMESTAMP", "DECIMAL")


@dataclass(frozen=True)
class Kind:
    """A type as declared, or OTHER for what an attached table may hold."""

    name: str
    params: tuple[int, ...] = ()

    @property
    def spark(self) -> T.DataType:
        if self.name == "DECIMAL":
            p, s = self.params if len(self.params) == 2 else (38, 0)
            if not 0 < p <= 38 or not 0 <= s <= p:
                raise TypeMismatchError(f"DECIMAL({p},{s}) is out of range: at most 38 digits")
            return T.DecimalType(p, s)
        plain = {"INT": T.LongType, "BIGINT": T.LongType, "SMALLINT": T.ShortType, "FLOAT": T.DoubleType, "BOOL": T.BooleanType, "DATE": T.DateType, "TIME": T.IntegerType, "TIMESTAMP": T.TimestampNTZType}
        return plain.get(self.name, T.StringType)()

    def __str__(self) -> str:
        return self.name + (f"({', '.join(map(str, self.params))})" if self.params else "")


def kind_of(spark: T.DataType) -> Kind:
    """The kind of an attached column."""
    if isinstance(spark, T.DecimalType):
        return Kind("DECIMAL", (spark.precision, spark.scale))
    found = {T.ByteType: "INT", T.ShortType: "INT", T.IntegerType: "INT", T.LongType: "INT", T.FloatType: "FLOAT", T.DoubleType: "FLOAT", T.BooleanType: "BOOL", T.StringType: "TEXT", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP"}
    return Kind(found.get(type(spark), "OTHER"))


def decimal(text: str, precision: int, scale: int) -> Decimal | None:
    """The value of a decimal literal with exactly *scale* digits after the point; None if it is none."""
    m = re.fullmatch(r"([+-]?)(0?|[1-9][0-9]*)(?:\.([0-9]*))?", text, re.ASCII)
    if not m or len(m[3] or "") != scale or len(m[2].lstrip("0")) + scale > precision:
        return None
    if m[1] == "-" and not (m[2] + (m[3] or "")).strip("0"):
        return None
    return Decimal(f"{m[1]}{m[2] or '0'}.{m[3] or '0'}")


def number(text: str) -> Decimal | None:
    """The value of a plain decimal number of any length; None if *text* is none."""
    return Decimal(text) if re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", text, re.ASCII) else None


def coerce(value: object, kind: Kind) -> object:
    """*value* (of a literal or a computed cell) as stored in a column of *kind*."""
    name = kind.name
    if value is None:
        return None
    bad = TypeMismatchError(f"value {value!r} does not fit {kind}")
    if isinstance(value, bool):
        if name == "BOOL":
            return value
        raise bad
    if isinstance(value, int):
        if name == "FLOAT":
            return float(value)
        bits = {"INT": 63, "BIGINT": 63, "SMALLINT": 15}.get(name)
        if bits and -(1 << bits) <= value < 1 << bits:
            return value
        raise TypeMismatchError(f"value {value} out of range for {kind}") if bits else bad
    if isinstance(value, float):
        if name == "FLOAT" and math.isfinite(value):
            return value
        raise bad
    if name == "TEXT" and isinstance(value, str):
        return value
    if isinstance(value, str):
        if name in ("VARCHAR", "CHAR"):
            if len(kind.params) != 1:
                raise TypeMismatchError(f"{name} needs one length")
            if len(value.encode()) > kind.params[0]:
                raise TypeMismatchError(f"value {value!r} is longer than {kind}")
            return value if name == "VARCHAR" else value.ljust(kind.params[0])
        try:
            if name == "DATE":
                if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value, re.ASCII):
                    raise ValueError
                return dt.date.fromisoformat(value)
            if name == "TIME":
                t = dt.time.fromisoformat(value)
                return t.hour * 3600 + t.minute * 60 + t.second
            if name == "TIMESTAMP":
                return timestamp(value)
        except ValueError:
            raise TypeMismatchError(f"value {value!r} is no {name}") from None
        if name == "DECIMAL":
            if len(kind.params) != 2:
                raise TypeMismatchError("DECIMAL needs precision and scale")
            found = decimal(value, *kind.params)
            if found is not None:
                return found
    if isinstance(value, (dt.date, Decimal)) and type(value) is {"DATE": dt.date, "TIMESTAMP": dt.datetime, "DECIMAL": Decimal}.get(name):
        return value
    raise bad


def timestamp(text: str) -> dt.datetime:
    """Whole seconds in UTC, without a zone; a plain date is its midnight, no zone means UTC."""
    if len(text) == 10:
        return dt.datetime.combine(dt.date.fromisoformat(text), dt.time())
    t = dt.datetime.fromisoformat(text[:-1] + "+00:00" if text.endswith("Z") else text)
    if t.tzinfo is not None:
        t = t.astimezone(dt.UTC).replace(tzinfo=None)
    return t.replace(microsecond=0)


def stored(column: Column, source: Kind, target: Kind) -> Column:
    """*column* of kind *source* as stored in a column of kind *target*; values that do not fit are errors."""
    say = lambda what: F.raise_error(F.lit(f"TypeMismatch: {what} {target}"))
    name = target.name
    if source.name == "NULL":
        return F.lit(None).cast(target.spark)
    if name in INTEGERS and source.name in INTEGERS:
        if name == "SMALLINT":
            return F.when(column.isNull() | column.between(-(1 << 15), (1 << 15) - 1), column.cast("short")).otherwise(say("value out of range for").cast("short"))
        return column.cast("long")
    if name == "FLOAT" and source.name in (*INTEGERS, "FLOAT"):
        value = column.cast("double")
        return F.when(value.isNull() | ~(F.isnan(value) | (F.abs(value) == float("inf"))), value).otherwise(say("no finite value for").cast("double"))
    if name == "TEXT" and source.name in TEXTS:
        return column
    if name in ("VARCHAR", "CHAR") and source.name in TEXTS:
        if len(target.params) != 1:
            raise TypeMismatchError(f"{name} needs one length")
        long = target.params[0]
        value = F.rtrim(column) if source.name == "CHAR" and name == "CHAR" else column
        fits = F.when(value.isNull() | (F.octet_length(value) <= long), value).otherwise(say("value is longer than"))
        return F.rpad(fits, long, " ") if name == "CHAR" else fits
    if name == source.name and (name != "DECIMAL" or source.params == target.params):
        return column
    if name == "DECIMAL" and source.name in ("DECIMAL", *INTEGERS):
        return column.cast(target.spark)
    raise TypeMismatchError(f"a {source} value does not fit {target}")


def render(value: object, kind: Kind) -> str:
    """A cell as text."""
    if value is None:
        return ""
    name = kind.name
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if name == "TIME":
        return str(dt.time(value // 3600, value // 60 % 60, value % 60))
    if isinstance(value, dt.datetime):
        return value.replace(microsecond=0).isoformat() + "+00:00"
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) else repr(value)
    if isinstance(value, Decimal):
        return f"{value:f}"
    return str(value)
