"""Results as text tables."""

from __future__ import annotations

from .database import ResultSet


def plural(count: int) -> str:
    return f"{count} row" if count == 1 else f"{count} rows"


def grid(columns: list[str], rows: list[list[str]]) -> str:
    """A boxed table, and the number of rows if there are any."""
    if not columns:
        return "(empty result set)\n"
    widths = [max(map(len, cells)) for cells in zip(columns, *rows, strict=True)]
    rule = "+".join(["", *("-" * (w + 2) for w in widths), ""])
    show = lambda cells: "|".join(["", *(f" {c:<{w}} " for c, w in zip(cells, widths, strict=True)), ""])
    body = [rule, show(columns), rule, *map(show, rows), rule]
    return "\n".join(body + ([f"({plural(len(rows))})"] if rows else [])) + "\n"


def result(found: ResultSet) -> str:
    if found.rows_affected:
        return f"{plural(found.rows_affected)} affected\n"
    return grid(found.columns, found.rows) if found.columns else ""
