"""The engine's errors."""

from __future__ import annotations

import builtins


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    """The text is no statement of the dialect."""

    def __init__(self, message: str, line: int = 1, col: int = 1) -> None:
        super().__init__(f"{message} (line {line}, col {col})")
        self.line, self.col = line, col


class TypeMismatchError(EngineError, builtins.TypeError):
    """A value or operator does not fit a type."""


class ConstraintError(EngineError):
    """A primary key, NOT NULL, UNIQUE or arity rule is broken."""


class StorageError(EngineError):
    """A table or column is missing, or the store is unreadable."""


class TransactionError(EngineError):
    """BEGIN, COMMIT or ROLLBACK out of place, or the store is in use."""
