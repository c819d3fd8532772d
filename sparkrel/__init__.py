"""sparkrel: a small relational SQL engine on PySpark."""

from .database import Database, ResultSet
from .errors import ConstraintError, EngineError, ParseError, StorageError, TransactionError, TypeMismatchError

TypeError = TypeMismatchError  # noqa: A001

__all__ = ["ConstraintError", "Database", "EngineError", "ParseError", "ResultSet", "StorageError", "TransactionError", "TypeError", "TypeMismatchError"]
