"""Errors with the codes that clients see."""

from __future__ import annotations


class EngineError(Exception):
    """An error with a code."""

    code = "DB-000"

    def __init__(self, message: str) -> None:
        super().__init__(f"{self.code}: {message}")


class MalformedRequest(EngineError):
    code = "DB-401"


class DuplicateIndex(EngineError):
    code = "DB-402"


class MissingIndex(EngineError):
    code = "DB-403"


class UnknownIndexType(EngineError):
    code = "DB-404"


class MissingDocument(EngineError):
    code = "DB-405"


class SqlError(EngineError):
    code = "SQL-001"


class UnknownTable(LookupError):
    """No table of that name is registered."""


class UnknownColumn(LookupError):
    """A table has no column of that name."""


class InactiveTransaction(RuntimeError):
    """A transaction that has ended can't write."""
