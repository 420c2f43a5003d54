"""Errors that queries, writes and migrations raise."""

from __future__ import annotations


class TesseralError(Exception):
    """Base of all errors of this package."""


class SchemaError(TesseralError, ValueError):
    """A schema, or a use of it, that doesn't hold together."""


class UnknownColumnError(SchemaError):
    """A key in a query names neither a column nor a relation."""


class QueryError(TesseralError):
    """A write that breaks a constraint. ``code`` is the SQLSTATE of the kind of constraint."""

    def __init__(self, message: str, code: str | None = None, table: str | None = None, constraint: str | None = None, hint: str | None = None):
        where = f" (table {table}{', ' + constraint if constraint else ''})" if table else ""
        super().__init__(message + where + (f"\nHint: {hint}" if hint else ""))
        self.code, self.table, self.constraint, self.hint = code, table, constraint, hint


class ConflictError(TesseralError):
    """Another writer has committed since the transaction began."""


class MigrationError(TesseralError):
    """A migration that can't be applied, undone or written."""
