"""Raw SQL: composable fragments with bound parameters, and a small builder on DataFrames."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .predicate import escaped

#: Quoted text, quoted names, dollar-quoted text and comments, in which a parameter is not one.
_SKIP = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\$([A-Za-z_]*)\$.*?\$\1\$|--[^\n]*|/\*.*?\*/|\$(\d+)", re.S)


class Fragment:
    """SQL text with ``$1``-style parameters; other fragments may be spliced in by ``sql``."""

    def __init__(self, text: str, params: list | None = None):
        self.text, self.params = text, list(params or [])

    def __add__(self, other: Fragment) -> Fragment:
        return Fragment(self.text + shifted(other.text, len(self.params)), self.params + other.params)

    def named(self) -> tuple[str, dict[str, Any]]:
        """Text and arguments as Spark takes them: ``:p1`` and so on."""
        used = [int(m[2]) for m in _SKIP.finditer(self.text) if m[2]]
        if used and max(used) > len(self.params):
            raise ValueError(f"parameter ${max(used)} has no value")
        return _SKIP.sub(lambda m: f":p{m[2]}" if m[2] else m[0], self.text), {f"p{i}": self.params[i - 1] for i in set(used)}


def shifted(text: str, by: int) -> str:
    """Parameters moved up by ``by``; quoted parts stay as they are."""
    return _SKIP.sub(lambda m: f"${int(m[2]) + by}" if m[2] else m[0], text)


def sql(template: str, *values: Any) -> Fragment:
    """``{}`` stands for the next value: a fragment is spliced in, anything else is bound as a parameter."""
    parts = template.split("{}")
    if len(parts) != len(values) + 1:
        raise ValueError("as many values are needed as there are {}")
    out = Fragment(parts[0])
    for value, part in zip(values, parts[1:], strict=True):
        out = out + (value if isinstance(value, Fragment) else Fragment("$1", [value])) + Fragment(part)
    return out


def identifier(*names: str) -> Fragment:
    """A quoted name, of several parts perhaps."""
    return Fragment(".".join(escaped(n) for n in names))


def execute(spark: SparkSession, query: Fragment | str, params: list | None = None) -> DataFrame:
    fragment = query if isinstance(query, Fragment) else Fragment(query, params)
    text, args = fragment.named()
    return spark.sql(text, args=args) if args else spark.sql(text)


class Builder:
    """``select_from(df).inner_join(...).select(...).group_by(...).order_by(...)``; the last order_by counts.

    Columns are ``table.column`` or bare names; ``agg`` and ``where`` take Columns or SQL text."""

    def __init__(self, read, name: str):
        self._read, self._rows, self._columns, self._groups, self._order, self._aggregates = read, read(name).alias(name), [], [], None, []

    def _join(self, name: str, left: str, right: str, how: str) -> Builder:
        self._rows = self._rows.join(self._read(name).alias(name), F.col(left) == F.col(right), how)
        return self

    def left_join(self, name: str, left: str, right: str) -> Builder:
        return self._join(name, left, right, "left")

    def inner_join(self, name: str, left: str, right: str) -> Builder:
        return self._join(name, left, right, "inner")

    def where(self, condition) -> Builder:
        self._rows = self._rows.where(condition)
        return self

    def select(self, *columns) -> Builder:
        self._columns += columns
        return self

    def group_by(self, *columns: str) -> Builder:
        self._groups += columns
        return self

    def agg(self, **aggregates) -> Builder:
        self._aggregates += [(F.expr(a) if isinstance(a, str) else a).alias(n) for n, a in aggregates.items()]
        return self

    def order_by(self, column: str, direction: str = "asc") -> Builder:
        self._order = (column, direction)
        return self

    def frame(self) -> DataFrame:
        from .include import ordering

        rows = self._rows
        by = [F.col(c).alias(c.split(".")[-1]) for c in self._groups]
        shown = [F.col(c) if isinstance(c, str) else c for c in self._columns]
        order = [ordering(F.col(self._order[0] if not self._groups else self._order[0].split(".")[-1]), self._order[1])] if self._order else []
        if self._groups:
            rows = rows.groupBy(*by).agg(*self._aggregates) if self._aggregates else rows.select(*by).distinct()
            rows = rows.orderBy(*order) if order else rows
            return rows.select(*[F.col(c.split(".")[-1]) if isinstance(c, str) else c for c in self._columns], *[F.col(n) for n in rows.columns if n not in [g.split(".")[-1] for g in self._groups] and n not in self._columns]) if self._columns else rows
        if self._aggregates:
            return rows.agg(*self._aggregates)
        rows = rows.orderBy(*order) if order else rows
        return rows.select(*shown) if shown else rows
