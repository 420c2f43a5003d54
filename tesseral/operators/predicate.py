"""Filters: a ``where`` object becomes one Column, with SQL's three-valued logic.

Relation predicates are correlated EXISTS subqueries, which Catalyst turns into semi, anti and existence joins,
at any depth and under any of AND, OR and NOT. Two departures, both stricter: an unknown key is an error, and all
of ``some``, ``every`` and ``none`` that are given hold together."""

from __future__ import annotations

import datetime as dt
import itertools
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnknownColumnError
from ..functions.kinds import kind_of
from ..plans.manifest import ColumnDef, Manifest, Relation, TableDef

MODES = ("some", "every", "none")


def escaped(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(value: Any, column: ColumnDef) -> Column:
    """The value in the column's own type, so that comparisons keep the column bare and reach the scan."""
    if value is None:
        return F.lit(None).cast(column.data_type)
    kind = kind_of(column.type_kind)
    value = kind.coerce(value)
    kind_type = column.data_type
    if isinstance(kind_type, T.ArrayType):
        return F.array(*[F.lit(v) for v in value]).cast(kind_type)
    if isinstance(kind_type, T.TimestampNTZType) and isinstance(value, dt.datetime):
        return F.lit(value.isoformat(sep=" ")).cast(kind_type)
    if isinstance(kind_type, T.TimestampType) and isinstance(value, dt.datetime) and value.tzinfo:
        return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))
    if isinstance(kind_type, T.StringType) and not kind_type.isUTF8BinaryCollation():
        return F.lit(value)
    if isinstance(value, int) and not isinstance(value, bool) and isinstance(kind_type, T.IntegralType):
        bits = {"tinyint": 8, "smallint": 16, "int": 32}.get(kind_type.simpleString(), 64)
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            return F.lit(value)  # beyond the column: compared in the wider type
    return F.lit(value).cast(kind_type)


def pattern(value: Any) -> str:
    """Wildcards in the value stay wildcards; a backslash that would end the pattern is doubled."""
    text = str(value)
    trailing = len(text) - len(text.rstrip("\\"))
    return text + "\\" if trailing % 2 else text


def member(c: Column, values: list, column: ColumnDef) -> Column:
    if not values:
        return F.lit(False)
    return c.isin(*[literal(v, column) for v in values])


def _like(c: Column, p: str) -> Column:
    return c.cast("string").ilike(p)


OPERATORS = {
    "equals": lambda c, v, d: compare_equal(c, v, d),
    "contains": lambda c, v, d: _like(c, f"%{pattern(v)}%" if not str(v).endswith("\\") else f"%{str(v)[:-1]}\\\\%"),
    "startsWith": lambda c, v, d: _like(c, f"{pattern(v)}%"),
    "endsWith": lambda c, v, d: _like(c, f"%{pattern(v)}"),
    "gt": lambda c, v, d: c > literal(v, d),
    "gte": lambda c, v, d: c >= literal(v, d),
    "lt": lambda c, v, d: c < literal(v, d),
    "lte": lambda c, v, d: c <= literal(v, d),
    "in": lambda c, v, d: member(c, list(v), d),
    "notIn": lambda c, v, d: ~member(c, list(v), d) if list(v) else F.lit(True),
    "isNull": lambda c, v, d: c.isNull(),
    "isNotNull": lambda c, v, d: c.isNotNull(),
}


def compare_equal(c: Column, value: Any, d: ColumnDef) -> Column:
    """``= value``; for a null never true, unlike the shorthand."""
    special = kind_of(d.type_kind).equals
    if special and value is not None:
        return special(c, value)
    return c == literal(value, d)


def column_condition(c: Column, value: Any, d: ColumnDef) -> Column | None:
    if value is None:
        return c.isNull()
    if isinstance(value, dict):
        special = kind_of(d.type_kind).where_ops
        terms = []
        for op, operand in value.items():
            if op in special:
                terms.append(special[op](c, operand, d.options))
            elif op in OPERATORS:
                terms.append(OPERATORS[op](c, operand, d))
        if not terms and value:  # no operator at all: a document to be equal to
            return compare_equal(c, value, d)
        return reduce(and_, terms) if terms else None
    return compare_equal(c, value, d)


class Scope:
    """One compilation: gives every use of a table an alias of its own."""

    def __init__(self, manifest: Manifest, read):
        self.manifest, self.read, self._numbers = manifest, read, itertools.count()

    def aliased(self, table: TableDef) -> tuple[DataFrame, str]:
        alias = f"t{next(self._numbers)}"
        return self.read(table).alias(alias), alias

    def where(self, table: TableDef, alias: str, where: dict | None) -> Column | None:
        """The condition, or None where nothing is asked."""
        terms = []
        for key, value in (where or {}).items():
            if key == "AND" or key == "OR":
                items = value if isinstance(value, (list, tuple)) else [value]
                parts = [p for p in (self.where(table, alias, item) for item in items) if p is not None]
                if parts:
                    terms.append(reduce(and_ if key == "AND" else or_, parts))
            elif key == "NOT":
                parts = [self.where(table, alias, item) for item in (value if isinstance(value, (list, tuple)) else [value])]
                terms += [~p for p in parts if p is not None]
            elif (column := table.column(key)) is not None and not (isinstance(value, dict) and key in table.relations and set(value) & set(MODES)):
                part = column_condition(F.col(f"{alias}.{escaped(column.storage)}"), value, column)
                if part is not None:
                    terms.append(part)
            elif key in table.relations:
                part = self.relation(table.relations[key], alias, value)
                if part is not None:
                    terms.append(part)
            else:
                raise UnknownColumnError(f"Unknown key in where on {table.accessor}: {key}")
        return reduce(and_, terms) if terms else None

    def relation(self, relation: Relation, alias: str, value: Any) -> Column | None:
        if relation.cardinality == "one" and not (isinstance(value, dict) and set(value) & set(MODES)):
            if value is None:
                return ~self.exists(relation, alias, None)
            return self.exists(relation, alias, value)
        terms = []
        for mode in MODES:
            if mode in (value or {}):
                inner = value[mode] if isinstance(value[mode], dict) else {}
                if mode == "some":
                    terms.append(self.exists(relation, alias, inner))
                elif mode == "none":
                    terms.append(~self.exists(relation, alias, inner))
                else:
                    terms.append(~self.exists(relation, alias, inner, negated=True) if self._asks(relation, inner) else F.lit(True))
        return reduce(and_, terms) if terms else None

    def _asks(self, relation: Relation, inner: dict) -> bool:
        return self.where(self.manifest.table(relation.target), "probe", inner) is not None

    def exists(self, relation: Relation, alias: str, inner: dict | None, negated: bool = False) -> Column:
        """Whether a related row meets ``inner``; with ``negated``, whether one fails it."""
        target = self.manifest.table(relation.target)
        rows, name = self.aliased(target)
        outer = F.col(f"{alias}.{escaped(relation.local)}").outer()
        if relation.kind == "m2m":
            links, via = self.aliased(self.manifest.table(relation.through))
            rows = links.join(rows, F.col(f"{via}.{escaped(relation.through_remote)}") == F.col(f"{name}.{escaped(relation.remote)}"))
            met = F.col(f"{via}.{escaped(relation.through_local)}") == outer
        else:
            met = F.col(f"{name}.{escaped(relation.remote)}") == outer
        inner_condition = self.where(target, name, inner)
        if inner_condition is not None:
            met = met & (~inner_condition if negated else inner_condition)
        return rows.where(met).exists()
