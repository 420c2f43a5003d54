"""Keyset pagination: order, cursor predicate, and the cursor's text form."""

from __future__ import annotations

import base64
import binascii
import dataclasses
import datetime as dt
import decimal
import json
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SchemaError, UnknownColumnError
from ..plans.manifest import ColumnDef, TableDef
from .predicate import escaped, literal


@dataclasses.dataclass
class Page:
    items: list[dict]
    next_cursor: dict | None
    has_more: bool


def order_spec(table: TableDef, order_by: dict | None) -> list[tuple[ColumnDef, str]]:
    """Columns and directions, with the primary key behind as a tie-break in the same direction."""
    if not order_by:
        raise SchemaError("paginate requires orderBy")
    if len(table.primary_key) != 1:
        raise SchemaError("Operation requires a single-column primary key")
    spec = []
    for name, direction in order_by.items():
        column = table.column(name)
        if column is None:
            raise UnknownColumnError(f"Unknown orderBy column: {name}")
        spec.append((column, "desc" if str(direction).lower() == "desc" else "asc"))
    if len({d for _, d in spec}) > 1:
        raise SchemaError("paginate orderBy columns must share one direction")
    key = table.key_columns[0]
    if key not in [c for c, _ in spec]:
        spec.append((key, spec[-1][1]))
    return spec


def cursor_where(alias: str, spec: list[tuple[ColumnDef, str]], after: dict) -> Column:
    """Rows after the cursor: ``a > x or (a = x and b > y)`` and so on; a null never passes."""
    terms = []
    for i, (column, direction) in enumerate(spec):
        for c, _ in spec[: i + 1]:
            if c.name not in after:
                raise SchemaError(f"Cursor missing required field: {c.name}")
        here = F.col(f"{alias}.{escaped(column.storage)}")
        value = literal(after[column.name], column)
        same = [F.col(f"{alias}.{escaped(c.storage)}") == literal(after[c.name], c) for c, _ in spec[:i]]
        terms.append(reduce(and_, [*same, here > value if direction == "asc" else here < value]))
    return reduce(or_, terms)


def cursor_of(row: dict, spec: list[tuple[ColumnDef, str]]) -> dict:
    return {c.name: row[c.name] for c, _ in spec}


def _plain(value: Any) -> Any:
    if isinstance(value, dt.datetime) or isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    raise TypeError(f"{type(value).__name__} can't stand in a cursor")


def encode_cursor(cursor: dict) -> str:
    """Base64url of ``{"v":1,"c":{...}}`` without padding."""
    text = json.dumps({"v": 1, "c": cursor}, separators=(",", ":"), ensure_ascii=False, default=_plain)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> dict:
    try:
        raw = base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_", validate=True)
        data = json.loads(raw)
    except (binascii.Error, ValueError, TypeError, AttributeError) as error:
        raise SchemaError("Invalid cursor encoding") from error
    if not isinstance(data, dict) or data.get("v") != 1 or not isinstance(data.get("c"), dict):
        raise SchemaError("Invalid cursor payload")
    return data["c"]
