"""Column kinds: how a declared column is typed, coerced, projected, updated and filtered.

A kind is an object; ``register_kind`` adds one of your own. Its ``where_ops`` map an operator's name to a function
``(column, value, options) -> Column``, so new operators stay inside Catalyst."""

from __future__ import annotations

import base64
import dataclasses
import datetime as dt
import decimal
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from . import json_ops, spatial

Op = Callable[[Column, Any, dict], Column]


@dataclasses.dataclass(frozen=True)
class Kind:
    name: str
    spark_type: Callable[[dict], T.DataType]
    coerce: Callable[[Any], Any] = lambda v: v
    where_ops: dict[str, Op] = dataclasses.field(default_factory=dict)
    select: Callable[[Column, dict], Column] | None = None
    write: Callable[[Column, dict], Column] | None = None
    updated_at: Callable[[], Column] | None = None
    extension: str | None = None
    equals: Callable[[Column, Any], Column] | None = None
    present: Callable[[Any], Any] = lambda v: v


_KINDS: dict[str, Kind] = {}
_BUILT_IN: set[str] = set()


def register_kind(kind: Kind, overwrite: bool = False) -> None:
    if kind.name in _KINDS and not overwrite:
        raise SchemaError(f"Column kind already registered: {kind.name}")
    _KINDS[kind.name] = kind


def unregister_kind(name: str) -> None:
    if name in _BUILT_IN:
        raise SchemaError(f"Built-in column kind can't be removed: {name}")
    _KINDS.pop(name, None)


def kind_of(name: str) -> Kind:
    if name == "fk":  # of itself a foreign key is text; the schema resolves it to its target's kind
        return _KINDS["text"]
    if name not in _KINDS:
        raise SchemaError(f"Unknown column kind: {name}")
    return _KINDS[name]


def kinds() -> list[str]:
    return sorted(_KINDS)


def extensions(names) -> list[str]:
    return sorted({kind_of(n).extension for n in names if kind_of(n).extension})


def _integer(v):
    return None if v is None else int(v)


def _boolean(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, str):
        if v.lower() in ("true", "t", "1"):
            return True
        if v.lower() in ("false", "f", "0"):
            return False
        raise ValueError(f"not a boolean: {v!r}")
    return v != 0


def _timestamp(v):
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        v = dt.datetime.fromtimestamp(v / 1000, dt.UTC)
    return v


def _naive(v):
    v = _timestamp(v)
    return v.astimezone(dt.UTC).replace(tzinfo=None) if isinstance(v, dt.datetime) and v.tzinfo else v


def _date(v):
    if isinstance(v, str):
        return dt.date.fromisoformat(v[:10])
    return v.date() if isinstance(v, dt.datetime) else v


def _decimal(v):
    return v if v is None or isinstance(v, decimal.Decimal) else decimal.Decimal(str(v))


def _json(v):
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _read_json(v):
    return json.loads(v) if isinstance(v, str) else v


def _bytes(v):
    return base64.b64decode(v) if isinstance(v, str) else (bytes(v) if v is not None else None)


def _text(v):
    return None if v is None else str(v)


def _path(column: Column, value: Any, options: dict) -> Column:
    segments = value.get("segments")
    if not isinstance(segments, (list, tuple)) or not segments:
        raise ValueError("path requires a non-empty list of segments")
    if "jsonContains" in value:
        return json_ops.contains(json_ops.at_path(column, list(segments)), value["jsonContains"])
    if "equals" not in value:
        raise ValueError("path requires equals or jsonContains")
    return json_ops.path_equals(column, list(segments), value["equals"])


JSON_OPS: dict[str, Op] = {
    "jsonContains": lambda c, v, o: json_ops.contains(c, v),
    "hasKey": lambda c, v, o: json_ops.has_key(c, v),
    "hasAnyKeys": lambda c, v, o: json_ops.has_any_keys(c, v),
    "hasAllKeys": lambda c, v, o: json_ops.has_all_keys(c, v),
    "path": _path,
}


def _spatial_ops(geography: bool) -> dict[str, Op]:
    return {
        "intersects": lambda c, v, o: spatial.intersects(c, v),
        "within": lambda c, v, o: spatial.within(c, v),
        "dWithin": lambda c, v, o: spatial.d_within(c, v["geometry"], v["distance"], geography),
    }


def _decimal_type(options: dict) -> T.DataType:
    if "precision" in options:
        return T.DecimalType(options["precision"], options.get("scale", 0))
    return T.DecimalType(38, 18)


def _array(element: T.DataType, coerce) -> Callable:
    return lambda v: None if v is None else [coerce(x) for x in v]


def _simple(name: str, spark_type: T.DataType, coerce=lambda v: v, **more) -> Kind:
    return Kind(name, lambda options: spark_type, coerce, **more)


for _kind in (
    _simple("id", T.StringType(), _text),
    _simple("text", T.StringType(), _text),
    _simple("bool", T.BooleanType(), _boolean),
    _simple("int", T.IntegerType(), _integer),
    _simple("bigint", T.LongType(), _integer),
    _simple("smallint", T.ShortType(), _integer),
    _simple("double", T.DoubleType(), lambda v: None if v is None else float(v)),
    _simple("float", T.FloatType(), lambda v: None if v is None else float(v)),
    _simple("date", T.DateType(), _date),
    _simple("timestamp", T.TimestampType(), _timestamp, updated_at=F.current_timestamp),
    _simple("timestamp_ntz", T.TimestampNTZType(), _naive, updated_at=F.localtimestamp),
    _simple("uuid", T.StringType(), _text),
    _simple("json", T.StringType(), _json, where_ops=JSON_OPS, equals=json_ops.equals, present=_read_json),
    _simple("jsonb", T.StringType(), _json, where_ops=JSON_OPS, equals=json_ops.equals, present=_read_json),
    Kind("decimal", _decimal_type, _decimal, present=lambda v: None if v is None else str(v)),
    _simple("serial", T.IntegerType(), _integer),
    _simple("enum", T.StringType(), _text),
    _simple("bytea", T.BinaryType(), _bytes),
    _simple("textArray", T.ArrayType(T.StringType()), _array(T.StringType(), _text)),
    _simple("intArray", T.ArrayType(T.IntegerType()), _array(T.IntegerType(), _integer)),
    Kind("array", lambda o: T.ArrayType(kind_of(o["of"]).spark_type({})), lambda v: v),
    _simple("citext", T.StringType("UTF8_LCASE"), _text, extension="citext"),
    _simple("geometry", T.StringType(), _json, where_ops=_spatial_ops(False), extension="postgis", present=_read_json),
    _simple("geography", T.StringType(), _json, where_ops=_spatial_ops(True), extension="postgis", present=_read_json),
    _simple("point", T.StringType(), _json, where_ops=_spatial_ops(False), extension="postgis", present=_read_json),
):
    register_kind(_kind)
    _BUILT_IN.add(_kind.name)
