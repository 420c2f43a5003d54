"""Predicates on JSON held as text, as Column expressions: keys, paths and containment."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _variant(column: Column) -> Column:
    return F.try_parse_json(column)


def keys_of(column: Column) -> Column:
    """Keys of an object, or the strings of an array, as containment of keys counts both; null for other values."""
    strings = F.try_variant_get(_variant(column), "$", "array<string>")
    raw = F.try_variant_get(_variant(column), "$", "array<variant>")
    only_strings = F.transform(F.filter(raw, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.json_object_keys(column), F.when(strings.isNotNull(), only_strings))


def has_key(column: Column, key: str) -> Column:
    return F.array_contains(keys_of(column), F.lit(key))


def has_any_keys(column: Column, keys: list[str]) -> Column:
    return F.arrays_overlap(keys_of(column), F.array(*[F.lit(k) for k in keys]).cast("array<string>"))


def has_all_keys(column: Column, keys: list[str]) -> Column:
    wanted = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    return F.size(F.array_except(wanted, keys_of(column))) == 0


def json_path(segments: list[Any]) -> str:
    """``$['a'][0]``: digits address arrays, everything else is a quoted key, so that no segment can break out."""
    out = "$"
    for s in segments:
        text = str(s)
        out += f"[{text}]" if text.isdigit() else "['" + text.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


def at_path(column: Column, segments: list[Any]) -> Column:
    """The value at the path as text: scalars bare, objects and arrays as JSON, null if it isn't there."""
    if any("'" in str(s) or "\\" in str(s) or '"' in str(s) for s in segments):
        value = _variant(column)
        step = F.lit(None).cast("string")
        whole = F.from_json(column, "map<string,string>")
        for i, s in enumerate(segments):  # keys that a path can't quote are looked up one by one
            step = F.element_at(whole, F.lit(str(s)))
            if i + 1 < len(segments):
                whole = F.from_json(step, "map<string,string>")
        return F.when(value.isNotNull(), step)
    # An object's member and an array's item are both tried for digits, as a JSON path operator does.
    found = F.get_json_object(column, json_path(segments))
    if any(str(s).isdigit() for s in segments):
        keyed = "$" + "".join("['" + str(s) + "']" for s in segments)
        found = F.coalesce(found, F.get_json_object(column, keyed))
    return found


def path_equals(column: Column, segments: list[Any], value: Any) -> Column:
    if isinstance(value, bool):
        value = "true" if value else "false"
    if isinstance(value, (dict, list)):
        return normal(at_path(column, segments)) == normal(F.lit(json.dumps(value)))
    return at_path(column, segments) == F.lit(str(value))


def normal(column: Column) -> Column:
    """JSON text with sorted keys and no spaces, for equality."""
    return _variant(column).cast("string")


def equals(column: Column, value: Any) -> Column:
    return normal(column) == normal(F.lit(json.dumps(value)))


def contains(column: Column, value: Any) -> Column:
    """Containment of a literal document, spelled out: objects key by key, arrays item by item, scalars by value."""
    return F.when(column.isNotNull(), F.coalesce(_holds(_variant(column), value, True), F.lit(False)))


def _holds(v: Column, value: Any, top: bool = False) -> Column:
    kind = F.schema_of_variant(v)
    if isinstance(value, dict):
        out = kind.startswith("OBJECT")
        members = F.try_variant_get(v, "$", "map<string,variant>")
        for k, item in value.items():
            out = out & F.coalesce(_holds(F.element_at(members, F.lit(k)), item), F.lit(False))
        return out
    if isinstance(value, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        out = kind.startswith("ARRAY")
        for item in value:
            out = out & _any_holds(items, item)
        return out
    same = _scalar_equals(v, kind, value)
    if top:  # an array contains a bare scalar that it lists
        return same | (kind.startswith("ARRAY") & _any_holds(F.try_variant_get(v, "$", "array<variant>"), value))
    return same


def _any_holds(items: Column, item: Any) -> Column:
    def test(x: Column) -> Column:
        return F.coalesce(_holds(x, item), F.lit(False))

    return F.coalesce(F.exists(items, test), F.lit(False))


def _scalar_equals(v: Column, kind: Column, value: Any) -> Column:
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
    if isinstance(value, (int, float)):
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        return number & F.coalesce(F.try_variant_get(v, "$", "double") == float(value), F.lit(False))
    return (kind == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string") == F.lit(str(value)), F.lit(False))
