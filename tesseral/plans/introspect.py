"""From DataFrames back to a manifest, and from a manifest to the source of a schema."""

from __future__ import annotations

import json
import keyword
import re
from typing import Any

from pyspark.sql import types as T

from .manifest import UNSET, ColumnDef, Manifest, TableDef, resolve


def kind_for(data_type: T.DataType) -> tuple[str, dict]:
    """The column kind of a Spark type; unknown types count as text."""
    simple = {T.IntegerType: "int", T.ShortType: "smallint", T.ByteType: "smallint", T.LongType: "bigint", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "bool", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz", T.DateType: "date", T.BinaryType: "bytea"}
    if isinstance(data_type, T.StringType):
        return ("text" if data_type.isUTF8BinaryCollation() else "citext"), {}
    if isinstance(data_type, T.DecimalType):
        return "decimal", {"precision": data_type.precision, "scale": data_type.scale}
    if isinstance(data_type, T.ArrayType):
        if isinstance(data_type.elementType, T.StringType):
            return "textArray", {}
        if isinstance(data_type.elementType, T.IntegerType):
            return "intArray", {}
        return "array", {"of": kind_for(data_type.elementType)[0]}
    if isinstance(data_type, T.VariantType):
        return "jsonb", {}
    return simple.get(type(data_type), "text"), {}


def camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), name)


def manifest_of(frames: dict[str, Any]) -> Manifest:
    """Tables from DataFrames or StructTypes by storage name. A kind noted in a field's metadata is kept."""
    tables = {}
    for storage, frame in frames.items():
        fields = (frame if isinstance(frame, T.StructType) else frame.schema).fields
        columns = []
        for f in fields:
            kind, options = kind_for(f.dataType)
            noted = f.metadata.get("kind")
            columns.append(ColumnDef(f.name, f.name, noted if noted and noted not in ("fk", "enum", "array", "decimal") else kind, options, f.nullable))
        tables[camel(storage)] = TableDef(camel(storage), storage, columns, [])
    manifest = Manifest(tables)
    resolve(manifest)
    return manifest


#: The schema function of each kind whose function has another name or takes options.
_CALLS = {"id": "id_()", "bool": "bool_()", "int": "int_()", "float": "float_()", "timestamp_ntz": "timestamp(tz=False)", "textArray": "text_array()", "intArray": "int_array()"}


def _column_source(c: ColumnDef) -> str:
    o = c.options
    if c.kind == "fk":
        args = [json.dumps(c.fk_target)]
        args += [f"as_={json.dumps(c.fk_as)}"] if c.fk_as else []
        args += [f"inverse={json.dumps(c.fk_inverse)}"] if c.fk_inverse else []
        args += ["unique=True"] if c.unique else []
        args += ["nullable=False"] if not c.nullable else []
        args += [f"on_delete={json.dumps(c.on_delete)}"] if c.on_delete != "no action" else []
        out = f"fk({', '.join(args)})"
    elif c.kind == "enum":
        out = f"enum({', '.join(json.dumps(v) for v in o['values'])}{', mode=' + json.dumps(o['mode']) if o.get('mode') else ''})"
    elif c.kind == "decimal":
        out = f"decimal({o['precision']}, {o.get('scale', 0)})" if "precision" in o else "decimal()"
    elif c.kind == "array":
        out = f"array({json.dumps(o['of'])})"
    elif c.kind == "uuid":
        out = f"uuid({o.get('version', 7)})"
    elif c.kind in ("geometry", "geography"):
        out = f"{c.kind}({json.dumps(o.get('subtype')) if o.get('subtype') else 'None'}, {int(o.get('srid') or 4326)})"
    elif c.kind == "point":
        out = f"point({int(o.get('srid') or 4326)})"
    elif c.kind in ("text", "bigint", "double", "date", "timestamp", "json", "jsonb", "serial", "bytea", "citext"):
        out = f"{c.kind}()"
    else:
        out = _CALLS.get(c.kind) or f"column({json.dumps(c.kind)})"
    if c.kind != "fk":
        if c.primary and c.kind != "id":
            out += ".primary()"
        elif not c.nullable and not c.primary and c.kind != "serial":
            out += ".not_null()"
        if c.unique:
            out += ".unique()"
    if c.default_now:
        out += ".default_now()"
    elif c.default is not UNSET and c.default != UNSET:
        out += f".default({c.default!r})"
    if c.updated_at:
        out += ".updated_at()"
    return out + f".map({json.dumps(c.storage)})"


def schema_source(manifest: Manifest) -> str:
    """Python source of a schema that gives this manifest; every name in it is quoted as a literal."""
    lines = ['"""Schema, as found in the store."""', "", "from tesseral.schema import *  # noqa: F403", "", "schema = define_schema("]
    for x in manifest.links:
        args = [json.dumps(v) for v in (x.left, x.right, x.through, x.as_, x.inverse)]
        args += [json.dumps(v) if v else "None" for v in (x.left_relation, x.right_relation)]
        lines.append(f"    many_to_many({', '.join(args)}),")
    lines.append("    **{")
    for t in manifest.tables.values():
        lines.append(f"        {json.dumps(t.accessor)}: table(")
        lines.append(f"            {json.dumps(t.storage)},")
        if len(t.primary_key) > 1:
            lines.append(f"            primary_key({', '.join(json.dumps(c.name) for c in t.key_columns)}),")
        for i in t.indexes:
            names = ", ".join(json.dumps(t.stored(c).name) for c in i.columns)
            lines.append(f"            {'unique' if i.unique else 'index'}({names}, name={json.dumps(i.name)}),")
        lines.append("            columns={")
        composite = len(t.primary_key) > 1
        for c in t.columns:
            import dataclasses

            shown = dataclasses.replace(c, primary=False) if composite and c.primary else c
            lines.append(f"                {json.dumps(c.name)}: {_column_source(shown)},")
        lines += ["            },", "        ),"]
    lines += ["    },", ")", ""]
    return "\n".join(lines)


def model_source(manifest: Manifest) -> str:
    """Python source of a TypedDict for each table's rows, for editors and type checkers."""
    names = {"string": "str", "int": "int", "bigint": "int", "smallint": "int", "double": "float", "float": "float", "boolean": "bool", "binary": "bytes"}
    lines = ['"""Row types, written from the schema."""', "", "from typing import Any, TypedDict", ""]
    for t in manifest.tables.values():
        title = re.sub(r"\W", "_", t.accessor[:1].upper() + t.accessor[1:])
        fields = []
        for c in t.columns:
            simple = c.data_type.simpleString().split(" ")[0]
            python = "str" if c.kind == "decimal" else "Any" if c.type_kind in ("json", "jsonb", "geometry", "geography", "point") else names.get(simple, "list" if simple.startswith("array") else "Any")
            fields.append(f"{json.dumps(c.name)}: {python if c.required else python + ' | None'}")
        lines.append(f"{title + '_' if keyword.iskeyword(title) else title} = TypedDict({json.dumps(title)}, {{{', '.join(fields)}}})")
    return "\n".join([*lines, ""])
