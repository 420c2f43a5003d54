"""The schema language: tables, typed columns, keys, foreign keys and many-to-many links.

    users = table("users", id=id_().primary(), email=text().not_null().unique())
    posts = table("posts", id=id_().primary(), authorId=fk("users.id", as_="author", inverse="posts"), title=text())
    schema = define_schema(users=users, posts=posts)
"""

from __future__ import annotations

import dataclasses
import re
from typing import Any

from .errors import SchemaError
from .plans.manifest import UNSET, ColumnDef, Index, ManyToMany, Manifest, build

ON_DELETE = ("cascade", "restrict", "set null", "no action")


@dataclasses.dataclass(frozen=True)
class Column:
    """A column as declared; every method gives a changed copy."""

    kind: str
    options: dict = dataclasses.field(default_factory=dict)
    nullable: bool = True
    is_unique: bool = False
    is_primary: bool = False
    default_value: Any = UNSET
    now: bool = False
    touched: bool = False
    storage: str | None = None
    target: str | None = None
    relation: str | None = None
    inverse: str | None = None
    on_delete: str = "no action"

    def not_null(self) -> Column:
        return dataclasses.replace(self, nullable=False)

    def unique(self) -> Column:
        return dataclasses.replace(self, is_unique=True)

    def default(self, value: Any) -> Column:
        return dataclasses.replace(self, default_value=value)

    def default_now(self) -> Column:
        return dataclasses.replace(self, now=True)

    def updated_at(self) -> Column:
        return dataclasses.replace(self, touched=True)

    def primary(self) -> Column:
        return dataclasses.replace(self, is_primary=True, nullable=False)

    def map(self, name: str) -> Column:
        return dataclasses.replace(self, storage=name)


def column(kind: str, **options) -> Column:
    """A column of any kind, registered ones included."""
    return Column(kind, options)


def id_() -> Column:
    return Column("id", is_primary=True, nullable=False)


def text() -> Column:
    return Column("text")


def bool_() -> Column:
    return Column("bool")


def int_() -> Column:
    return Column("int")


def bigint() -> Column:
    return Column("bigint")


def double() -> Column:
    return Column("double")


def float_() -> Column:
    return Column("float")


def date() -> Column:
    return Column("date")


def timestamp(tz: bool = True) -> Column:
    return Column("timestamp" if tz else "timestamp_ntz")


def uuid(version: int = 7) -> Column:
    if version not in (4, 7):
        raise SchemaError("uuid version must be 4 or 7")
    return Column("uuid", {"version": version})


def json() -> Column:
    return Column("json")


def jsonb() -> Column:
    return Column("jsonb")


def decimal(precision: int | None = None, scale: int | None = None) -> Column:
    return Column("decimal", {} if precision is None else {"precision": precision, "scale": scale or 0})


numeric = decimal


def serial() -> Column:
    return Column("serial", nullable=False)


def enum(*values: str, mode: str | None = None, name: str | None = None) -> Column:
    """``mode``: ``check`` and ``native`` test values on every write, ``union`` leaves them unchecked."""
    if not values:
        raise SchemaError("enum requires at least one value")
    if mode not in (None, "check", "union", "native"):
        raise SchemaError(f"Unknown enum mode: {mode}")
    return Column("enum", {"values": list(values)} | ({"mode": mode} if mode else {}) | ({"name": name} if name else {}))


def bytea() -> Column:
    return Column("bytea")


def text_array() -> Column:
    return Column("textArray")


def int_array() -> Column:
    return Column("intArray")


def array(of: str) -> Column:
    return Column("array", {"of": of})


def citext() -> Column:
    return Column("citext")


def geometry(subtype: str | None = None, srid: int = 4326) -> Column:
    return Column("geometry", {"subtype": subtype, "srid": srid})


def geography(subtype: str | None = None, srid: int = 4326) -> Column:
    return Column("geography", {"subtype": subtype, "srid": srid})


def point(srid: int = 4326) -> Column:
    return Column("point", {"srid": srid})


def fk(target: str, as_: str | None = None, inverse: str | None = None, unique: bool = False, nullable: bool = True, on_delete: str = "no action") -> Column:
    """``target`` is ``table`` or ``table.column``; ``as_`` names the relation, ``inverse`` the one that leads back."""
    if on_delete not in ON_DELETE:
        raise SchemaError(f"Unknown on_delete action: {on_delete}")
    return Column("fk", nullable=nullable, is_unique=unique, target=target, relation=as_, inverse=inverse, on_delete=on_delete)


@dataclasses.dataclass(frozen=True)
class Extra:
    kind: str
    columns: tuple[str, ...] = ()
    name: str | None = None

    def on(self, *columns: str) -> Extra:
        return dataclasses.replace(self, columns=columns)


def index(*columns: str, name: str | None = None) -> Extra:
    return Extra("index", columns, name)


def unique(*columns: str, name: str | None = None) -> Extra:
    return Extra("unique", columns, name)


def primary_key(*columns: str) -> Extra:
    return Extra("primary", columns)


@dataclasses.dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, Column]
    extras: tuple[Extra, ...] = ()
    naming: str | None = None


def table(name: str, /, *extras: Extra, naming: str | None = None, columns: dict[str, Column] | None = None, **named: Column) -> Table:
    """``columns`` takes those whose names are not Python identifiers."""
    return Table(name, {**(columns or {}), **named}, extras, naming)


@dataclasses.dataclass(frozen=True)
class Link:
    left: str
    right: str
    through: str
    as_: str
    inverse: str
    left_relation: str | None = None
    right_relation: str | None = None


def many_to_many(left: str, right: str, through: str, as_: str, inverse: str, left_relation: str | None = None, right_relation: str | None = None) -> Link:
    """``left.as_`` lists rows of ``right`` and ``right.inverse`` those of ``left``, over the rows of ``through``."""
    return Link(left, right, through, as_, inverse, left_relation, right_relation)


def snake_case(name: str) -> str:
    return re.sub(r"([A-Z])", r"_\1", name).lstrip("_").lower()


def camel_case(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m[1].upper(), name)


@dataclasses.dataclass(frozen=True)
class Schema:
    tables: dict[str, Table]
    links: tuple[Link, ...] = ()
    naming: str = "snakeCase"
    enum_mode: str = "check"
    extensions: tuple[str, ...] = ()

    def storage_name(self, t: Table, name: str, c: Column) -> str:
        """A mapped name first, then the table's naming, then the schema's."""
        if c.storage:
            return c.storage
        naming = t.naming or self.naming
        if naming not in ("snakeCase", "camelCase"):
            raise SchemaError(f"Unknown naming: {naming}")
        return name if naming == "camelCase" else snake_case(name)

    def redundant_maps(self) -> list[str]:
        """Warnings for ``map`` calls that only repeat what the naming gives."""
        return [f"{key}.{n}: map({c.storage!r}) is what the naming gives anyway" for key, t in self.tables.items() for n, c in t.columns.items() if c.storage and c.storage == self.storage_name(t, n, dataclasses.replace(c, storage=None))]

    def to_manifest(self) -> Manifest:
        declared = {}
        for key, t in self.tables.items():
            storage = {n: self.storage_name(t, n, c) for n, c in t.columns.items()}
            columns = []
            for n, c in t.columns.items():
                if c.touched and c.kind not in ("timestamp", "timestamp_ntz"):
                    raise SchemaError(f"updated_at is only for timestamp columns: {key}.{n}")
                options = dict(c.options)
                if c.kind == "enum":
                    options.setdefault("mode", self.enum_mode)
                columns.append(ColumnDef(n, storage[n], c.kind, options, c.nullable, c.is_unique, c.is_primary, c.default_value, c.now, c.touched, c.target, c.relation, c.inverse, c.on_delete))
            for e in t.extras:
                for n in e.columns:
                    if n not in storage:
                        raise SchemaError(f"Unknown column in extras of {key}: {n}")
            composite = next((e.columns for e in t.extras if e.kind == "primary"), None)
            indexes = [Index(e.name or f"{t.name}_{'_'.join(storage[n] for n in e.columns)}_{'key' if e.kind == 'unique' else 'idx'}", [storage[n] for n in e.columns], e.kind == "unique") for e in t.extras if e.kind != "primary"]
            keys = [storage[n] for n in composite] if composite else [c.storage for c in columns if c.primary]
            declared[key] = (t.name, columns, keys, indexes)
        links = [ManyToMany(x.left, x.right, x.through, x.as_, x.inverse, x.left_relation, x.right_relation) for x in self.links]
        return build(declared, links, list(self.extensions))


def define_schema(*links: Link, naming: str = "snakeCase", enum_mode: str = "check", extensions: tuple[str, ...] = (), **tables: Table) -> Schema:
    return Schema(dict(tables), links, naming, enum_mode, tuple(extensions))
