"""The resolved schema: storage names, Spark types, keys, indexes and the graph of relations."""

from __future__ import annotations

import copy
import dataclasses
import json
from typing import Any

from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.kinds import extensions, kind_of

UNSET = "\0unset"


@dataclasses.dataclass
class ColumnDef:
    name: str
    storage: str
    kind: str
    options: dict = dataclasses.field(default_factory=dict)
    nullable: bool = True
    unique: bool = False
    primary: bool = False
    default: Any = UNSET
    default_now: bool = False
    updated_at: bool = False
    fk_target: str | None = None
    fk_as: str | None = None
    fk_inverse: str | None = None
    on_delete: str = "no action"
    base_kind: str | None = None
    base_options: dict | None = None

    @property
    def type_kind(self) -> str:
        """The kind whose type the column has: a foreign key's is that of its target."""
        return self.base_kind or self.kind

    @property
    def data_type(self) -> T.DataType:
        return kind_of(self.type_kind).spark_type(self.base_options if self.base_kind else self.options)

    @property
    def required(self) -> bool:
        return self.primary or not self.nullable

    @property
    def has_default(self) -> bool:
        return self.default_now or self.default is not UNSET and self.default != UNSET


@dataclasses.dataclass
class Relation:
    """``owner``: this table holds the key. ``inverse``: the target does. ``m2m``: the rows of ``through`` do."""

    name: str
    kind: str
    target: str
    cardinality: str
    local: str
    remote: str
    inverse: str
    on_delete: str = "no action"
    through: str | None = None
    through_local: str | None = None
    through_remote: str | None = None


@dataclasses.dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False


@dataclasses.dataclass
class ManyToMany:
    left: str
    right: str
    through: str
    as_: str
    inverse: str
    left_relation: str | None = None
    right_relation: str | None = None


@dataclasses.dataclass
class TableDef:
    accessor: str
    storage: str
    columns: list[ColumnDef]
    primary_key: list[str]
    indexes: list[Index] = dataclasses.field(default_factory=list)
    relations: dict[str, Relation] = dataclasses.field(default_factory=dict)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    def stored(self, storage: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.storage == storage), None)

    @property
    def key_columns(self) -> list[ColumnDef]:
        return [self.stored(k) for k in self.primary_key]

    @property
    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.storage, c.data_type, True, {"kind": c.kind}) for c in self.columns])

    def unique_sets(self) -> list[list[str]]:
        """Sets of storage columns whose values are unique, the primary key first."""
        sets = [self.primary_key] if self.primary_key else []
        sets += [[c.storage] for c in self.columns if c.unique]
        sets += [i.columns for i in self.indexes if i.unique]
        return [s for i, s in enumerate(sets) if s not in sets[:i]]


@dataclasses.dataclass
class Manifest:
    tables: dict[str, TableDef]
    links: list[ManyToMany] = dataclasses.field(default_factory=list)
    extensions: list[str] = dataclasses.field(default_factory=list)
    version: int = 1

    def table(self, accessor: str) -> TableDef:
        if accessor not in self.tables:
            raise SchemaError(f"Unknown table: {accessor}")
        return self.tables[accessor]

    def by_storage(self, storage: str) -> TableDef | None:
        return next((t for t in self.tables.values() if t.storage == storage), None)

    def enum_types(self) -> dict[str, list[str]]:
        return {c.options.get("name") or f"{t.storage}_{c.storage}": c.options["values"] for t in self.tables.values() for c in t.columns if c.kind == "enum" and c.options.get("mode") == "native"}

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2, sort_keys=True, default=str)

    @staticmethod
    def from_json(text: str) -> Manifest:
        data = json.loads(text)
        tables = {}
        for key, t in data["tables"].items():
            tables[key] = TableDef(t["accessor"], t["storage"], [ColumnDef(**c) for c in t["columns"]], t["primary_key"], [Index(**i) for i in t["indexes"]], {n: Relation(**r) for n, r in t["relations"].items()})
        return Manifest(tables, [ManyToMany(**x) for x in data["links"]], data["extensions"], data["version"])

    def copy(self) -> Manifest:
        return copy.deepcopy(self)

    @staticmethod
    def from_spark(frames: dict[str, Any]) -> Manifest:
        """Introspect DataFrames or StructTypes: kinds from Spark types, no keys."""
        from .introspect import manifest_of

        return manifest_of(frames)


def target_of(manifest: Manifest, column: ColumnDef) -> tuple[TableDef, ColumnDef]:
    """The table and column that a foreign key leads to; without a column it is the target's primary key."""
    name, _, field = (column.fk_target or "").partition(".")
    found = manifest.tables.get(name) or manifest.by_storage(name)
    if found is None:
        raise SchemaError(f"Foreign key {column.name} leads to an unknown table: {column.fk_target}")
    if field:
        hit = found.column(field) or found.stored(field)
    else:
        hit = found.stored(found.primary_key[0]) if len(found.primary_key) == 1 else None
    if hit is None:
        raise SchemaError(f"Invalid foreign key target: {column.fk_target}")
    return found, hit


def build(declared: dict, links: list[ManyToMany], more_extensions: list[str]) -> Manifest:
    """Resolve declared tables {accessor: (storage, columns, key, indexes)} into a manifest, and validate it."""
    tables = {}
    for key, (storage, columns, primary, indexes) in declared.items():
        tables[key] = TableDef(key, storage, columns, primary, indexes)
        for c in columns:
            if c.storage in primary:
                c.primary = True
    manifest = Manifest(tables, links, [])
    names = [t.storage for t in tables.values()]
    for name in names:
        if names.count(name) > 1:
            raise SchemaError(f"Duplicate table name: {name}")
    for t in tables.values():
        stored = [c.storage for c in t.columns]
        for name in stored:
            if stored.count(name) > 1:
                raise SchemaError(f"Duplicate column name in {t.accessor}: {name}")
        for c in t.columns:
            kind_of(c.kind)
    resolve(manifest)
    used = {c.type_kind for t in tables.values() for c in t.columns}
    manifest.extensions = sorted({*more_extensions, *extensions(used)})
    return manifest


def resolve(manifest: Manifest) -> None:
    """Derive foreign-key types and all relations again from the columns and links."""
    for t in manifest.tables.values():
        t.relations = {}
        for c in t.columns:
            if c.kind == "fk":
                seen, at = set(), c
                while at.kind == "fk":
                    if id(at) in seen:
                        raise SchemaError(f"Foreign keys of {t.accessor}.{c.name} run in a circle")
                    seen.add(id(at))
                    _, at = target_of(manifest, at)
                c.base_kind, c.base_options = ("int" if at.kind == "serial" else at.kind), at.options
    for t in manifest.tables.values():
        for c in t.columns:
            if c.kind == "fk" and c.fk_as:
                target, column = target_of(manifest, c)
                t.relations[c.fk_as] = Relation(c.fk_as, "owner", target.accessor, "one", c.storage, column.storage, c.fk_inverse or c.fk_as, c.on_delete)
    for t in manifest.tables.values():
        for c in t.columns:
            if c.kind == "fk" and c.fk_as:
                target, column = target_of(manifest, c)
                name = c.fk_inverse or c.fk_as
                if name not in target.relations:
                    single = [c.storage] in t.unique_sets()
                    target.relations[name] = Relation(name, "inverse", t.accessor, "one" if single else "many", column.storage, c.storage, c.fk_as, c.on_delete)
    for link in manifest.links:
        left, right, through = (manifest.table(x) for x in (link.left, link.right, link.through))

        def side(table: TableDef, relation: str | None, through: TableDef = through) -> tuple[ColumnDef, ColumnDef]:
            for c in through.columns:
                if c.kind == "fk" and (relation is None or c.fk_as == relation) and target_of(manifest, c)[0] is table:
                    return c, target_of(manifest, c)[1]
            raise SchemaError(f"{through.accessor} has no foreign key to {table.accessor} for the link {link.as_}")

        (left_fk, left_key), (right_fk, right_key) = side(left, link.left_relation), side(right, link.right_relation)
        if left is right and left_fk is right_fk:
            raise SchemaError(f"The link {link.as_} needs left_relation and right_relation")
        left.relations[link.as_] = Relation(link.as_, "m2m", right.accessor, "many", left_key.storage, right_key.storage, link.inverse, through=through.accessor, through_local=left_fk.storage, through_remote=right_fk.storage)
        right.relations[link.inverse] = Relation(link.inverse, "m2m", left.accessor, "many", right_key.storage, left_key.storage, link.as_, through=through.accessor, through_local=right_fk.storage, through_remote=left_fk.storage)
