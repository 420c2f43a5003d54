"""What changes from one manifest to another, how dangerous that is, and how to say it."""

from __future__ import annotations

import dataclasses
from typing import Any

from .manifest import UNSET, ColumnDef, Manifest, TableDef

#: Kinds of changes that can lose data.
DESTRUCTIVE = ("drop_table", "drop_column", "alter_column_type", "alter_column_type_manual", "alter_enum_manual", "drop_index", "drop_fk", "alter_primary_key")
#: Of these, the ones that no flag lets pass: someone has to write the migration.
MANUAL = ("alter_column_type_manual", "alter_enum_manual")
#: Type changes that a cast can do, by Spark's names, in either direction.
CASTS = [{"string", "int"}, {"string", "bigint"}, {"string", "boolean"}, {"string", "decimal"}, {"timestamp", "timestamp_ntz"}, {"int", "bigint"}, {"float", "double"}]


@dataclasses.dataclass
class Change:
    kind: str
    table: str
    detail: dict[str, Any] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Danger:
    kind: str
    table: str
    detail: str

    def __str__(self) -> str:
        words = {"drop_table": "drops the table", "drop_column": "drops column", "alter_column_type": "casts column", "alter_column_type_manual": "can't cast column", "alter_enum_manual": "takes values from enum column", "drop_index": "drops index", "drop_fk": "drops foreign key", "alter_primary_key": "changes the primary key"}
        return f"{self.table}: {words[self.kind]} {self.detail}".rstrip()


def castable(old: str, new: str) -> bool:
    """Whether one cast takes all values of a type to another, or fails on the value that it can't."""
    plain = lambda t: "decimal" if t.startswith("decimal") else t.split(" ")[0]
    return plain(old) == plain(new) or {plain(old), plain(new)} in CASTS


def _type(c: ColumnDef) -> str:
    return c.data_type.simpleString()


def _default(c: ColumnDef) -> Any:
    return None if c.default is UNSET or c.default == UNSET else c.default


def diff(old: Manifest, new: Manifest) -> list[Change]:
    """Changes in the order in which they can be applied: new tables, columns, keys, then what goes."""
    out: list[Change] = []
    for extension in sorted(set(new.extensions) - set(old.extensions)):
        out.append(Change("create_extension", "", {"name": extension}))
    was = {t.storage: t for t in old.tables.values()}
    now = {t.storage: t for t in new.tables.values()}
    for name in sorted(now.keys() - was.keys()):
        out.append(Change("create_table", name, {"columns": [c.storage for c in now[name].columns]}))
    for name in sorted(now.keys() & was.keys()):
        out += _table(was[name], now[name])
    for name in sorted(was.keys() - now.keys()):
        out.append(Change("drop_table", name))
    return out


def _table(old: TableDef, new: TableDef) -> list[Change]:
    out, gone = [], []
    name = new.storage
    before = {c.storage: c for c in old.columns}
    after = {c.storage: c for c in new.columns}
    renamed = {}
    for c in new.columns:
        if c.storage not in before:
            same = next((o for o in old.columns if o.name == c.name and o.storage not in after), None)
            if same is not None:
                renamed[same.storage] = c.storage
                out.append(Change("rename_column", name, {"from": same.storage, "to": c.storage}))
                before[c.storage] = same
            else:
                out.append(Change("add_column", name, {"column": c.storage, "type": _type(c), "nullable": not c.required}))
    for c in old.columns:
        if c.storage not in after and c.storage not in renamed:
            gone.append(Change("drop_column", name, {"column": c.storage}))
    for c in new.columns:
        o = before.get(c.storage)
        if o is None:
            continue
        alter: dict[str, Any] = {}
        if _type(o) != _type(c):
            alter["type"] = [_type(o), _type(c)]
        if o.required != c.required and not c.primary and not o.primary:
            alter["nullable"] = not c.required
        if _default(o) != _default(c) or o.default_now != c.default_now:
            alter["default"] = [_default(o), _default(c)]
        if o.unique != c.unique:
            alter["unique"] = c.unique
        if o.kind == c.kind == "enum" and (o.options.get("values") != c.options.get("values") or o.options.get("mode") != c.options.get("mode")):
            alter["enum"] = [o.options.get("values"), c.options.get("values")]
        if o.updated_at != c.updated_at:
            alter["updated_at"] = c.updated_at
        if alter:
            out.append(Change("alter_column", name, {"column": c.storage, **alter}))
        if c.kind == "fk" and o.kind == "fk" and (o.fk_target, o.on_delete) != (c.fk_target, c.on_delete):
            out.append(Change("change_fk", name, {"column": c.storage, "target": c.fk_target, "on_delete": c.on_delete}))
        elif c.kind == "fk" and o.kind != "fk":
            out.append(Change("add_fk", name, {"column": c.storage, "target": c.fk_target, "on_delete": c.on_delete}))
        elif o.kind == "fk" and c.kind != "fk":
            gone.append(Change("drop_fk", name, {"column": c.storage}))
    if [renamed.get(k, k) for k in old.primary_key] != new.primary_key:
        out.append(Change("alter_primary_key", name, {"from": old.primary_key, "to": new.primary_key}))
    signature = lambda i, names: (i.unique, tuple(names.get(c, c) for c in i.columns))
    had = {i.name: signature(i, renamed) for i in old.indexes}
    has = {i.name: signature(i, {}) for i in new.indexes}
    for index in new.indexes:
        if had.get(index.name) != has[index.name]:
            out.append(Change("add_index", name, {"name": index.name, "columns": index.columns, "unique": index.unique}))
    for index in old.indexes:
        if has.get(index.name) != had[index.name]:
            gone.append(Change("drop_index", name, {"name": index.name}))
    return out + gone


def dangers(changes: list[Change]) -> list[Danger]:
    out = []
    for c in changes:
        if c.kind == "alter_column":
            column = c.detail["column"]
            if "type" in c.detail:
                old, new = c.detail["type"]
                out.append(Danger("alter_column_type" if castable(old, new) else "alter_column_type_manual", c.table, f"{column} from {old} to {new}"))
            if "enum" in c.detail and set(c.detail["enum"][0] or []) - set(c.detail["enum"][1] or []):
                out.append(Danger("alter_enum_manual", c.table, column))
        elif c.kind in DESTRUCTIVE:
            out.append(Danger(c.kind, c.table, str(c.detail.get("column") or c.detail.get("name") or "")))
    return out


def resolve_dangers(changes: list[Change], accept_data_loss: bool = False) -> tuple[list[Change], list[Danger]]:
    """(what may be applied, what is held back). With the flag only what needs a hand stays back."""
    allowed, blocked = [], []
    for c in changes:
        found = dangers([c])
        stopped = [d for d in found if d.kind in MANUAL or not accept_data_loss]
        if stopped:
            blocked += stopped
        else:
            allowed.append(c)
    return allowed, blocked


def explain(changes: list[Change]) -> list[str]:
    """A line for each change."""
    out = []
    for c in changes:
        d = c.detail
        out.append(
            {
                "create_extension": lambda: f"enable extension {d['name']}",
                "create_table": lambda: f"create table {c.table} ({', '.join(d['columns'])})",
                "drop_table": lambda: f"drop table {c.table}",
                "rename_column": lambda: f"rename {c.table}.{d['from']} to {d['to']}",
                "add_column": lambda: f"add {c.table}.{d['column']} {d['type']}{'' if d['nullable'] else ' not null'}",
                "drop_column": lambda: f"drop {c.table}.{d['column']}",
                "alter_column": lambda: f"alter {c.table}.{d['column']}: " + ", ".join(f"{k} {v}" for k, v in d.items() if k != "column"),
                "add_fk": lambda: f"add foreign key {c.table}.{d['column']} to {d['target']} on delete {d['on_delete']}",
                "change_fk": lambda: f"change foreign key {c.table}.{d['column']} to {d['target']} on delete {d['on_delete']}",
                "drop_fk": lambda: f"drop foreign key {c.table}.{d['column']}",
                "alter_primary_key": lambda: f"change primary key of {c.table} from {d['from']} to {d['to']}",
                "add_index": lambda: f"add {'unique ' if d['unique'] else ''}index {d['name']} on {c.table} ({', '.join(d['columns'])})",
                "drop_index": lambda: f"drop index {d['name']} of {c.table}",
            }[c.kind]()
        )
    return out


def outcome(old: Manifest | None, new: Manifest, blocked: list[Danger], written: str | None) -> tuple[str, list[str]]:
    """(state, reasons) of generating: unchanged, migration_created, blocked or snapshot_only."""
    if old is not None and old.to_json() == new.to_json():
        return "unchanged", ["The snapshot is the schema already."]
    if written:
        return "migration_created", [f"Wrote migration {written}.", *[f"Held back (needs a migration by hand): {d}" for d in blocked if d.kind in MANUAL]]
    if blocked:
        return "blocked", [f"Held back: {d}" for d in blocked]
    return "snapshot_only", ["The change needs nothing done to the data; only the snapshot was updated."]
