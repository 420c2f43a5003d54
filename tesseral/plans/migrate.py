"""Migrations: written from a schema's changes, applied to a store, undone, and listed in its ledger.

A migration is a folder with the manifests before and after it and its changes as JSON. Applying one rewrites the
files of the tables that it touches, and commits data, manifest and ledger at once."""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MigrationError
from ..operators.constraints import check_rows, check_unique
from ..operators.predicate import escaped, literal
from ..schema import Schema
from ..sources.store import Transaction, VersionedStore
from .diff import Change, Danger, diff, explain, outcome, resolve_dangers
from .introspect import model_source
from .manifest import Manifest, TableDef


def digest(manifest: Manifest) -> str:
    """16 hex digits that name a manifest's content."""
    return hashlib.sha256(manifest.to_json().encode()).hexdigest()[:16]


def safe_name(name: str) -> str:
    out = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    if not out:
        raise MigrationError(f"Invalid migration name: {name!r}")
    return out[:80]


@dataclasses.dataclass
class Generated:
    state: str
    reasons: list[str]
    name: str | None
    blocked: list[Danger]
    changes: list[str]


def partly(old: Manifest, new: Manifest, allowed: list[Change], all_changes: list[Change]) -> Manifest:
    """The new manifest without what is held back."""
    held = [c for c in all_changes if c not in allowed]
    out = new.copy()
    for c in held:
        was = old.by_storage(c.table)
        now = out.by_storage(c.table)
        if c.kind == "drop_table":
            out.tables[was.accessor] = was
        elif c.kind in ("drop_column", "alter_column", "drop_fk"):
            column = was.stored(c.detail["column"]) or next(x for x in was.columns if x.name == now.stored(c.detail["column"]).name)
            kept = dataclasses.replace(column, storage=c.detail["column"])
            at = next((i for i, x in enumerate(now.columns) if x.storage == c.detail["column"]), None)
            if at is None:
                now.columns.append(kept)
            else:
                now.columns[at] = kept
        elif c.kind == "drop_index":
            now.indexes.append(next(i for i in was.indexes if i.name == c.detail["name"]))
        elif c.kind == "alter_primary_key":
            now.primary_key = was.primary_key
    return out


class Migrations:
    """The folder of migrations on the driver's file system."""

    def __init__(self, folder: str):
        self.folder = folder

    def names(self) -> list[str]:
        return sorted(n for n in os.listdir(self.folder) if os.path.isdir(os.path.join(self.folder, n))) if os.path.isdir(self.folder) else []

    def _read(self, *parts: str) -> str | None:
        path = os.path.join(self.folder, *parts)
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            return f.read()

    def _write(self, text: str, *parts: str) -> None:
        path = os.path.join(self.folder, *parts)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)

    def snapshot(self) -> Manifest | None:
        text = self._read("snapshot.json")
        return Manifest.from_json(text) if text else None

    def after(self, name: str) -> Manifest:
        text = self._read(name, "snapshot.after.json")
        if text is None:
            raise MigrationError(f"Migration {name} has no snapshot")
        return Manifest.from_json(text)

    def before(self, name: str) -> Manifest:
        text = self._read(name, "snapshot.before.json")
        if text is None:
            raise MigrationError(f"Migration {name} can't be undone: it has no snapshot.before.json")
        return Manifest.from_json(text)

    def generate(self, schema: Schema | Manifest, name: str = "migration", accept_data_loss: bool = False, at: dt.datetime | None = None) -> Generated:
        """Write a migration for what has changed since the snapshot, if it may be applied."""
        new = schema.to_manifest() if isinstance(schema, Schema) else schema
        old = self.snapshot()
        changes = diff(old or Manifest({}), new)
        allowed, blocked = resolve_dangers(changes, accept_data_loss)
        written = None
        target = partly(old or Manifest({}), new, allowed, changes) if blocked else new
        if allowed:
            stamp = (at or dt.datetime.now(dt.UTC)).strftime("%Y%m%d%H%M%S")
            written = f"{stamp}_{safe_name(name)}"
            self._write((old or Manifest({})).to_json(), written, "snapshot.before.json")
            self._write(target.to_json(), written, "snapshot.after.json")
            self._write(json.dumps([dataclasses.asdict(c) for c in allowed], indent=2, default=str), written, "migration.json")
            self._write(json.dumps([dataclasses.asdict(c) for c in diff(target, old or Manifest({}))], indent=2, default=str), written, "down.json")
        state, reasons = outcome(old, new, blocked, written)
        if state != "unchanged" and (written or not blocked):
            self._write(target.to_json(), "snapshot.json")
            self._write(model_source(target), "models.py")
        return Generated(state, reasons, written, blocked, explain(allowed))


class Migrator:
    def __init__(self, store: VersionedStore, migrations: Migrations | None = None):
        self.store, self.migrations = store, migrations

    def live(self, tx: Transaction | None = None) -> Manifest:
        text = (tx.now if tx else self.store.state()).notes.get("manifest")
        return Manifest.from_json(text) if text else Manifest({})

    def applied(self) -> list[str]:
        return [e["name"] for e in self.store.state().notes.get("migrations", [])]

    def status(self) -> dict[str, list[str]]:
        done = self.applied()
        names = self.migrations.names()
        return {"applied": done, "pending": [n for n in names if n not in done], "missing": [n for n in done if n not in names]}

    def deploy(self) -> list[str]:
        """Apply all pending migrations in order, each in a commit."""
        pending = self.status()["pending"]
        for name in pending:
            tx = Transaction(self.store)
            self._move(tx, self.migrations.after(name))
            entry = {"name": name, "hash": digest(self.migrations.after(name)), "at": dt.datetime.now(dt.UTC).isoformat()}
            tx.now.notes["migrations"] = [*tx.now.notes.get("migrations", []), entry]
            tx.commit()
        return pending

    def down(self, steps: int = 1) -> list[str]:
        """Undo the last ``steps`` migrations."""
        if isinstance(steps, bool) or not isinstance(steps, int) or steps < 1:
            raise MigrationError("steps must be a positive integer")
        done = self.applied()
        if not done:
            raise MigrationError("No migration has been applied")
        if steps > len(done):
            raise MigrationError(f"Only {len(done)} migrations have been applied")
        names = done[::-1][:steps]
        for name in names:
            self.migrations.before(name)  # all must be there before the first is undone
        for name in names:
            tx = Transaction(self.store)
            self._move(tx, self.migrations.before(name))
            tx.now.notes["migrations"] = [e for e in tx.now.notes["migrations"] if e["name"] != name]
            tx.commit()
        return names

    def reset(self, force: bool = False) -> list[str]:
        """Drop all tables and apply every migration again."""
        if not force:
            raise MigrationError("reset deletes all data: give force")
        tx = Transaction(self.store)
        tx.now.files, tx.now.numbers, tx.now.notes = {}, {}, {}
        tx.commit()
        return self.deploy() if self.migrations else []

    def push(self, schema: Schema | Manifest, accept_data_loss: bool = False) -> tuple[list[str], list[Danger]]:
        """Bring the store to the schema without a migration. Returns what was done and what was held back."""
        new = schema.to_manifest() if isinstance(schema, Schema) else schema
        tx = Transaction(self.store)
        changes = diff(self.live(tx), new)
        allowed, blocked = resolve_dangers(changes, accept_data_loss)
        self._move(tx, partly(self.live(tx), new, allowed, changes) if blocked else new)
        tx.commit()
        return explain(allowed), blocked

    def _move(self, tx: Transaction, new: Manifest) -> None:
        old = self.live(tx)
        was = {t.storage: t for t in old.tables.values()}
        for storage in was.keys() - {t.storage for t in new.tables.values()}:
            tx.now.files.pop(storage, None)
            tx.now.numbers = {k: v for k, v in tx.now.numbers.items() if not k.startswith(f"{storage}.")}
        for t in new.tables.values():
            if t.storage in was:
                self._rewrite(tx, was[t.storage], t)
            else:
                tx.now.files.setdefault(t.storage, [])
        tx.now.notes["manifest"] = new.to_json()

    def _rewrite(self, tx: Transaction, old: TableDef, new: TableDef) -> None:
        files = tx.store.files_of(tx.now, old)
        same_data = [(c.storage, c.data_type) for c in old.columns] == [(c.storage, c.data_type) for c in new.columns]
        if not files:
            return
        rows = tx.store.frame(old, files)
        if not same_data:
            rows = self._reshaped(rows, old, new)
            files = tx.store.write(new, rows)
            rows = tx.store.frame(new, files)
        check_rows(new, rows)
        stricter = [s for s in new.unique_sets() if s not in old.unique_sets()]
        if stricter:
            check_unique(new, rows, None, {c for s in stricter for c in s})
        tx.now.files[new.storage] = files

    def _reshaped(self, rows: DataFrame, old: TableDef, new: TableDef) -> DataFrame:
        out = []
        for c in new.columns:
            source = old.stored(c.storage) or (o if (o := old.column(c.name)) is not None and new.stored(o.storage) is None else None)
            if source is None:
                value = F.current_timestamp() if c.default_now else literal(c.default, c) if c.has_default else F.lit(None)
            else:
                value = F.col(escaped(source.storage))
            out.append(value.cast(c.data_type).alias(c.storage))
        return rows.select(*out)
