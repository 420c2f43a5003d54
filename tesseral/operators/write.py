"""Writes: inserts, updates, deletes, upserts and nested relation writes on a transaction's tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import QueryError, SchemaError, UnknownColumnError
from ..functions.ids import prefixed_id, prefixed_id_column, uuid_v7, uuid_v7_column
from ..functions.kinds import kind_of
from ..plans.manifest import ColumnDef, Manifest, Relation, TableDef
from ..sources.catalog import typed
from ..sources.store import Transaction
from .constraints import FOREIGN_KEY, check_references, check_rows, check_unique
from .predicate import Scope, escaped, literal

WRITE_OPS = ("delete", "disconnect", "set", "connect", "connectOrCreate", "create")


def split_data(table: TableDef, data: dict) -> tuple[dict, dict]:
    """(column values, relation writes). A relation's value is a write if all its keys are write operations."""
    values, writes = {}, {}
    for key, value in data.items():
        if table.column(key) is not None and not (key in table.relations and _is_write(value)):
            values[key] = value
        elif key in table.relations:
            if not _is_write(value):
                raise SchemaError(f"{key} on {table.accessor} needs one of {', '.join(WRITE_OPS)}")
            writes[key] = value
        else:
            raise UnknownColumnError(f"Unknown key in data of {table.accessor}: {key}")
    return values, writes


def _is_write(value: Any) -> bool:
    return isinstance(value, dict) and bool(value) and all(k in WRITE_OPS for k in value)


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple)) else [value]


class Writer:
    """All writes of one transaction."""

    def __init__(self, manifest: Manifest, tx: Transaction):
        self.manifest, self.tx, self.spark = manifest, tx, tx.store.spark

    # Rows in, rows out

    def fresh_key(self, table: TableDef, c: ColumnDef) -> Any:
        if c.type_kind == "uuid":
            import uuid

            return str(uuid.uuid4()) if (c.base_options or c.options).get("version") == 4 else uuid_v7()
        if c.kind == "id" or c.primary and c.kind == "text":
            return prefixed_id(table.accessor)
        return None

    def completed(self, table: TableDef, values: dict) -> dict:
        """A row in storage names: generated keys, numbers and defaults where a value is missing."""
        row = {}
        for c in table.columns:
            kind = kind_of(c.type_kind)
            value = values.get(c.name)
            if value is not None:
                row[c.storage] = kind.coerce(value)
                if c.kind == "serial":
                    self.tx.seen_number(table, c.storage, row[c.storage])
            elif c.kind == "serial":
                row[c.storage] = self.tx.next_number(table, c.storage)
            elif c.primary:
                row[c.storage] = self.fresh_key(table, c)
            elif c.name in values:
                row[c.storage] = None
            elif c.default_now or c.updated_at and not c.nullable:
                row[c.storage] = self._now(c)
            elif c.has_default:
                row[c.storage] = kind.coerce(c.default)
            else:
                row[c.storage] = None
        return row

    def _now(self, c: ColumnDef) -> Any:
        import datetime as dt

        now = dt.datetime.now(dt.UTC)
        return now.replace(tzinfo=None) if c.type_kind == "timestamp_ntz" else (now.date() if c.type_kind == "date" else now)

    def frame(self, table: TableDef, rows: list[dict]) -> DataFrame:
        df = self.spark.createDataFrame([tuple(r[c.storage] for c in table.columns) for r in rows], table.struct_type)
        out = []
        for c in table.columns:
            write = kind_of(c.type_kind).write
            column = F.col(escaped(c.storage))
            out.append((write(column, c.options) if write else column).alias(c.storage))
        return df.select(*out)

    def insert_frame(self, table: TableDef, df: DataFrame) -> None:
        """Add rows that are complete, after all constraints are tested."""
        self.tx.writable()
        check_rows(table, df)
        check_unique(table, df, self.tx.read(table))
        check_references(self.manifest, self.tx, table, df)
        self.tx.append(table, df)

    def insert(self, table: TableDef, values: list[dict]) -> list[dict]:
        for v in values:
            if not v and not any(c.primary or c.has_default or c.kind == "serial" for c in table.columns):
                raise SchemaError("Cannot build INSERT query with no columns")
        rows = [self.completed(table, v) for v in values]
        if rows:
            self.insert_frame(table, self.frame(table, rows).coalesce(1) if len(rows) < 10_000 else self.frame(table, rows))
        return rows

    def insert_bulk(self, table: TableDef, df: DataFrame) -> int:
        """Add a DataFrame in API names; missing columns get keys, numbers and defaults in Spark, row by row."""
        given = {c.lower(): c for c in df.columns}
        out = []
        for c in table.columns:
            if c.name.lower() in given:
                value = F.col(escaped(given[c.name.lower()])).cast(c.data_type)
                if c.primary and c.type_kind in ("id", "uuid"):
                    value = F.coalesce(value, self._bulk_key(table, c))
            elif c.kind == "serial":
                value = F.lit(None).cast(c.data_type)
            elif c.primary:
                value = self._bulk_key(table, c)
            elif c.default_now:
                value = F.current_timestamp().cast(c.data_type)
            elif c.has_default:
                value = literal(c.default, c)
            else:
                value = F.lit(None).cast(c.data_type)
            out.append(value.alias(c.storage))
        rows = df.select(*out)
        for c in table.columns:
            if c.kind == "serial" and c.name.lower() not in given:
                rows = self._numbered(table, c, rows)
        files = self.tx.store.write(table, rows)  # written first, so that generated values are tested as they stay
        staged = self.tx.store.frame(table, files)
        check_rows(table, staged)
        check_unique(table, staged, self.tx.read(table))
        check_references(self.manifest, self.tx, table, staged)
        self.tx.writable()
        self.tx.now.files.setdefault(table.storage, []).extend(files)
        return staged.count()

    def _bulk_key(self, table: TableDef, c: ColumnDef) -> Column:
        if c.type_kind == "uuid":
            return F.uuid() if (c.base_options or c.options).get("version") == 4 else uuid_v7_column()
        return prefixed_id_column(table.accessor) if c.type_kind == "id" else F.lit(None).cast(c.data_type)

    def _numbered(self, table: TableDef, c: ColumnDef, rows: DataFrame) -> DataFrame:
        """Consecutive numbers: a count for each partition, then numbers inside it; no single task sees all rows."""
        placed = rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
        files = f"{self.tx.store.base}/_staging/{table.storage}-{id(rows):x}-{self.tx.now.number}"
        placed.write.mode("overwrite").parquet(files)
        placed = self.spark.read.parquet(files)
        counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
        first = self.tx.next_number(table, c.storage, sum(n for _, n in counts))
        starts, at = {}, first
        for part, n in counts:
            starts[part] = at
            at += n
        if not starts:
            return rows
        base = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("__part")]
        number = base + F.row_number().over(W.partitionBy("__part").orderBy("__at")) - 1
        return placed.withColumn(c.storage, number.cast(c.data_type)).select(*[escaped(x.storage) for x in table.columns])

    # Matching rows

    def scope(self) -> Scope:
        return Scope(self.manifest, lambda t: typed(self.tx.read(t), t))

    def matching(self, table: TableDef, where) -> DataFrame:
        """Rows in storage names; ``where`` is an object, or a function of (scope, alias) that gives a Column."""
        scope = self.scope()
        rows, alias = scope.aliased(table)
        condition = where(scope, alias) if callable(where) else scope.where(table, alias, where)
        return rows if condition is None else rows.where(condition)

    def _split(self, table: TableDef, where) -> tuple[list[str], int, DataFrame, DataFrame]:
        """(files with matches, number of matches, their matching rows, their other rows)."""
        files = self.tx.store.files_of(self.tx.now, table)
        if not files:
            empty = self.tx.read(table)
            return [], 0, empty, empty

        def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
            scope = self.scope()
            alias = "w"
            condition = where(scope, alias) if callable(where) else scope.where(table, alias, where)
            rows = rows.alias(alias)
            if condition is None:
                return rows, rows.where(F.lit(False))
            return rows.where(condition), rows.where(~F.coalesce(condition, F.lit(False)))

        all_rows = self.tx.store.frame(table, files).withColumn("__file", F.col("_metadata.file_path"))
        found = parts(all_rows)[0].groupBy("__file").agg(F.count("*").alias("n")).collect()
        short = lambda f: tuple(f.rsplit("/", 2)[1:])  # noqa: E731  Spark's names are percent-encoded, but not in these parts
        own = {short(f): f for f in files}
        hit = {own[short(r["__file"])]: r["n"] for r in found}
        if not hit:
            empty = self.tx.read(table).where(F.lit(False))
            return [], 0, empty, empty
        matched, rest = parts(self.tx.store.frame(table, list(hit)))
        return list(hit), sum(hit.values()), matched, rest

    def update_rows(self, table: TableDef, where, changes: dict[str, Any]) -> int:
        """Set storage columns to values or Columns in matching rows; tests only what the changes can break."""
        self.tx.writable()
        files, count, matched, rest = self._split(table, where)
        if not count:
            return 0
        out = []
        for c in table.columns:
            if c.storage in changes:
                value = changes[c.storage]
                value = value if isinstance(value, Column) else literal(value, c)
                out.append(value.cast(c.data_type).alias(c.storage))
            else:
                out.append(F.col(escaped(c.storage)))
        written = self.tx.store.write(table, matched.select(*out))
        changed = self.tx.store.frame(table, written)
        check_rows(table, changed)
        check_references(self.manifest, self.tx, table, changed, set(changes))
        self.tx.replace(table, files, rest)
        check_unique(table, changed, self.tx.read(table), set(changes))
        self.tx.now.files[table.storage].extend(written)
        return count

    def delete_rows(self, table: TableDef, where) -> int:
        """Delete matching rows, and do to those that refer to them what their keys say."""
        self.tx.writable()
        files, count, matched, rest = self._split(table, where)
        if not count:
            return 0
        gone_files = self.tx.store.write(table, matched)  # kept aside for the keys that refer to them
        gone = self.tx.store.frame(table, gone_files)
        self.tx.replace(table, files, rest)
        late = []
        for child in self.manifest.tables.values():
            for c in child.columns:
                if c.kind != "fk":
                    continue
                from ..plans.manifest import target_of

                target, key = target_of(self.manifest, c)
                if target is not table:
                    continue

                def refers(scope: Scope, alias: str, c=c, key=key) -> Column:
                    keys = gone.alias("gone")
                    return keys.where(F.col(f"gone.{escaped(key.storage)}") == F.col(f"{alias}.{escaped(c.storage)}").outer()).exists()

                if c.on_delete == "cascade":
                    self.delete_rows(child, refers)
                elif c.on_delete == "set null":
                    if c.required and not self.matching(child, refers).isEmpty():
                        raise QueryError(f"column {c.storage} can't be set to null", "23502", child.storage, c.storage)
                    self.update_rows(child, refers, {c.storage: None})
                elif c.on_delete == "restrict":
                    self._refuse(child, c, refers)
                else:
                    late.append((child, c, refers))
        for child, c, refers in late:  # "no action" looks at what is left in the end
            self._refuse(child, c, refers)
        return count

    def _refuse(self, child: TableDef, c: ColumnDef, refers) -> None:
        if not self.matching(child, refers).isEmpty():
            raise QueryError("row is still referred to", FOREIGN_KEY, child.storage, f"{child.storage}_{c.storage}_fkey")

    def changes_of(self, table: TableDef, values: dict) -> dict[str, Any]:
        """Storage columns to set: no key columns, and update times always by the clock."""
        out: dict[str, Any] = {}
        for name, value in values.items():
            c = table.column(name)
            if not c.primary and not c.updated_at:
                out[c.storage] = value
        return out

    def touched(self, table: TableDef) -> dict[str, Any]:
        return {c.storage: kind_of(c.type_kind).updated_at() for c in table.columns if c.updated_at}

    # Single records with their relations

    def create(self, table: TableDef, data: dict, fixed: dict | None = None) -> dict:
        """Insert a record, its to-one targets before and everything else after. Returns the row in storage names."""
        values, writes = split_data(table, data)
        values |= {table.stored(k).name: v for k, v in (fixed or {}).items()}
        values |= self.owner_writes(table, writes)
        row = self.insert(table, [values])[0]
        self.other_writes(table, row, writes)
        return row

    def owner_writes(self, table: TableDef, writes: dict) -> dict:
        out = {}
        for name, ops in writes.items():
            relation = table.relations[name]
            if relation.kind != "owner":
                continue
            column = table.stored(relation.local)
            target = self.manifest.table(relation.target)
            if "disconnect" in ops and ops["disconnect"] is not False:
                if column.required:
                    raise SchemaError(f"Cannot disconnect relation {name}: {column.name} is not nullable")
                out[column.name] = None
            for op in ("set", "connect"):
                if op in ops:
                    items = _listed(ops[op])
                    if len(items) != 1:
                        raise SchemaError(f"Cannot connect more than one record to {name}")
                    out[column.name] = self.reference(target, relation.remote, items[0])
            for op in ("connectOrCreate", "create"):
                if op in ops:
                    items = _listed(ops[op])
                    if len(items) != 1:
                        raise SchemaError(f"Cannot create more than one record for {name}")
                    row = self.create(target, items[0]) if op == "create" else self.find_or_create(target, items[0]["where"], items[0]["create"])[0]
                    out[column.name] = row[relation.remote]
        return out

    def reference(self, table: TableDef, storage: str, item: Any) -> Any:
        """The value of a referred column from ``{id: …}``, another unique where, or the bare value."""
        c = table.stored(storage)
        if not isinstance(item, dict):
            return item
        if c.name in item:
            return item[c.name]
        found = self.matching(table, item).select(escaped(storage)).limit(2).collect()
        if len(found) != 1:
            raise QueryError(f"no single record of {table.accessor} to connect", FOREIGN_KEY, table.storage)
        return found[0][0]

    def other_writes(self, table: TableDef, row: dict, writes: dict) -> None:
        for name, ops in writes.items():
            relation = table.relations[name]
            if relation.kind == "inverse":
                self.child_writes(relation, row[relation.local], ops, name)
            elif relation.kind == "m2m":
                self.link_writes(relation, row[relation.local], ops)

    def _ids(self, table: TableDef, items: Any) -> list[dict] | None:
        """Records to act on, or None for all of the parent's."""
        if items is True:
            return None
        out = []
        for item in _listed(items):
            out.append(item if isinstance(item, dict) else {table.key_columns[0].name: item})
        return out

    def child_writes(self, relation: Relation, parent: Any, ops: dict, name: str) -> None:
        child = self.manifest.table(relation.target)
        fk = child.stored(relation.remote)
        single = relation.cardinality == "one"
        whose = {fk.name: parent}

        def of(items: list[dict] | None, own: bool) -> dict:
            where: dict = {"AND": [whose]} if own else {"AND": []}
            if items is not None:
                where["AND"].append({"OR": items} if items else {"NOT": {"OR": [{c.name: {"in": []}} for c in child.columns[:1]] + [{}]}})
            return where

        def let_go(items: list[dict] | None) -> None:
            if fk.required:
                raise SchemaError(f"Cannot disconnect relation {name}: {fk.name} is not nullable")
            if items != []:
                self.update_rows(child, of(items, True), {fk.storage: None} | self.touched(child))

        def take(items: list[dict]) -> None:
            if single and len(items) > 1:
                raise SchemaError(f"Cannot connect more than one record to {name}")
            if items:
                if single and not fk.required:
                    self.update_rows(child, {"AND": [whose, {"NOT": {"OR": items}}]}, {fk.storage: None})
                self.update_rows(child, of(items, False), {fk.storage: parent} | self.touched(child))

        if "delete" in ops and ops["delete"] is not False:
            items = self._ids(child, ops["delete"])
            if items != []:
                self.delete_rows(child, of(items, True))
        if "disconnect" in ops and ops["disconnect"] is not False:
            let_go(self._ids(child, ops["disconnect"]))
        if "set" in ops:
            items = self._ids(child, ops["set"])
            if single:
                items = items[:1]
            if fk.required:
                if not self.matching(child, {"AND": [whose, {"NOT": {"OR": items}}] if items else [whose]}).isEmpty():
                    raise SchemaError(f"Cannot disconnect relation {name}: {fk.name} is not nullable")
            else:
                let_go(None)
            take(items)
            return
        if "connect" in ops:
            take(self._ids(child, ops["connect"]))
        if "connectOrCreate" in ops:
            for item in _listed(ops["connectOrCreate"]):
                found, created = self.find_or_create(child, item["where"], {**item["create"], fk.name: parent})
                if not created:
                    take([{c.name: found[c.storage] for c in child.key_columns}])
        if "create" in ops:
            items = _listed(ops["create"])
            if single and len(items) > 1:
                raise SchemaError(f"Cannot create more than one record for {name}")
            for item in items:
                self.create(child, item, {fk.storage: parent})

    def link_writes(self, relation: Relation, parent: Any, ops: dict) -> None:
        through, target = self.manifest.table(relation.through), self.manifest.table(relation.target)
        mine, other = through.stored(relation.through_local), through.stored(relation.through_remote)
        key = target.stored(relation.remote)

        def values(items: Any) -> list | None:
            found = self._ids(target, items)
            return None if found is None else [self.reference(target, key.storage, i) for i in found]

        def links(ids: list | None) -> dict:
            return {mine.name: parent} if ids is None else {mine.name: parent, other.name: {"in": ids}}

        def link(ids: list) -> None:
            ids = list(dict.fromkeys(ids))
            if not ids:
                return
            have = {r[0] for r in self.matching(through, links(ids)).select(escaped(other.storage)).distinct().collect()}
            self.insert(through, [{mine.name: parent, other.name: i} for i in ids if kind_of(key.type_kind).coerce(i) not in have])

        if "delete" in ops and ops["delete"] is not False:
            ids = values(ops["delete"])
            gone = [r[0] for r in self.matching(through, links(ids)).select(escaped(other.storage)).distinct().collect()]
            self.delete_rows(through, links(ids))
            self.delete_rows(target, {key.name: {"in": gone}})
        if "disconnect" in ops and ops["disconnect"] is not False:
            self.delete_rows(through, links(values(ops["disconnect"])))
        if "set" in ops:
            self.delete_rows(through, links(None))
            link(values(ops["set"]))
            return
        if "connect" in ops:
            link(values(ops["connect"]))
        for item in _listed(ops.get("connectOrCreate", [])):
            link([self.find_or_create(target, item["where"], item["create"])[0][key.storage]])
        for item in _listed(ops.get("create", [])):
            link([self.create(target, item)[key.storage]])

    def find_or_create(self, table: TableDef, where: dict, create: dict) -> tuple[dict, bool]:
        found = self.matching(table, where).limit(1).collect()
        if found:
            return found[0].asDict(), False
        return self.create(table, {**create, **where}), True

    def upsert(self, table: TableDef, where: dict, create: dict, update: dict) -> tuple[dict, bool]:
        """Insert ``create`` with ``where``; if such a row is there, set the columns named in ``update`` to the
        values that the insert had for them, and the update time."""
        found = self.matching(table, where).limit(1).collect()
        if not found:
            return self.create(table, {**create, **where}), True
        values, writes = split_data(table, update)
        planned = self.completed(table, {**split_data(table, create)[0], **where}) if values else {}
        changes = {c.storage: planned[c.storage] for n in values if not (c := table.column(n)).primary and not c.updated_at}
        changes |= self.touched(table) if changes or any(c.updated_at for c in table.columns) else {}
        row = found[0].asDict()
        if changes:
            self.update_rows(table, where, changes)
        self.other_writes(table, row, writes)
        again = self.matching(table, {c.name: row[c.storage] for c in table.key_columns} or where).limit(1).collect()
        return again[0].asDict(), False

    def update(self, table: TableDef, where: dict | None, data: dict) -> int:
        """Columns of all matches, then relation writes for each matching parent."""
        values, writes = split_data(table, data)
        owner = {n: w for n, w in writes.items() if table.relations[n].kind == "owner"}
        rest = {n: w for n, w in writes.items() if n not in owner}
        values |= self.owner_writes(table, owner)
        changes = self.changes_of(table, values)
        if not changes and not writes:
            raise SchemaError("Update requires at least one scalar field or relation write")
        parents = self.matching(table, where).collect() if rest else []  # relation writes name their parents one by one
        count = self.update_rows(table, where, changes | self.touched(table)) if changes else len(parents)
        for parent in parents:
            self.other_writes(table, parent.asDict(), rest)
        return count
