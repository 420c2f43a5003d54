"""The client: one repository for each table, raw SQL, and transactions.

    db = Client(schema, VersionedStore(spark, "/data/app"))
    db.users.create({"email": "a@x", "posts": {"create": [{"title": "one"}]}})
    db.posts.find_many(where={"author": {"email": "a@x"}}, order_by={"title": "asc"}, include={"author": True})

Reads are lazy DataFrames; ``rows`` turns a small one into dictionaries. Writes need a VersionedStore."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame

from .errors import QueryError, SchemaError
from .operators.rawsql import Builder, Fragment, execute, sql
from .operators.read import Reader
from .operators.write import Writer, split_data
from .plans.manifest import Manifest, TableDef
from .schema import Schema
from .sources.catalog import typed
from .sources.store import Transaction, VersionedStore

ISOLATION = ("read uncommitted", "read committed", "repeatable read", "serializable")


class Repository(Reader):
    def __init__(self, client: Client, accessor: str):
        super().__init__(client.manifest, client.read, accessor)
        self.client = client

    def _result(self, row: dict | None, include: dict | None) -> dict | None:
        """A written row in API names, with its relations if any are asked for."""
        if row is None:
            return None
        if include:
            where = {c.name: row[c.storage] for c in self.table.key_columns}
            found = self.rows(self.find_many(where, limit=1, include=include))
            return found[0] if found else None
        from .functions.kinds import kind_of

        return {c.name: kind_of(c.type_kind).present(row[c.storage]) for c in self.table.columns}

    def create(self, data: dict, include: dict | None = None, return_created: bool = True) -> dict:
        with self.client._writing() as w:
            row = w.create(self.table, data)
            if not return_created and not include:
                return {c.name: row[c.storage] for c in self.table.key_columns}
            return self._result(row, include)

    def _plain(self, data: list[dict]) -> list[dict]:
        out = []
        for item in data:
            values, writes = split_data(self.table, item)
            if writes:
                raise SchemaError("createMany does not support nested relation writes")
            out.append(values)
        return out

    def create_many(self, data: list[dict] | DataFrame) -> int:
        """A list of rows, or a DataFrame in API names, which is added without passing the driver."""
        with self.client._writing() as w:
            if isinstance(data, DataFrame):
                return w.insert_bulk(self.table, data)
            return len(w.insert(self.table, self._plain(data)))

    def create_many_and_return(self, data: list[dict]) -> list[dict]:
        with self.client._writing() as w:
            return [self._result(r, None) for r in w.insert(self.table, self._plain(data))]

    def upsert(self, where: dict, create: dict, update: dict, include: dict | None = None) -> dict:
        with self.client._writing() as w:
            return self._result(w.upsert(self.table, self.unique_where(where, "upsert"), create, update)[0], include)

    def find_or_create(self, where: dict, create: dict, include: dict | None = None) -> dict:
        with self.client._writing() as w:
            row, created = w.find_or_create(self.table, self.unique_where(where, "findOrCreate"), create)
            return {"record": self._result(row, include), "created": created}

    def update(self, where: dict, data: dict, include: dict | None = None, return_updated: bool = False) -> dict | None:
        """All matches are updated; gives the first of them, ``{}`` if it isn't asked for, None if there is none."""
        if not where:
            raise SchemaError("Update requires a where clause")
        with self.client._writing() as w:
            keys = [c.storage for c in self.table.key_columns]
            first = w.matching(self.table, where).orderBy(*keys).limit(1).collect() if keys else w.matching(self.table, where).limit(1).collect()
            if not w.update(self.table, where, data) or not first:
                return None
            if not return_updated and not include:
                return {}
            again = w.matching(self.table, {c.name: first[0][c.storage] for c in self.table.key_columns}).limit(1).collect()
            return self._result(again[0].asDict(), include) if again else {}

    def update_by_id(self, key: Any, data: dict, include: dict | None = None, return_updated: bool = False) -> dict | None:
        return self.update(self.key_where(key), data, include, return_updated)

    def update_many(self, data: dict, where: dict | None = None) -> int:
        with self.client._writing() as w:
            return w.update(self.table, where, data)

    def delete(self, where: dict, return_deleted: bool = False, include: dict | None = None) -> dict | None:
        if not where:
            raise SchemaError("Delete requires a where clause")
        with self.client._writing() as w:
            if return_deleted or include:
                found = self.rows(self.find_many(where, limit=1, include=include))
                return found[0] if w.delete_rows(self.table, where) and found else None
            return {} if w.delete_rows(self.table, where) else None

    def delete_by_id(self, key: Any, return_deleted: bool = False, include: dict | None = None) -> dict | None:
        return self.delete(self.key_where(key), return_deleted, include)

    def delete_many(self, where: dict | None = None) -> int:
        with self.client._writing() as w:
            return w.delete_rows(self.table, where)


class Client:
    def __init__(self, schema: Schema | Manifest, source):
        self.manifest = schema.to_manifest() if isinstance(schema, Schema) else schema
        self.source, self.spark = source, source.spark
        self._tx: Transaction | None = None

    def __getattr__(self, name: str) -> Repository:
        if name.startswith("_") or name not in self.manifest.tables:
            raise AttributeError(f"Unknown table: {name}")
        return Repository(self, name)

    def table(self, accessor: str) -> Repository:
        self.manifest.table(accessor)
        return Repository(self, accessor)

    def read(self, table: TableDef) -> DataFrame:
        return self._tx.read(table) if self._tx else self.source.read(table)

    # Raw SQL

    def register_views(self) -> None:
        """Temporary views of all tables, in their storage names."""
        for t in self.manifest.tables.values():
            with contextlib.suppress(Exception):  # a table without data yet has no view
                typed(self.read(t), t).createOrReplaceTempView(t.storage)

    def sql(self, template: str, *values: Any) -> DataFrame:
        """``{}`` binds the next value, or splices a fragment in."""
        self.register_views()
        return execute(self.spark, sql(template, *values))

    def execute(self, query: Fragment | str, params: list | None = None) -> DataFrame:
        """SQL with ``$1``, ``$2`` and so on for the parameters."""
        self.register_views()
        return execute(self.spark, query, params)

    def select_from(self, accessor: str) -> Builder:
        def read(name: str) -> DataFrame:
            t = self.manifest.tables.get(name) or self.manifest.by_storage(name)
            if t is None:
                raise SchemaError(f"Unknown table: {name}")
            return typed(self.read(t), t)

        return Builder(read, accessor)

    # Transactions

    def connect(self) -> None:
        if self._tx:
            raise QueryError("Cannot connect inside a transaction")
        self.spark.sql("SELECT 1").collect()

    def disconnect(self) -> None:
        if self._tx:
            raise QueryError("Cannot disconnect inside a transaction")

    def _begin(self, read_only: bool = False) -> Transaction:
        if not isinstance(self.source, VersionedStore):
            raise QueryError("this source is read-only: writes need a VersionedStore", "25006")
        return Transaction(self.source, read_only)

    @contextlib.contextmanager
    def transaction(self, isolation: str | None = None, read_only: bool = False) -> Iterator[Client]:
        """Commit at the end, roll back on an error. Inside another one it is a savepoint.

        Every level is snapshot isolation, which is at least repeatable read; writers of one store conflict if
        another has committed since they began."""
        if isolation is not None and isolation.lower().replace("_", " ") not in ISOLATION:
            raise SchemaError(f"Unknown isolation level: {isolation}")
        if self._tx is not None:
            if isolation is not None or read_only:
                raise QueryError("Transaction options cannot be used with nested transactions")
            self._tx.save()
            try:
                yield self
            except BaseException:
                self._tx.rollback_to_save()
                raise
            self._tx.release()
            return
        tx = self._tx = self._begin(read_only)
        try:
            yield self
            tx.commit()
        finally:
            self._tx = None

    def batch(self, steps: list[Callable[[Client], Any]], **options) -> list:
        """Steps one after another in one transaction, and what they return."""
        with self.transaction(**options):
            return [step(self) for step in steps]

    @contextlib.contextmanager
    def _writing(self) -> Iterator[Writer]:
        """A statement: inside a transaction a savepoint of its own, else a transaction."""
        with self.transaction():
            self._tx.writable()
            yield Writer(self.manifest, self._tx)


