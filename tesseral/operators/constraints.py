"""Constraints, tested as queries before rows are added: nothing in Parquet enforces them."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.manifest import Manifest, TableDef, target_of
from ..sources.store import Transaction
from .predicate import escaped

NOT_NULL, UNIQUE, FOREIGN_KEY, CHECK = "23502", "23505", "23503", "23514"


def check_rows(table: TableDef, rows: DataFrame) -> None:
    """NOT NULL and enum values, in one pass."""
    tests = []
    for c in table.columns:
        column = F.col(escaped(c.storage))
        if c.required:
            tests.append((NOT_NULL, c, column.isNull()))
        if c.kind == "enum" and c.options.get("mode", "check") != "union":
            tests.append((CHECK, c, ~F.coalesce(column.isin(c.options["values"]), F.lit(True))))
    if not tests:
        return
    found = rows.agg(*[F.max(test.cast("int")).alias(f"t{i}") for i, (_, _, test) in enumerate(tests)]).first()
    for i, (code, c, _) in enumerate(tests):
        if found[f"t{i}"]:
            if code == NOT_NULL:
                raise QueryError(f"null value in column {c.storage} violates not-null constraint", code, table.storage, c.storage)
            raise QueryError(f"value of column {c.storage} is not one of {c.options['values']}", code, table.storage, f"{table.storage}_{c.storage}_check")


def check_unique(table: TableDef, rows: DataFrame, others: DataFrame | None, only: set[str] | None = None) -> None:
    """No two rows alike in a unique set, nor one like any of ``others``; rows with a null in the set don't count."""
    for columns in table.unique_sets():
        if only is not None and not only & set(columns):
            continue
        names = [escaped(c) for c in columns]
        whole = rows.where(reduce(and_, [F.col(n).isNotNull() for n in names])).select(*names)
        twice = whole.groupBy(*names).agg(F.count("*").alias("__n")).where("__n > 1")
        clash = twice if others is None else twice.select(*names).unionByName(whole.join(others.select(*names), columns, "left_semi").select(*names))
        if not clash.isEmpty():
            key = " primary key" if columns == table.primary_key else ""
            raise QueryError(f"duplicate value violates unique{key} constraint on ({', '.join(columns)})", UNIQUE, table.storage, "_".join([table.storage, *columns, "key"]))


def check_references(manifest: Manifest, tx: Transaction, table: TableDef, rows: DataFrame, only: set[str] | None = None) -> None:
    """Every foreign key that is not null leads to a row."""
    for c in table.columns:
        if c.kind != "fk" or only is not None and c.storage not in only:
            continue
        target, key = target_of(manifest, c)
        values = rows.where(F.col(escaped(c.storage)).isNotNull()).select(F.col(escaped(c.storage)).alias("__v")).distinct()
        keys = tx.read(target).select(F.col(escaped(key.storage)).alias("__v"))
        if target is table:
            keys = keys.unionByName(rows.select(F.col(escaped(key.storage)).alias("__v")))
        if not values.join(keys, "__v", "left_anti").isEmpty():
            raise QueryError(f"foreign key {c.storage} leads to no row of {target.storage}", FOREIGN_KEY, table.storage, f"{table.storage}_{c.storage}_fkey")


def any_of(*conditions):
    return reduce(or_, conditions)
