"""Eager loading: an include tree becomes STRUCT and ARRAY<STRUCT> columns of one lazy DataFrame.

Each relation is built from its leaves up, aggregated by the key that leads to the parent, and joined once; so
siblings never multiply each other, every limit is per parent, and the whole tree is one Spark job."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SchemaError, UnknownColumnError
from ..functions.kinds import kind_of
from ..plans.manifest import ColumnDef, Relation, TableDef
from .predicate import Scope, escaped


def projected(c: ColumnDef, column: Column) -> Column:
    """A column as the API shows it: its kind's select expression, and its API name."""
    special = kind_of(c.type_kind).select
    return (special(column, c.options) if special else column).alias(c.name)


def chosen(table: TableDef, select: Any) -> list[ColumnDef]:
    """Columns by a list of names or ``{name: true}``; unknown names are left out, none at all means all."""
    if not select:
        return table.columns
    names = [n for n, on in select.items() if on] if isinstance(select, dict) else list(select)
    return [c for n in names if (c := table.column(n)) is not None] or table.columns


def ordering(column: Column, direction: str) -> Column:
    """Nulls last going up, first going down."""
    return column.desc_nulls_first() if str(direction).lower() == "desc" else column.asc_nulls_last()


def order_columns(table: TableDef, order_by: dict | list | None, column) -> list[Column]:
    out = []
    for part in order_by if isinstance(order_by, (list, tuple)) else [order_by or {}]:
        for name, direction in part.items():
            if name == "_count":
                out += [ordering(F.col(escaped(count_name(rel))), d) for rel, d in direction.items()]
                continue
            c = table.column(name)
            if c is None:
                raise UnknownColumnError(f"Unknown orderBy column: {name}")
            out.append(ordering(column(c), direction))
    return out


def count_name(relation: str) -> str:
    return f"__count_{relation}"


def checked_amount(value: Any, name: str = "limit") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise SchemaError(f"{name} must be a non-negative integer")
    return value


class Includer:
    def __init__(self, scope: Scope):
        self.scope = scope

    def relation_of(self, table: TableDef, name: str) -> Relation:
        if name not in table.relations:
            raise UnknownColumnError(f"Unknown relation on {table.accessor}: {name}")
        return table.relations[name]

    def wanted(self, table: TableDef, include: dict | None) -> dict[str, dict]:
        out = {}
        for name, spec in (include or {}).items():
            if name != "_count" and spec:
                self.relation_of(table, name)
                out[name] = spec if isinstance(spec, dict) else {}
        return out

    def counts(self, df: DataFrame, table: TableDef, spec: dict, key) -> DataFrame:
        """``df`` with a column for the number of related rows of each relation in ``spec``."""
        for name, want in (spec or {}).items():
            if not want:
                continue
            relation = self.relation_of(table, name)
            where = want.get("where") if isinstance(want, dict) else None
            target = self.scope.manifest.table(relation.target)
            rows, alias = self.scope.aliased(target)
            condition = self.scope.where(target, alias, where)
            if relation.kind == "m2m":
                links, via = self.scope.aliased(self.scope.manifest.table(relation.through))
                if condition is not None:
                    rows = links.join(rows, F.col(f"{via}.{escaped(relation.through_remote)}") == F.col(f"{alias}.{escaped(relation.remote)}")).where(condition)
                else:
                    rows = links
                by = F.col(f"{via}.{escaped(relation.through_local)}")
            else:
                rows = rows if condition is None else rows.where(condition)
                by = F.col(f"{alias}.{escaped(relation.remote)}")
            tally = rows.where(by.isNotNull()).groupBy(by.alias("__key")).agg(F.count("*").alias("__n"))
            joined = df.join(tally, key(relation.local) == tally["__key"], "left")
            df = joined.select(*[df[escaped(c)] for c in df.columns], F.coalesce(tally["__n"], F.lit(0)).alias(count_name(name)))
        return df

    def attach(self, df: DataFrame, table: TableDef, include: dict | None, key, limited: bool = False) -> DataFrame:
        """``df`` with one column for each included relation; ``key`` gives a parent column by storage name.

        With ``limited`` few parents are left, and children are cut down to theirs before anything is built."""
        for name, spec in self.wanted(table, include).items():
            relation = self.relation_of(table, name)
            keys = df.select(key(relation.local).alias("__parent")).distinct() if limited else None
            related = self.loaded(relation, spec, keys)
            joined = df.join(related, key(relation.local) == related["__key"], "left")
            value = related["__value"]
            if relation.cardinality == "many":
                value = F.coalesce(value, F.array().cast(related.schema["__value"].dataType))
            df = joined.select(*[df[escaped(c)] for c in df.columns], value.alias(name))
        return df

    def loaded(self, relation: Relation, spec: dict, keys: DataFrame | None) -> DataFrame:
        """(__key, __value): what each parent key gets."""
        target = self.scope.manifest.table(relation.target)
        rows, alias = self.scope.aliased(target)
        at = lambda c: F.col(f"{alias}.{escaped(c.storage if isinstance(c, ColumnDef) else c)}")
        condition = self.scope.where(target, alias, spec.get("where"))
        rows = rows if condition is None else rows.where(condition)
        by = at(relation.remote)
        if relation.kind == "m2m":
            links, via = self.scope.aliased(self.scope.manifest.table(relation.through))
            rows = links.join(rows, F.col(f"{via}.{escaped(relation.through_remote)}") == at(relation.remote))
            by = F.col(f"{via}.{escaped(relation.through_local)}")
        if keys is not None:
            rows = rows.join(keys, by == keys["__parent"], "left_semi")
        shown = chosen(target, spec.get("select"))
        order = order_columns(target, spec.get("orderBy") or spec.get("order_by"), at)
        order += [at(c).asc_nulls_last() for c in target.key_columns]
        order = order or [at(c).asc_nulls_last() for c in target.columns if c.data_type.simpleString() not in ("variant",)]
        limit = spec.get("limit", spec.get("take"))
        single = relation.cardinality == "one"
        rank = None if relation.kind == "owner" else F.row_number().over(W.partitionBy(by).orderBy(*order))
        flat = rows.where(by.isNotNull()).select(by.alias("__key"), *([rank.alias("__rank")] if rank is not None else []), *[projected(c, at(c)) for c in shown], *[at(c).alias(f"__s_{c.storage}") for c in target.columns])
        if single and rank is not None:
            flat = flat.where("__rank = 1")
        elif limit is not None and not single:
            flat = flat.where(F.col("__rank") <= checked_amount(limit))
        nested = spec.get("with") or spec.get("include")
        names = [c.name for c in shown]
        if nested:
            key = lambda storage: F.col(escaped(f"__s_{storage}"))
            if nested.get("_count"):
                flat = self.counts(flat, target, nested["_count"], key)
            flat = self.attach(flat, target, nested, key)
            names += list(self.wanted(target, nested))
        fields = [F.col(escaped(n)) for n in names]
        if nested and nested.get("_count"):
            fields.append(counted_struct(nested["_count"]))
        payload = F.struct(*fields)
        if single:
            return flat.select("__key", payload.alias("__value"))
        gathered = flat.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__rank", payload.alias("row")))).alias("__rows")) if orderable(flat, names) else flat.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__rank", payload.alias("row"))), lambda a, b: a["__rank"] - b["__rank"]).alias("__rows"))
        return gathered.select("__key", F.transform("__rows", lambda r: r["row"]).alias("__value"))


def orderable(df: DataFrame, names: list[str]) -> bool:
    """Whether structs of these columns can be compared; a map or variant can't."""
    text = " ".join(df.schema[n].dataType.simpleString() for n in names)
    return "map<" not in text and "variant" not in text


def counted_struct(spec: dict) -> Column:
    return F.struct(*[F.col(escaped(count_name(n))).alias(n) for n, on in spec.items() if on]).alias("_count")
