"""Reads: every query object compiles to one lazy DataFrame in the API's column names."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.kinds import kind_of
from ..plans.manifest import Manifest, TableDef
from ..sources.catalog import typed
from .cursor import Page, cursor_of, cursor_where, decode_cursor, order_spec
from .include import Includer, checked_amount, chosen, counted_struct, order_columns, projected
from .predicate import Scope, escaped


class Reader:
    """Queries on one table. ``read`` gives a table's current DataFrame in storage names."""

    def __init__(self, manifest: Manifest, read, accessor: str):
        self.manifest, self.read, self.table = manifest, read, manifest.table(accessor)

    def _scope(self) -> Scope:
        return Scope(self.manifest, lambda t: typed(self.read(t), t))

    def _filtered(self, scope: Scope, where: dict | None) -> tuple[DataFrame, str]:
        rows, alias = scope.aliased(self.table)
        condition = scope.where(self.table, alias, where)
        return (rows if condition is None else rows.where(condition)), alias

    def stored(self, where: dict | None = None) -> DataFrame:
        """The matching rows in storage names, for writes."""
        return self._filtered(self._scope(), where)[0]

    def find_many(self, where: dict | None = None, order_by: Any = None, limit: int | None = None, offset: int | None = None, distinct: list[str] | None = None, include: dict | None = None, select: Any = None, take: int | None = None, extra: Column | None = None) -> DataFrame:
        """``distinct`` keeps the first row of each combination, in ``order_by``, which must begin with its columns."""
        limit = take if limit is None else limit
        limit = None if limit is None else checked_amount(limit)
        offset = None if offset is None else checked_amount(offset, "offset")
        scope = self._scope()
        includer = Includer(scope)
        rows, alias = self._filtered(scope, where)
        if callable(extra):
            rows = rows.where(extra(alias))
        at = lambda c: F.col(f"{alias}.{escaped(c.storage)}")
        if distinct:
            rows = self._distinct(rows, distinct, order_by, at)
        key = lambda storage: F.col(f"__s_{storage}" if wide else f"{alias}.{escaped(storage)}")
        wide = False
        counts = (include or {}).get("_count")
        by_count = any("_count" in part for part in (order_by if isinstance(order_by, (list, tuple)) else [order_by or {}]))
        wanted = includer.wanted(self.table, include)
        if not wanted and not counts and not by_count:
            ordered = order_columns(self.table, order_by, at)
            rows = self._cut(rows.orderBy(*ordered) if ordered else rows, limit, offset)
            return rows.select(*[projected(c, at(c)) for c in chosen(self.table, select)])
        shown = chosen(self.table, select)
        flat = rows.select(*[projected(c, at(c)) for c in shown], *[at(c).alias(f"__s_{c.storage}") for c in self.table.columns])
        wide = True
        hidden = lambda c: F.col(escaped(f"__s_{c.storage}"))
        needed = dict(counts or {})
        for part in order_by if isinstance(order_by, (list, tuple)) else [order_by or {}]:
            for name in part.get("_count", {}):
                needed.setdefault(name, True)
        late = bool(needed) and not by_count  # counts that don't order are joined to the rows that are left
        if needed and not late:
            flat = includer.counts(flat, self.table, needed, lambda s: F.col(escaped(f"__s_{s}")))
        ordered = order_columns(self.table, order_by, hidden)
        few = limit is not None or offset is not None
        if few:
            if wanted or late:  # the rows that are left stand in the plan more than once, so nothing may be up to chance
                named = {n for part in (order_by if isinstance(order_by, (list, tuple)) else [order_by or {}]) for n in part}
                ordered += [hidden(c).asc_nulls_last() for c in self.table.key_columns if c.name not in named]
            flat = self._cut(flat.orderBy(*ordered) if ordered else flat, limit, offset)
        if late:
            flat = includer.counts(flat, self.table, needed, lambda s: F.col(escaped(f"__s_{s}")))
        flat = includer.attach(flat, self.table, include, lambda s: F.col(escaped(f"__s_{s}")), limited=few)
        if ordered:  # joins don't keep the order
            flat = flat.orderBy(*ordered)
        out = [F.col(escaped(c.name)) for c in shown] + [F.col(escaped(n)) for n in wanted]
        if counts:
            out.append(counted_struct(counts))
        return flat.select(*out)

    @staticmethod
    def _cut(rows: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
        if offset:
            rows = rows.offset(offset)
        return rows if limit is None else rows.limit(limit)

    def _distinct(self, rows: DataFrame, distinct: list[str], order_by: Any, at) -> DataFrame:
        names = [n for part in (order_by if isinstance(order_by, (list, tuple)) else [order_by or {}]) for n in part]
        if not names:
            raise SchemaError("distinct requires orderBy to be given")
        if names[: len(distinct)] != list(distinct):
            raise SchemaError("distinct requires orderBy to start with the same columns")
        by = [at(self.table.column(n)) for n in distinct]
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order_columns(self.table, order_by, at)))
        return rows.withColumn("__rank", rank).where("__rank = 1")

    def find_first(self, where: dict | None = None, order_by: Any = None, include: dict | None = None, distinct: list[str] | None = None, offset: int | None = None, select: Any = None) -> DataFrame:
        return self.find_many(where, order_by, 1, offset, distinct, include, select)

    def unique_where(self, where: dict | None, what: str) -> dict:
        """``where`` if its keys are exactly one of the table's unique sets."""
        keys = set(where or {})
        for columns in self.table.unique_sets():
            names = {self.table.stored(c).name for c in columns}
            if keys == names and all(v is not None and not isinstance(v, dict) for v in where.values()):
                return where
        raise SchemaError(f"{what} requires a unique where: the primary key, a unique column or a unique index")

    def find_unique(self, where: dict, include: dict | None = None, select: Any = None) -> DataFrame:
        return self.find_many(self.unique_where(where, "findUnique"), limit=1, include=include, select=select)

    def key_where(self, key: Any) -> dict:
        names = [c.name for c in self.table.key_columns]
        if not names:
            raise SchemaError(f"Table {self.table.accessor} has no primary key")
        if isinstance(key, dict):
            for n in names:
                if key.get(n) is None:
                    raise SchemaError(f"Missing primary key column: {n}")
            return {n: key[n] for n in names}
        if len(names) > 1:
            raise SchemaError(f"Table {self.table.accessor} has a composite primary key: give its columns")
        return {names[0]: key}

    def find_by_id(self, key: Any, include: dict | None = None, select: Any = None) -> DataFrame:
        return self.find_many(self.key_where(key), limit=1, include=include, select=select)

    def count_frame(self, where: dict | None = None) -> DataFrame:
        return self._filtered(self._scope(), where)[0].agg(F.count("*").alias("__count"))

    def count(self, where: dict | None = None) -> int:
        return self.count_frame(where).first()[0]

    def aggregate_frame(self, where: dict | None = None, _count: bool = False, _avg=None, _sum=None, _min=None, _max=None) -> DataFrame:
        """One row: ``__count``, ``_avg_<column>`` and so on. Unknown columns are left out."""
        rows, alias = self._filtered(self._scope(), where)
        out = [F.count("*").alias("__count")] if _count else []
        for name, function, picked in (("_avg", F.avg, _avg), ("_sum", F.sum, _sum), ("_min", F.min, _min), ("_max", F.max, _max)):
            for key in [k for k, on in picked.items() if on] if isinstance(picked, dict) else picked or []:
                column = self.table.column(key)
                if column is not None:
                    out.append(function(F.col(f"{alias}.{escaped(column.storage)}")).alias(f"{name}_{column.name}"))
        if not out:
            raise SchemaError("aggregate requires at least one selector")
        return rows.agg(*out)

    def aggregate(self, where: dict | None = None, **selectors) -> dict:
        row = self.aggregate_frame(where, **selectors).first().asDict()
        out: dict[str, Any] = {}
        for name, value in row.items():
            if name == "__count":
                out["_count"] = value
            else:
                bucket, _, column = name[1:].partition("_")
                out.setdefault(f"_{bucket}", {})[column] = value
        return out

    def page_frame(self, order_by: dict, take: int, where: dict | None = None, after: dict | str | None = None, include: dict | None = None) -> DataFrame:
        """The page's rows and one more, if there is one."""
        if isinstance(take, bool) or not isinstance(take, int) or take < 1:
            raise SchemaError("paginate requires take to be a positive integer")
        spec = order_spec(self.table, order_by)
        after = decode_cursor(after) if isinstance(after, str) else after
        if after is not None:
            cursor_where("t", spec, after)  # complains before anything is read
        order = {c.name: d for c, d in spec}
        extra = (lambda alias: cursor_where(alias, spec, after)) if after is not None else None
        return self.find_many(where, order, take + 1, include=include, extra=extra)

    def paginate(self, order_by: dict, take: int, where: dict | None = None, after: dict | str | None = None, include: dict | None = None) -> Page:
        rows = self.rows(self.page_frame(order_by, take, where, after, include))  # take + 1 at most
        items = rows[:take]
        more = len(rows) > take
        return Page(items, cursor_of(items[-1], order_spec(self.table, order_by)) if more else None, more)

    def rows(self, df: DataFrame) -> list[dict]:
        """Dictionaries as the API shows them: JSON parsed, decimals as text."""
        present = {c.name: kind_of(c.type_kind).present for c in self.table.columns}
        return [{k: present[k](v) if k in present else v for k, v in r.asDict(recursive=True).items()} for r in df.collect()]
