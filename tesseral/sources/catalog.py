"""Where tables come from: Parquet folders, views, JDBC, DataFrames in memory. All are read only."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..plans.manifest import TableDef

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def checked_name(name: str) -> str:
    """A tenant or database name that is safe in a path or a statement."""
    if not _NAME.match(name):
        raise SchemaError(f"Invalid schema name: {name!r}")
    return name


class Source(Protocol):
    """Gives a table as a lazy DataFrame with its storage column names."""

    spark: SparkSession

    def read(self, table: TableDef) -> DataFrame: ...


class ParquetSource:
    """``base/<table>.parquet``, or ``base/<tenant>/<table>.parquet``; a file or a folder each.

    Columns come with the types of the files: nothing is inferred beyond Parquet's own schema, and filters and
    column lists reach the scan."""

    def __init__(self, spark: SparkSession, base: str, tenant: str | None = None, suffix: str = ".parquet"):
        self.spark, self.suffix = spark, suffix
        self.base = f"{base.rstrip('/')}/{checked_name(tenant)}" if tenant else base.rstrip("/")

    def read(self, table: TableDef) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{table.storage}{self.suffix}")


class ViewSource:
    """Tables or views of the session, of a database if one is named."""

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, checked_name(database) if database else None

    def read(self, table: TableDef) -> DataFrame:
        name = table.storage.replace("`", "``")
        return self.spark.table(f"`{self.database}`.`{name}`" if self.database else f"`{name}`")


class MemorySource:
    """DataFrames by storage name; a table that isn't given is empty."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark, self.frames = spark, dict(frames)

    def read(self, table: TableDef) -> DataFrame:
        if table.storage in self.frames:
            return self.frames[table.storage]
        return self.spark.createDataFrame([], table.struct_type)


class JdbcSource:
    """Tables of a database over JDBC; Spark pushes filters and column lists into its queries.

    ``partitions`` maps a table to (column, lower, upper, number) for reading it in parallel."""

    def __init__(self, spark: SparkSession, url: str, properties: dict | None = None, tenant: str | None = None, partitions: dict[str, tuple[str, int, int, int]] | None = None):
        self.spark, self.url, self.properties = spark, url, properties or {}
        self.tenant, self.partitions = checked_name(tenant) if tenant else None, partitions or {}

    def reader(self, table: TableDef):
        name = '"' + table.storage.replace('"', '""') + '"'
        options = {"url": self.url, "dbtable": f'"{self.tenant}".{name}' if self.tenant else name, "fetchsize": "10000", **self.properties}
        if table.storage in self.partitions:
            column, lower, upper, number = self.partitions[table.storage]
            options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(number)}
        return self.spark.read.format("jdbc").options(**options)

    def read(self, table: TableDef) -> DataFrame:
        return self.reader(table).load()


def typed(df: DataFrame, table: TableDef) -> DataFrame:
    """The declared columns in their order, cast where the file's type differs; a missing one is null."""
    have = {f.name.lower(): f for f in df.schema.fields}
    out = []
    for c in table.columns:
        field = have.get(c.storage.lower())
        quoted = "`" + (field.name if field else c.storage).replace("`", "``") + "`"
        column = F.lit(None) if field is None else F.col(quoted)
        out.append((column if field is not None and field.dataType == c.data_type else column.cast(c.data_type)).alias(c.storage))
    return df.select(*out)
