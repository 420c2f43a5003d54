"""Tables that can be written: immutable Parquet files, and numbered commits that list each table's files.

A commit is one small file and covers all tables at once. It is written aside and then renamed to its number, which
fails if another has taken it; so a reader sees a whole commit or none, a lost writer leaves only files that no commit
lists, and two writers can't take the same number. That asks for a file system whose rename is atomic and doesn't
overwrite (HDFS, local disks); object stores need a layer that gives them that. Updates and deletes rewrite only the
files that hold matching rows; inserts add files. A tenant is a folder ``_tenant=<name>`` of the store, with commits of
its own; no table can have such a name."""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConflictError, QueryError
from ..plans.manifest import Manifest, TableDef
from .catalog import checked_name, typed


@dataclasses.dataclass
class State:
    """Files by table and next numbers by ``table.column``, as of a commit."""

    number: int = 0
    files: dict[str, list[str]] = dataclasses.field(default_factory=dict)
    numbers: dict[str, int] = dataclasses.field(default_factory=dict)
    notes: dict = dataclasses.field(default_factory=dict)

    def copy(self) -> State:
        return State(self.number, {k: list(v) for k, v in self.files.items()}, dict(self.numbers), dict(self.notes))


class VersionedStore:
    def __init__(self, spark: SparkSession, base: str, tenant: str | None = None):
        self.spark = spark
        self.base = f"{base.rstrip('/')}/_tenant={checked_name(tenant)}" if tenant else base.rstrip("/")

    def _path(self, path: str):
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm_path

    def _list(self, path: str) -> list[str]:
        fs, p = self._path(path)
        return [str(s.getPath().toString()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _text(self, path: str) -> str:
        fs, p = self._path(path)
        stream = fs.open(p)
        try:
            return str(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def state(self, number: int | None = None) -> State:
        """The latest commit, or an earlier one that is still there."""
        names = sorted(n.rsplit("/", 1)[1] for n in self._list(f"{self.base}/_commits") if n.endswith(".json"))
        if number is not None:
            names = [n for n in names if int(n[:-5]) == number]
        return State(**json.loads(self._text(f"{self.base}/_commits/{names[-1]}"))) if names else State()

    def commit(self, state: State) -> State:
        """Make ``state`` the next commit after the one it was derived from."""
        after = state.copy()
        after.number += 1
        fs, p = self._path(f"{self.base}/_commits/{after.number:020d}.json")
        _, aside = self._path(f"{self.base}/_commits/_{uuid.uuid4().hex}.tmp")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(dataclasses.asdict(after)).encode()))
        stream.close()
        try:
            self._rename(fs, aside, p)
        except Exception as error:
            fs.delete(aside, False)
            if "exist" in str(error).lower():
                raise ConflictError("another writer has committed since this transaction began") from error
            raise
        return after

    def _rename(self, fs, old, new) -> None:
        """Fails if ``new`` is there."""
        java_files = self.spark._jvm.java.nio.file
        if fs.getUri().getScheme() == "file":  # Hadoop's local rename overwrites; a second link to a name is refused
            local = lambda p: java_files.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 0))
            java_files.Files.createLink(local(new), local(old))
            fs.delete(old, False)
        elif not fs.rename(old, new):
            raise FileExistsError(f"{new.toString()} exists")

    def files_of(self, state: State, table: TableDef) -> list[str]:
        return state.files.get(table.storage, [])

    def frame(self, table: TableDef, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], table.struct_type)
        return self.spark.read.schema(table.struct_type).parquet(*files)

    def read(self, table: TableDef) -> DataFrame:
        return self.frame(table, self.files_of(self.state(), table))

    def write(self, table: TableDef, df: DataFrame) -> list[str]:
        """Write rows as new files, which no commit lists yet."""
        folder = f"{self.base}/{table.storage}/data-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return [f for f in self._list(folder) if f.endswith(".parquet")]

    def load(self, manifest: Manifest, frames: dict[str, DataFrame]) -> State:
        """Replace tables by these DataFrames (by accessor, in storage names), in one commit."""
        state = self.state()
        for accessor, df in frames.items():
            table = manifest.table(accessor)
            state.files[table.storage] = self.write(table, typed(df, table))
            for c in table.columns:
                if c.kind == "serial":
                    top = self.frame(table, state.files[table.storage]).agg(F.max(f"`{c.storage}`")).first()[0]
                    state.numbers[f"{table.storage}.{c.storage}"] = (top or 0) + 1
        return self.commit(state)

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that the last ``keep`` commits don't list, and older commits. Returns how many files went.

        Not to be run beside a writer: its files are not listed yet."""
        names = sorted(n for n in self._list(f"{self.base}/_commits") if n.endswith(".json"))
        kept = [State(**json.loads(self._text(n))) for n in names[-keep:]]
        listed = {f.split(self.base, 1)[-1] for s in kept for files in s.files.values() for f in files}
        gone = 0
        for folder in self._list(self.base):
            if folder.rsplit("/", 1)[1].startswith("_"):  # commits, other tenants
                continue
            for data in self._list(folder):
                if not data.rsplit("/", 1)[1].startswith("data-"):
                    continue
                files = [f for f in self._list(data) if f.endswith(".parquet")]
                for f in files:
                    if f.split(self.base, 1)[-1] not in listed:
                        fs, p = self._path(f)
                        gone += bool(fs.delete(p, False))
                if all(f.split(self.base, 1)[-1] not in listed for f in files):
                    fs, p = self._path(data)
                    fs.delete(p, True)
        for n in names[:-keep] + [n for n in self._list(f"{self.base}/_commits") if n.endswith(".tmp")]:
            fs, p = self._path(n)
            fs.delete(p, False)
        return gone


class Transaction:
    """Pending changes over one snapshot. Savepoints are copies of the lists of files."""

    def __init__(self, store: VersionedStore, read_only: bool = False):
        self.store, self.read_only = store, read_only
        self.begun = store.state()
        self.now = self.begun.copy()
        self.saved: list[State] = []

    def read(self, table: TableDef) -> DataFrame:
        return self.store.frame(table, self.store.files_of(self.now, table))

    def writable(self) -> None:
        if self.read_only:
            raise QueryError("cannot write in a read-only transaction", "25006")

    def append(self, table: TableDef, df: DataFrame) -> None:
        self.writable()
        self.now.files.setdefault(table.storage, []).extend(self.store.write(table, df))

    def replace(self, table: TableDef, old: list[str], df: DataFrame | None) -> None:
        """Put rows in the place of some of the table's files."""
        self.writable()
        short = {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in old}
        rest = [f for f in self.now.files.get(table.storage, []) if f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] not in short]
        self.now.files[table.storage] = rest + (self.store.write(table, df) if df is not None else [])

    def next_number(self, table: TableDef, column: str, count: int = 1) -> int:
        key = f"{table.storage}.{column}"
        first = self.now.numbers.get(key, 1)
        self.now.numbers[key] = first + count
        return first

    def seen_number(self, table: TableDef, column: str, value: int) -> None:
        key = f"{table.storage}.{column}"
        self.now.numbers[key] = max(self.now.numbers.get(key, 1), value + 1)

    def save(self) -> None:
        self.saved.append(self.now.copy())

    def release(self) -> None:
        self.saved.pop()

    def rollback_to_save(self) -> None:
        self.now = self.saved.pop()

    def commit(self) -> None:
        if self.now.files != self.begun.files or self.now.numbers != self.begun.numbers or self.now.notes != self.begun.notes:
            self.store.commit(self.now)
