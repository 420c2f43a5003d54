"""What the operators of this subpackage share: scratch tables, code shipping, word rules."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per SparkContext, whatever their working folder is."""
    sc = spark.sparkContext
    if getattr(sc, "_tesseral_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tesseral-code-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, f"tesseral_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for base, dirs, names in os.walk(os.path.join(_PACKAGE_ROOT, "tesseral")):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(base, name)
                z.write(full, os.path.relpath(full, _PACKAGE_ROOT))
    sc.addPyFile(archive)
    sc._tesseral_shipped = True


_folder: contextvars.ContextVar[str | None] = contextvars.ContextVar("folder", default=None)


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_tesseral_scratch", None)
        if base is None:
            base = tempfile.mkdtemp(prefix="tesseral-scratch-")
            atexit.register(shutil.rmtree, base, True)
            spark.sparkContext._tesseral_scratch = base
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent and Spark runs on this machine alone, as in tests, it is a temporary folder."""
    return f"{_folder.get() or _base(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleared(spark: SparkSession):
    """All that operators write to the shared folder inside goes at the end; results must be written elsewhere by then."""
    folder = scratch(spark, "work")
    token = _folder.set(folder)
    try:
        yield
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add: its own output replaces them."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of ``df`` has: for columns that an operator adds and drops again."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def quoted(name: str) -> "F.Column":
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(df: DataFrame, name: str) -> "F.Column":
    """The column as text, null counted as empty."""
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def ascii_lower(column: "F.Column") -> "F.Column":
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_bucket(key: "F.Column", modulus: int) -> "F.Column":
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def slices(batches, rows: int = 256):
    """The batches in pieces of few rows, so that a worker holds few texts as Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches, column: int, most: int, rows: int = 1 << 30):
    """The batches in pieces of ``rows`` rows at most, whose texts, in this column, have ``most`` bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes + 1), 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def trimmed(run):
    """``run``, after which the worker gives the memory that it has freed back to the system."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library can
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
