"""Written intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch on the way to Python, so that a batch of long texts stays small.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20
_ROWS, _BYTES, _COLUMNS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
#: Bytes of a row group of a written table, which a task gathers in memory.
GROUP_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a new temporary one, which is then set; a cluster's machines share no such folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def as_row(df: DataFrame) -> Column:
    """All columns in one struct ``row``, so that columns that an operator adds can't clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def row_schema(rows: DataFrame, more: str) -> StructType:
    """The schema of ``row`` and of further columns given in DDL."""
    return StructType([rows.schema["row"], *StructType.fromDDL(more).fields])


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES):
    """Bounds Arrow batches, and rows that Parquet readers decode at once, of what is run within; the session's own settings then hold again."""
    before = {k: spark.conf.get(k, None) for k in (_ROWS, _BYTES, _COLUMNS)}
    for k in (_ROWS, _COLUMNS):
        spark.conf.set(k, min(rows, int(before[k] or rows)))
    spark.conf.set(_BYTES, size)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such function
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A task's function, mapping batches or two groups of one key, that gives back what it has freed at its end: Python workers live on through later stages, and what they keep adds up."""

    @wraps(run)
    def batches(rows):
        try:
            yield from run(rows)
        finally:
            _give_back()

    @wraps(run)
    def group(key, left, right):
        try:
            return run(key, left, right)
        finally:
            _give_back()

    return batches if run.__code__.co_argcount == 1 else group


class Scratch:
    """Tables written as Parquet and read again: this cuts lineage, survives lost executors, and gives the optimizer real sizes.

    ``keep`` writes a result and deletes every other table; ``drop`` deletes one that is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int = ARROW_ROWS):
        self.spark, self.root, self.paths, self.n = spark, f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}", {}, 0
        self.rows = rows

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        path = self.path(label)
        with small_batches(self.spark, self.rows):
            df.write.options(**{"parquet.block.size": str(GROUP_BYTES)} | options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                self._delete(self.paths.pop(id(t))[1])

    def keep(self, df: DataFrame, label: str = "result") -> DataFrame:
        out = self.write(df, label)
        self.drop(*[t for t, _ in list(self.paths.values()) if t is not out])
        return out
