"""Written tables that a session keeps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a new temporary one, which is then set; a cluster's machines share no such folder, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: computed once, lineage cut, sizes known to the optimizer."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Bounds the rows of Arrow batches of what is run within; the session's own setting then holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Tables:
    """Written tables of one operator. ``keep`` writes its result and deletes all others; ``drop`` deletes what is no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = new_folder(self.spark, f"{self.name}-{label}")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if id(t) in self.paths:
                delete(self.spark, self.paths.pop(id(t))[1])

    def keep(self, df: DataFrame) -> DataFrame:
        out = self.write(df, "result")
        self.drop(*[t for t, _ in list(self.paths.values()) if t is not out])
        del self.paths[id(out)]
        return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def signature(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a file or of all files of a folder, so that a change shows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files, out = fs.listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(out))
