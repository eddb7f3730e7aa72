"""Admission by two token buckets a key, and first arrivals, with state that doesn't grow with the history."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from textloom import shared
from textloom.registry import query, table
from textloom.streaming.streams import drained

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@dataclass(frozen=True)
class Bucket:
    """Holds up to ``most`` tokens and gains ``rate`` a second; a new one is full."""

    most: float
    rate: float

    def filled(self, state: tuple[float, float] | None, now: float) -> tuple[float, float]:
        left, at = state or (self.most, now)
        return min(self.most, left + max(0.0, now - at) * self.rate), max(at, now)


@dataclass(frozen=True)
class Limits:
    """A short bucket and a long one; a request needs a token of both, and gets the short one's back if the long one has none."""

    short: Bucket
    long: Bucket

    @classmethod
    def per(cls, minute: float = 60, hour: float = 1000, burst: float = 10) -> Limits:
        return cls(Bucket(burst, minute / 60), Bucket(hour, hour / 3600))

    def ask(self, short: tuple | None, long: tuple | None, now: float) -> tuple[tuple, tuple | None, str, float]:
        """Both buckets' states after a request, the bucket that refuses it ("" if none), and the seconds after which it wouldn't."""
        left, at = self.short.filled(short, now)
        if left < 1:
            return (left, at), long, "short", (1 - left) / self.short.rate
        more, then = self.long.filled(long, now)
        if more < 1:
            return (min(self.short.most, left), at), (more, then), "long", (1 - more) / self.long.rate
        return (left - 1, at), (more - 1, then), "", 0.0

    @property
    def idle(self) -> float:
        """Seconds without a request after which both are full again, so that a forgotten key loses nothing."""
        return max(self.short.most / self.short.rate, self.long.most / self.long.rate)


OUT = "user_id long, event_id long, admitted boolean, refused_by string, retry_after double"


class Limiter(StatefulProcessor):
    """For each user the two buckets as two state variables; a timer forgets them when they are full again."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.short, self.long = (handle.getValueState(name, "left double, at double") for name in ("short", "long"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        short, long = (tuple(s.get()) if s.exists() else None for s in (self.short, self.long))
        out = []
        for i, t in sorted(((i, t.timestamp()) for pdf in rows for i, t in zip(pdf.event_id, pdf.ts, strict=True)), key=lambda x: (x[1], x[0])):
            short, long, by, wait = self.limits.ask(short, long, t)
            out.append((key[0], i, not by, by, wait))
        for state, value in ((self.short, short), (self.long, long)):
            if value:
                state.update(tuple(map(float, value)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(int((max(short[1], long[1] if long else 0) + self.limits.idle) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted", "refused_by", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.short.clear()
        self.long.clear()
        yield pd.DataFrame([], columns=["user_id", "event_id", "admitted", "refused_by", "retry_after"])

    def close(self) -> None:
        pass


@contextmanager
def with_conf(spark: SparkSession, **values: str):
    """Settings that hold within, and are then as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def limited(stream: DataFrame, limits: Limits) -> DataFrame:
    """(user_id, event_id, admitted, refused_by, retry_after) of a stream with user_id, event_id and ts, which has a watermark."""
    return stream.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(Limiter(limits), OUT, "append", "EventTime")


def run_limited(stream: DataFrame, limits: Limits) -> DataFrame:
    """Drains ``limited``; its state lies in the store that timers and several variables need."""
    with with_conf(stream.sparkSession, **{_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        return drained(limited(stream, limits), "append")


def first_arrivals(stream: DataFrame, key: list[str], folder: str, buckets: int = 16) -> None:
    """Drains a stream with a watermark into ``folder``/rows: the first row of each key, whatever came before or how long ago.

    Repeats within the watermark end in the stream's state, which keeps a key no longer than that; older ones end in a join
    with the keys stored so far, by hash in ``buckets`` folders. A batch sees the keys of earlier batches only, and writes its
    own anew if it runs again. Keys that are null are a key like any other.
    """
    spark = stream.sparkSession
    stored = StructType([*stream.select(*key).schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())])

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(key).withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        rows = shared.written(rows, "batch")
        known = spark.read.schema(stored).parquet(f"{folder}/keys") if number else None
        if known is not None:
            old = known.where(F.col("batch") < number).alias("old")
            rows = rows.alias("new").join(old, [F.col("new.bucket") == F.col("old.bucket")] + [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in key], "left_anti")
        rows.select(*key, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/keys/batch={number}")
        rows.drop("bucket").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.dropDuplicatesWithinWatermark(key).writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def by_days(spark: SparkSession, sf_dir: str, files: int, late: str) -> DataFrame:
    """The events in order of time in ``files`` files, one a batch; written one after another, since a stream takes files by their times."""
    folder = shared.new_folder(spark, "days")
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.select(F.min("ts"), F.max("ts")).select(F.unix_micros("min(ts)"), F.unix_micros("max(ts)") + 1).first()
    for k in range(files):
        low, high = (bounds[0] + (bounds[1] - bounds[0]) * x // files for x in (k, k + 1))
        rows.where((F.unix_micros("ts") >= low) & (F.unix_micros("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", late)


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    """The first arrival of each key, over many batches."""
    folder = shared.new_folder(spark, "arrivals")
    first_arrivals(by_days(spark, sf_dir, 6, "2 days").select("user_id", "event_type", "ts"), ["user_id", "event_type"], folder)
    return spark.read.parquet(f"{folder}/rows").select("user_id", "event_type")


#: Limits that refuse some of the table's rare events: 2 and then one in 12 hours, 6 and then one in 24.
SPARSE = Limits(Bucket(2, 1 / 43_200), Bucket(6, 1 / 86_400))


@query("stream_rate_limit", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, t, t AS t_long, 1.0::DOUBLE AS short, 5.0::DOUBLE AS long, '' AS refused_by, 0.0::DOUBLE AS retry_after FROM e WHERE n = 1 UNION ALL
    SELECT user_id, event_id, n, t, CASE WHEN s < 1 THEN t_long ELSE t END, CASE WHEN s < 1 OR l < 1 THEN s ELSE s - 1 END, CASE WHEN s < 1 THEN long WHEN l < 1 THEN l ELSE l - 1 END,
        CASE WHEN s < 1 THEN 'short' WHEN l < 1 THEN 'long' ELSE '' END, CASE WHEN s < 1 THEN (1 - s) * 43200 WHEN l < 1 THEN (1 - l) * 86400 ELSE 0 END
    FROM (SELECT e.user_id, e.event_id, e.n, e.t, f.t_long, f.long, least(2.0, f.short + (e.t - f.t) / 43200) AS s, least(6.0, f.long + (e.t - f.t_long) / 86400) AS l FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT user_id, event_id, refused_by = '' AS admitted, refused_by, round(retry_after, 3) AS retry_after FROM f""")
def stream_rate_limit(spark, sf_dir):
    """Which events two buckets a user admit, over many batches."""
    return run_limited(by_days(spark, sf_dir, 4, "1 day"), SPARSE).withColumn("retry_after", F.round("retry_after", 3))
