"""Continuous versions of the stateful parts, on a stream of event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import shared
from textloom.registry import query, table

LATE = "7 days"


def events(spark: SparkSession, sf_dir: str, files: int = 100) -> DataFrame:
    """The events table as a stream, with an event time and its watermark (the table's own type has no zone, which watermarks refuse)."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def watch(spark: SparkSession, folder: str, schema: str, fmt: str = "text", archive: str | None = None) -> DataFrame:
    """New files of a folder, once each; with ``archive`` they are moved there when they have been read."""
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("cleanSource", "archive").option("sourceArchiveDir", archive) if archive else reader).load(folder)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its result table, written to the shared folder.

    A batch that runs again replaces its own files, and in complete mode the last batch holds the result, so that nothing
    is gathered in the driver or counted twice.
    """
    folder = shared.new_folder(stream.sparkSession, "stream")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else number}")

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    empty.write.mode("append").parquet(f"{folder}/out/batch=-1")
    return stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").select(*stream.columns)


@query("stream_daily", "SELECT ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_daily(spark, sf_dir):
    """Tumbling days."""
    s = events(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drained(s.select(F.to_date("w.start").alias("day"), "n", "total"))


@query("stream_weekly", "WITH d AS (SELECT unnest(range(7)) AS k), r AS (SELECT (date_trunc('day', ts) - k * INTERVAL 1 DAY)::DATE AS started FROM events, d) SELECT started, count(*) AS n FROM r GROUP BY started")
def stream_weekly(spark, sf_dir):
    """Seven days, sliding by one."""
    s = events(spark, sf_dir).groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return drained(s.select(F.to_date("w.start").alias("started"), "n"))


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Threads with gaps of up to four hours."""
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return drained(s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n"))


@query("stream_counters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS high FROM events GROUP BY event_type")
def stream_counters(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("high"))
    return drained(s)
