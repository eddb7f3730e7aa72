"""Writers: notes with front-matter, cards and calendars, tables as CSV, snapshots, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text


def front_matter(fields: dict[str, Column]) -> Column:
    """The head of a note: one line for each field."""
    return F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{k}: "), text.one_line(v.cast("string"))) for k, v in fields.items()), F.lit("---"))


def notes(docs: DataFrame, doc_id: str = "doc_id", body: str = "text", fields: tuple[str, ...] = ()) -> DataFrame:
    """(name, value): the note of each document."""
    head = front_matter({f: F.col(f) for f in (doc_id, *fields)})
    return docs.select(F.concat_ws("__", F.col(doc_id).cast("string"), *(text.plain_name(F.col(f).cast("string")) for f in fields)).alias("name"), F.concat(head, F.lit("\n\n"), body).alias("value"))


def write_notes(rows: DataFrame, path: str, by: Column | None = None) -> None:
    """Notes as text files, in folders by a field."""
    rows = rows.withColumn("folder", by if by is not None else F.lit("all"))
    rows.select("value", "folder").write.mode("overwrite").partitionBy("folder").text(path)


def write_tables(cells: DataFrame, path: str) -> None:
    """(table, row, cells): a folder of CSV files for each table, rows in order; cells with commas, quotes or line feeds are quoted."""
    special = lambda x: x.rlike('[",\\r\\n]')
    quoted = F.transform("cells", lambda x: F.when(special(x), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit(""))))
    rows = cells.repartition("table").sortWithinPartitions("table", "row").select("table", F.array_join(quoted, ",").alias("value"))
    rows.write.mode("overwrite").partitionBy("table").text(path)


def table_references(cells: DataFrame) -> DataFrame:
    """(name, value): a note for each table: its size, and where its CSV files lie."""
    sizes = cells.groupBy("table").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("columns"))
    value = F.concat(F.lit("# Table "), F.col("table").cast("string"), F.lit("\n\n- rows: "), F.col("rows").cast("string"), F.lit("\n- columns: "), F.col("columns").cast("string"), F.lit("\n- data: [[table="), F.col("table").cast("string"), F.lit("]]"))
    return sizes.select(F.col("table").cast("string").alias("name"), value.alias("value"))


def entity_stubs(mentions: DataFrame) -> DataFrame:
    """(folder, name, value): a note for each name of (kind, name, doc_id), with the documents that mention it linked, twenty at most and how many more."""
    ranked = mentions.select("kind", "name", "doc_id").distinct().withColumn("k", F.row_number().over(Window.partitionBy("kind", "name").orderBy("doc_id")))
    rows = ranked.groupBy("kind", "name").agg(F.max("k").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= 20, F.col("doc_id")))).alias("docs"))
    links = F.array_join(F.transform("docs", lambda x: F.concat(F.lit("- [["), x.cast("string"), F.lit("]]"))), "\n")
    more = F.when(F.col("n") > 20, F.concat(F.lit("\n- and "), (F.col("n") - 20).cast("string"), F.lit(" more"))).otherwise("")
    head = F.concat(F.lit("---\ntype: "), F.col("kind"), F.lit("\nname: "), text.one_line(F.col("name")), F.lit("\n---\n\n# "), F.col("name"), F.lit("\n\n"))
    return rows.select(F.col("kind").alias("folder"), text.plain_name(F.col("name")).alias("name"), F.concat(head, links, more).alias("value"))


def write_queue(items: DataFrame, path: str) -> None:
    """The work queue as JSON lines, replaced as a whole."""
    items.write.mode("overwrite").json(path)


def read_queue(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").json(path)


def read_snapshots(spark, path: str, newest: int, by: str = "at") -> DataFrame:
    return spark.read.json(path).orderBy(F.desc(by)).limit(newest)


def append_chunks(chunks: DataFrame, path: str, view: str = "view") -> None:
    """The chunk table, in folders by view, so that a search of one view reads only it."""
    chunks.write.mode("append").partitionBy(view).parquet(path)


def calendar(events: DataFrame, title: str, day: str) -> DataFrame:
    """One calendar with all events, in order of day."""
    event = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.substring(F.md5(F.concat(F.col(day).cast("string"), title).cast("binary")), 1, 16)), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd")), F.concat(F.lit("SUMMARY:"), text.calendar_escape(F.col(title))), F.lit("END:VEVENT"))
    rows = events.select(F.col(day).alias("d"), event.alias("e")).groupBy(F.trunc("d", "month").alias("month")).agg(F.array_sort(F.collect_list(F.struct("d", "e"))).alias("x"))
    return rows.select("month", F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("VERSION:2.0"), F.array_join(F.transform("x", lambda v: v["e"]), "\r\n"), F.lit("END:VCALENDAR")).alias("value"))
