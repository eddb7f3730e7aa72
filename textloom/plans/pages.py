"""The read model behind exported pages: each page's table as a query over documents or events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.registry import query, table


def page(docs: DataFrame, holds: Column, columns: tuple[str, ...], newest: str, ident: str, most: int = 50) -> DataFrame:
    """The newest rows that hold something."""
    return docs.where(holds).orderBy(F.desc(newest), F.desc(ident)).limit(most).select(*columns)


def _day(spark, sf_dir, day: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("ts") >= F.expr(f"timestamp_ntz'{day} 00:00:00'")) & (F.col("ts") < F.expr(f"timestamp_ntz'{day} 00:00:00' + interval 1 day")))


@query("page_day", "SELECT event_id, event_type, value FROM events WHERE ts::DATE = DATE '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def page_day(spark, sf_dir):
    return page(_day(spark, sf_dir, "2024-01-10"), F.lit(True), ("event_id", "event_type", "value"), "ts", "event_id")


@query("page_created", "SELECT event_id, user_id FROM events WHERE ts::DATE = DATE '2024-01-10' OR (ts + INTERVAL 1 DAY)::DATE = DATE '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50")
def page_created(spark, sf_dir):
    day = F.lit("2024-01-10").cast("date")
    return page(table(spark, sf_dir, "events"), (F.to_date("ts") == day) | (F.to_date(F.expr("ts + interval 1 day")) == day), ("event_id", "user_id"), "ts", "event_id")


def _fields(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "n_chars", F.array("lang", "source").alias("places"))


for _name, _value in (("person", "src3"), ("technology", "de"), ("place", "src7"), ("organisation", "fr"), ("project", "src11"), ("generic", "es")):

    @query(f"page_{_name}", f"SELECT doc_id, n_chars FROM documents WHERE lang = '{_value}' OR source = '{_value}' ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
    def page_of(spark, sf_dir, value=_value):
        """Documents whose list field holds a name."""
        return page(_fields(table(spark, sf_dir, "documents")), F.array_contains("places", value), ("doc_id", "n_chars"), "n_chars", "doc_id")


@query("page_backlinks", "SELECT doc_id, n_chars FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars > 5000) ORDER BY n_chars DESC, doc_id DESC LIMIT 50")
def page_backlinks(spark, sf_dir):
    """Documents that link to a page: a semi join with the table of links."""
    docs = table(spark, sf_dir, "documents")
    edges = docs.where("lang = 'es' and n_chars > 5000").select("source")
    return page(docs.select("doc_id", "n_chars", "source").join(edges, "source", "left_semi"), F.lit(True), ("doc_id", "n_chars"), "n_chars", "doc_id")


@query("page_project_timeline", "SELECT ts::DATE AS day, event_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 100")
def page_project_timeline(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy("ts", "event_id").limit(100).select(F.to_date("ts").alias("day"), "event_id")


@query("wiki_links", "SELECT doc_id, '[[refs/sources/' || source || '|' || upper(source) || ']]' || chr(10) || '[[refs/languages/' || lang || '|' || lang || ']]' AS block, 'doc/' || lang || ' topic/' || source AS tags FROM documents")
def wiki_links(spark, sf_dir):
    link = lambda kind, slug, name: F.concat(F.lit(f"[[refs/{kind}/"), slug, F.lit("|"), name, F.lit("]]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", link("sources", F.col("source"), F.upper("source")), link("languages", F.col("lang"), F.col("lang"))).alias("block"), F.concat(F.lit("doc/"), "lang", F.lit(" topic/"), "source").alias("tags"))


@query("conversation_markdown", "SELECT conv_id, string_agg('**' || role || ':** ' || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def conversation_markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit(":** "), "text").alias("line")))).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n\n").alias("body"))


@query("contact_cards", "SELECT user_id, 'BEGIN:VCARD' || chr(13) || chr(10) || 'VERSION:3.0' || chr(13) || chr(10) || 'FN:User ' || user_id || chr(13) || chr(10) || 'NOTE:Mentioned in: ' || string_agg(event_id, '\\, ' ORDER BY event_id) || chr(13) || chr(10) || 'END:VCARD' AS card FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events QUALIFY n <= 3) GROUP BY user_id")
def contact_cards(spark, sf_dir):
    """One card for each person with their first three mentions."""
    ranked = table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("k <= 3")
    rows = ranked.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    note = F.array_join(F.transform("ids", lambda x: x.cast("string")), "\\, ")
    return rows.select("user_id", F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), F.concat(F.lit("FN:User "), F.col("user_id").cast("string")), F.concat(F.lit("NOTE:Mentioned in: "), note), F.lit("END:VCARD")).alias("card"))


@query("set_union", "SELECT doc_id FROM documents WHERE lang = 'en' UNION SELECT doc_id FROM labels")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("set_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("set_union_all", "SELECT doc_id AS id, 'document' AS kind FROM documents UNION ALL SELECT page_id, 'page' FROM pages")
def set_union_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind")).unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")))
