"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch, as_row

#: A line is boilerplate if it stands on more than this share of a site's pages, and on so many of them at least.
RATIO, LEAST_PAGES = 0.05, 5


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", *, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, keys): per site the MD5 of its boilerplate lines.

    Pages with a line and pages of a site are counted over all rows, with map-side sums, so that a site of any size is
    no single task's work. If pages have k lines on average, a site has fewer than k / ratio such lines, whatever its size.
    """
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    per_line = pages.where("text is not null").select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("pages")).where(F.col("pages") >= least)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return per_line.join(totals, "host").where(F.col("pages") > ratio * F.col("total")).groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, scratch: Scratch, host: str = "source", text: str = "text", *, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """``docs`` in a struct ``row``, with the text without its site's boilerplate lines (kept), n_lines and n_dropped.

    Lines end at a line feed and are compared without blanks at either end; blank lines stay. A null text stays null and
    has no lines; rows without a host belong to no site and stay as they are; repeated rows are separate pages. The sites'
    few lines come from a written table, whose size the optimizer knows: it broadcasts it if it is small, and else joins by
    host and splits large sites.
    """
    found = scratch.write(boilerplate(docs, host, text, ratio=ratio, least=least), "boilerplate").select(F.col("host").alias("_host"), F.col("keys").alias("_keys"))
    rows = docs.select(as_row(docs))
    lines = F.split(F.col("row").getField(text), "\n")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("_keys", _key(x)))
    rows = rows.join(found, F.col("row").getField(host) == F.col("_host"), "left").select("row", lines.alias("lines"), F.when(F.col("_keys").isNull(), lines).otherwise(kept).alias("left"))
    return rows.select("row", F.array_join("left", "\n").alias("kept"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_boilerplate(docs, Scratch(spark, "lines"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
site AS (SELECT source, count(*) AS total FROM pages WHERE source IS NOT NULL GROUP BY source),
seen AS (SELECT source, line, count(*) AS n FROM
    (SELECT DISTINCT doc_id, source, trim(unnest(lines)) AS line FROM pages WHERE source IS NOT NULL) WHERE line <> '' GROUP BY source, line),
bad AS (SELECT seen.source, list(line) AS found FROM seen JOIN site USING (source) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * total GROUP BY seen.source),
kept AS (SELECT doc_id, lines, CASE WHEN found IS NULL THEN lines ELSE list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(found, trim(x))) END AS rest
    FROM pages LEFT JOIN bad USING (source))
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(rest), 0) AS n_dropped,
    sha256(coalesce(array_to_string(rest, chr(10)), '')) AS kept_sha256 FROM kept
"""
