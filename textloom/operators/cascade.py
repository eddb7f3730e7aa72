"""Fingerprints of documents, and duplicates by one key after another: what one finds doesn't go to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.functions import text
from textloom.operators import similar
from textloom.operators.documents import fuzzy_hash
from textloom.operators.rules import title
from textloom.registry import query, table

#: Scores of the keys; words by which rough copies may differ, less than; the least ratio of titles.
EXACT, ROUGH, WORDS, TITLES = 1.0, 0.9, 100, 0.85


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, fuzzy_hash, metadata_hash, title_normalized, first_100_chars, word_count, entity_signature) of (doc_id, text, title, domain, created_at, names). Nulls are empty."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body, md5 = of("text"), lambda c: F.md5(c.cast("binary"))
    names = F.array_join(F.array_sort(F.coalesce("names", F.array().cast("array<string>"))), ",")
    return docs.select(
        "doc_id", F.sha2(body.cast("binary"), 256).alias("content_hash"), fuzzy_hash(F.slice(text.tokens(body), 1, 1000)).alias("fuzzy_hash"), md5(F.concat(of("title"), of("domain"), of("created_at"))).alias("metadata_hash"),
        F.regexp_replace(F.lower(of("title")), "[^a-z0-9]", "").alias("title_normalized"), F.btrim(F.substring(body, 1, 100), F.lit(" \t\n\r\f")).alias("first_100_chars"), text.word_count(body).alias("word_count"), md5(names).alias("entity_signature"),
    )


def duplicates(prints: DataFrame, least: float = TITLES) -> DataFrame:
    """(doc_id, duplicate_of, score, reason) of fingerprints; documents without a duplicate have nulls.

    First equal contents: all but the smallest doc_id are copies of it. Of what is left, which is one document a content,
    equal rough hashes with word counts less than WORDS apart: the smallest doc_id among those. Of what is still left, the
    document with the smallest doc_id of the most similar title, from all pairs of distinct titles of over five letters. No
    group meets in one task: copies are found by sums, rough copies by a hash's distinct word counts, titles by a join that
    loses no pair. A null doc_id has no duplicate and is none; other columns are not read.
    """
    tables = shared.Tables(prints.sparkSession, "cascade")
    rows = tables.write(prints.where("doc_id is not null").select("doc_id", "content_hash", "fuzzy_hash", "title_normalized", "word_count"), "prints")
    first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    rows = tables.write(rows.join(first, "content_hash"), "exact")
    exact = rows.where("first < doc_id").select("doc_id", F.col("first").alias("duplicate_of"), F.lit(EXACT).alias("score"), F.lit("exact_content_hash").alias("reason"))
    left = rows.where("first = doc_id")
    near = Window.partitionBy("fuzzy_hash").orderBy("word_count").rangeBetween(1 - WORDS, WORDS - 1)
    best = left.groupBy("fuzzy_hash", "word_count").agg(F.min("doc_id").alias("least")).select("fuzzy_hash", "word_count", F.min("least").over(near).alias("other"))
    left = tables.write(left.join(best, ["fuzzy_hash", "word_count"]), "rough")
    rough = left.where("other < doc_id").select("doc_id", F.col("other").alias("duplicate_of"), F.lit(ROUGH).alias("score"), F.lit("fuzzy_hash_match").alias("reason"))
    left = tables.write(left.where("other = doc_id").select("doc_id", F.col("title_normalized").alias("t")), "titled")
    one = tables.write(left.where(F.length("t") > 5).groupBy("t").agg(F.min("doc_id").alias("least")), "titles")
    pairs = similar.near_pairs(one.select(F.lit(0).alias("kind"), "t"), least, tables).withColumn("ratio", similar.ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    pairs = tables.write(pairs.select("a", "b", "ratio"), "alike")
    both = pairs.select(F.col("a").alias("t"), F.col("b").alias("u"), "ratio").unionByName(pairs.select(F.col("b").alias("t"), F.col("a").alias("u"), "ratio")).unionByName(one.select("t", F.col("t").alias("u"), F.lit(1.0).alias("ratio")))
    met = left.join(both, "t").join(one.withColumnRenamed("t", "u"), "u").where("least < doc_id")
    titled = met.groupBy("doc_id").agg(F.min(F.struct((-F.round("ratio", 9)).alias("m"), "least")).alias("x")).select("doc_id", F.col("x.least").alias("duplicate_of"), F.round(-F.col("x.m"), 6).alias("score"), F.lit("title_similarity").alias("reason"))
    found = exact.unionByName(rough).unionByName(titled)
    return tables.keep(prints.select("doc_id").join(found, "doc_id", "left"))


@query("fingerprints", r"""WITH d AS (SELECT doc_id, text, lang || ' ' || source || ' report ' || doc_id AS title, source AS domain, DATE '2024-01-01' + (doc_id % 365)::INT AS created, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) AS names, list_slice(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 1, 1000) AS w FROM documents)
SELECT doc_id, sha256(text) AS content_hash, md5(title || domain || created) AS metadata_hash, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_normalized, trim(substr(text, 1, 100), chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS first_100_chars, md5(array_to_string(names, ',')) AS entity_signature FROM d""")
def fingerprints_query(spark, sf_dir):
    """The fingerprints of all texts; the rough one and the word count have queries of their own."""
    return fingerprints(_titled(spark, sf_dir, F.concat_ws(" ", "lang", "source", F.lit("report"), "doc_id"))).drop("fuzzy_hash", "word_count")


def _titled(spark, sf_dir: str, name) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)))
    return docs.select("doc_id", "text", name.alias("title"), F.col("source").alias("domain"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("created_at"), names.alias("names"))


@query("duplicate_cascade")
def duplicate_cascade(spark, sf_dir):
    """What each document duplicates, by content, rough hash or title."""
    return duplicates(fingerprints(_titled(spark, sf_dir, title(F.col("text"), F.lit("")))))
