"""What optical recognition and vision models return: words with confidences, pages with fields; and the loop of critic and editor."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.operators.mutations import apply_patch
from textloom.registry import query, table, typed

SURE, MOST_PAGES, GOOD, ROUNDS = 0.6, 10, 4.0, 2


def confident_text(words: DataFrame, least: float = SURE) -> DataFrame:
    """(page, text, confidence) of recognised words (page, position, word, confidence): those sure enough, in order, and their mean confidence; 0 and no text without any."""
    kept = F.when((F.col("confidence") >= least) & (F.trim("word") != ""), F.struct("position", "word"))
    mean = F.avg(F.when((F.col("confidence") >= least) & (F.trim("word") != ""), F.col("confidence")))
    return words.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["word"]), " ").alias("text"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias("confidence"))


def confident_lists(pages: DataFrame, least: float = SURE) -> DataFrame:
    """The same of rows (page, words: array<struct<position, word, confidence>>), a page or a part of one each: what is sure is joined in the row, so that one short row for each is shuffled, not its words."""
    kept = F.filter("words", lambda x: (x["confidence"] >= least) & (F.trim(x["word"]) != ""))
    rows = pages.select("page", kept.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["confidence"])
    part = F.struct(F.transform("w", lambda x: x["position"].cast("long")).alias("at"), F.transform("w", lambda x: x["word"]).alias("word"))  # two plain arrays take less room than structs
    parts = rows.select("page", part.alias("part"), total.alias("total"), F.size("w").alias("n")).groupBy("page").agg(F.collect_list(F.when(F.col("n") > 0, F.col("part"))).alias("parts"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    words = F.flatten(F.transform("parts", lambda p: F.arrays_zip(p["at"].alias("at"), p["word"].alias("word"))))
    return parts.select("page", F.array_join(F.transform(F.array_sort(words), lambda x: x["word"]), " ").alias("text"), F.round(F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0), 6).alias("confidence"))


@query("confident_text", typed("""WITH w AS (SELECT doc_id AS page, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT page, unnest(w) AS word, unnest(range(len(w))) AS position FROM w), c AS (SELECT *, ((position * 37 + page) % 100) / 100.0 AS confidence FROM p)
SELECT page, coalesce(string_agg(word, ' ' ORDER BY position) FILTER (confidence >= 0.6), '') AS text, round(coalesce(avg(confidence) FILTER (confidence >= 0.6), 0), 6) AS confidence FROM c GROUP BY page""", confidence="DOUBLE"))
def confident_text_query(spark, sf_dir):
    """All texts' words, with confidences made from their places."""
    one = lambda x, i: F.struct(i.alias("position"), x.alias("word"), ((i * 37 + F.col("page")) % 100 / 100.0).alias("confidence"))
    pages = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page"), F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).where(F.size("w") > 0)
    return confident_lists(pages.select("page", F.transform("w", one).alias("words")))


def merged_pages(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(doc_id, text, names) of pages (doc_id, page, text, names): at most ten pages under their numbers, and the union of their names."""
    first = pages.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("k") <= most)
    one = F.struct("page", F.concat(F.lit("--- Page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text")).alias("t"))
    return first.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("text"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))


@query("merged_pages", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS page FROM l), f AS (SELECT *, regexp_extract_all(text, '[A-Z][a-z]{7,}') AS names FROM p WHERE page <= 10)
SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS text, list_sort(list_distinct(flatten(list(names)))) AS names FROM f GROUP BY doc_id""")
def merged_pages_query(spark, sf_dir):
    """Lines of texts as pages."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return merged_pages(pages.select("doc_id", (F.col("k") + 1).alias("page"), "text", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)).alias("names")))


#: Paths that an editor may not change, and the most characters and points of a summary.
LOCKED = ("id", "source.type", "source.path", "source.url", "source.content_hash", "rag.vector_ref.collection", "rag.vector_ref.doc_id", "doc_time.created")
SUMMARY_CHARS, SUMMARY_POINTS = 600, 5


def patch_error(patch: str | None) -> str | None:
    """Why an editor's patch may not be applied; null if it may."""
    try:
        p = json.loads(patch or "")
    except ValueError:
        return "not JSON"
    if not isinstance(p, dict) or not {"add", "replace", "remove"} & p.keys():
        return "neither add, replace nor remove"
    if not all(isinstance(p.get(k, {}), dict) for k in ("add", "replace")) or not isinstance(p.get("remove", []), list):
        return "a part of the wrong type"
    paths = [*p.get("add", {}), *p.get("replace", {}), *(str(x).split("[")[0] for x in p.get("remove", []))]
    if bad := [x for x in paths if any(x == f or x.startswith(f + ".") for f in LOCKED)]:
        return f"{bad[0]} is locked"
    values = p.get("add", {}) | p.get("replace", {})
    if len(str(values.get("summary.tl_dr", ""))) > SUMMARY_CHARS:
        return "the summary is too long"
    points = values.get("summary.key_points", [])
    return "too many points" if isinstance(points, list) and len(points) > SUMMARY_POINTS else None


def checked_patch(patch: Column) -> Column:
    """struct<patch, error>: the patch if it may be applied, else an error."""

    @F.pandas_udf("patch string, error string")
    def run(patches: pd.Series) -> pd.DataFrame:
        errors = patches.map(patch_error)
        return pd.DataFrame({"patch": patches.where(errors.isna(), None), "error": errors})

    return run(patch)


def reviewed(records: DataFrame, critic: Callable[[Column], Column], editor: Callable[[Column], Column], *, good: float = GOOD, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, record, score, rounds, error) of JSON records (doc_id, record): a critic scores each, an editor's patch changes those below ``good``, at most ``rounds`` times.

    All records of a round are one job; what is good enough or whose patch may not be applied leaves the loop as it is.
    """
    state = records.select("doc_id", "record", critic(F.col("record")).alias("score"), F.lit(0).alias("rounds"), F.lit(None).cast("string").alias("error"))
    done = None
    for _ in range(rounds):
        state = shared.written(state, "review")
        stays = (F.coalesce("score", F.lit(0.0)) >= good) | F.col("error").isNotNull()
        kept, todo = state.where(stays), state.where(~stays)
        done = kept if done is None else done.unionByName(kept)
        patched = todo.withColumn("p", checked_patch(editor(F.col("record")))).select("doc_id", "record", "score", "rounds", "p.patch", "p.error")
        patched = patched.withColumn("record", apply_patch(F.col("record"), F.col("patch")))
        state = patched.select("doc_id", "record", F.when(F.col("error").isNull(), critic(F.col("record"))).otherwise(F.col("score")).alias("score"), F.when(F.col("error").isNull(), F.col("rounds") + 1).otherwise(F.col("rounds")).alias("rounds"), "error")
    return state if done is None else done.unionByName(state)


@query("review_loop", typed("""WITH d AS (SELECT doc_id, doc_id % 6 AS v FROM documents) SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND v < 4 THEN v WHEN v >= 4 THEN v ELSE least(v + 4, greatest(4, v + 2 * CASE WHEN v + 2 >= 4 THEN 1 ELSE 2 END)) END AS score,
CASE WHEN doc_id % 7 = 0 OR v >= 4 THEN 0 WHEN v + 2 >= 4 THEN 1 ELSE 2 END AS rounds, CASE WHEN doc_id % 7 = 0 AND v < 4 THEN 'id is locked' END AS error FROM d""", score="DOUBLE", rounds="INT"))
def review_loop(spark, sf_dir):
    """Records that a critic scores by a field, which an editor raises by two; every seventh patch touches what is locked."""
    record = F.to_json(F.struct((F.col("doc_id") % 6).alias("value"), F.col("doc_id").alias("number")))
    critic = lambda r: F.get_json_object(r, "$.value").cast("double")
    raised = lambda r: F.concat(F.lit('{"replace": {"'), F.when(F.get_json_object(r, "$.number").cast("long") % 7 == 0, "id").otherwise("value"), F.lit('": '), (F.get_json_object(r, "$.value").cast("int") + 2).cast("string"), F.lit("}}"))
    return reviewed(table(spark, sf_dir, "documents").select("doc_id", record.alias("record")), critic, raised).select("doc_id", "score", "rounds", "error")
