"""Tables of chunks that change, patches of JSON documents, and similar titles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import shared
from textloom.operators import similar
from textloom.operators.rules import title
from textloom.registry import query, table


def upsert(chunks: DataFrame, new: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``chunks`` with the documents of ``new`` in place of their old chunks."""
    return chunks.join(new.select(doc_id).distinct(), doc_id, "left_anti").unionByName(new)


def delete(chunks: DataFrame, ids: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return chunks.join(ids.select(doc_id).distinct(), doc_id, "left_anti")


@query("delete_documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_documents(spark, sf_dir):
    return delete(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id", "source")


@query("upsert_documents", "SELECT doc_id, coalesce('q' || quality, source) AS source FROM documents LEFT JOIN labels USING (doc_id)")
def upsert_documents(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return upsert(table(spark, sf_dir, "documents").select("doc_id", "source"), new)


FORBIDDEN = ("id", "created_at", "content_hash", "provenance")


def _parts(path: str) -> list[str | int]:
    out: list[str | int] = []
    for p in path.split("."):
        name, _, rest = p.partition("[")
        out.append(name)
        out += [int(x.rstrip("]")) for x in rest.split("[") if x]
    return out


def patched(document: str | None, patch: str | None) -> str | None:
    """A JSON document after a patch's adds, replacements and removals; forbidden paths raise."""
    if document is None or patch is None:
        return document
    doc, p = json.loads(document), json.loads(patch)
    for path in [*p.get("add", {}), *p.get("replace", {}), *p.get("remove", [])]:
        if path.split(".")[0].split("[")[0] in FORBIDDEN:
            raise ValueError(f"{path} may not be changed")
    for path, value in p.get("add", {}).items():
        *up, last = _parts(path)
        at = doc
        for k in up:
            at = at.setdefault(k, {}) if isinstance(k, str) else at[k]
        old = at.get(last) if isinstance(at, dict) else at[last]
        if isinstance(old, dict) and isinstance(value, dict):
            old.update(value)
        elif isinstance(old, list):
            old += [v for v in (value if isinstance(value, list) else [value]) if v not in old]
        else:
            at[last] = value
    for path, value in p.get("replace", {}).items():
        *up, last = _parts(path)
        at = doc
        for k in up:
            at = at[k]
        at[last] = value
    for path in p.get("remove", []):
        *up, last = _parts(path)
        at = doc
        for k in up:
            at = at[k]
        if isinstance(last, int) or last in at:
            del at[last]
    return json.dumps(doc, sort_keys=True, ensure_ascii=False)


def apply_patch(document: Column, patch: Column) -> Column:
    @F.pandas_udf("string")
    def run(d: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([patched(x, y) for x, y in zip(d, p, strict=True)], dtype=object)

    return run(document, patch)


@query("json_patches")
def json_patches(spark, sf_dir):
    doc = F.to_json(F.struct("event_type", "value", F.array("event_type").alias("tags")))
    patch = F.lit('{"add": {"tags": ["new"], "meta": {"a": 1}}, "replace": {"value": 0}, "remove": ["tags[0]"]}')
    return table(spark, sf_dir, "events").select("event_id", apply_patch(doc, patch).alias("doc"))


def repaired_json(c: Column) -> Column:
    """A model's answer without fences, or its first object; null if it isn't JSON."""
    c = F.regexp_replace(F.trim(c), r"(?s)^```[a-z]*\s*|\s*```$", "")
    c = F.when(c.startswith("{"), c).otherwise(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.when(F.get_json_object(c, "$").isNotNull(), c)


@query("json_repair", "SELECT event_id, props AS repaired FROM events")
def json_repair(spark, sf_dir):
    lead = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" ok"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", repaired_json(lead).alias("repaired"))


def similar_titles(titles: DataFrame, least: float = 0.85) -> DataFrame:
    """(title_a, title_b, ratio) of all distinct titles, as letters and digits in lower case, of over five of them, that are alike enough.

    No pair is lost: see ``similar.near_pairs``. A null title is none; titles that differ in other signs only are one.
    """
    tables = shared.Tables(titles.sparkSession, "titles")
    letters = F.regexp_replace(F.lower("title"), "[^a-z0-9]", "")
    one = tables.write(titles.select(F.lit(0).alias("kind"), letters.alias("t")).where(F.length("t") > 5).distinct(), "titles")
    pairs = similar.near_pairs(one, least, tables).withColumn("ratio", similar.ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least)
    return tables.keep(pairs.select(F.col("a").alias("title_a"), F.col("b").alias("title_b"), "ratio"))


@query("title_similarity")
def title_similarity(spark, sf_dir):
    """The titles of all texts."""
    docs = table(spark, sf_dir, "documents").select(title(F.col("text"), F.lit("")).alias("title"))
    return similar_titles(docs)
