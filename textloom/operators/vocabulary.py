"""Values against a controlled vocabulary: those in it, the nearest term of others, and those without one."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import shared
from textloom.operators import similar
from textloom.registry import query, table

#: Ratios from which a term is near, and from which joins find it, one after another; terms of a block.
LEAST, CLOSE, BLOCK_TERMS = 0.6, (0.9, 0.85, 0.8), 16384


def _best(value: str, terms: Iterable[tuple[float, str]], least: float) -> tuple[float, str] | None:
    """The largest (ratio of matching blocks, term) at ``least`` or more of (bound, term), bounds falling: those below the best ratio so far can't be better. The indel ratio bounds it, too."""
    best = None
    for bound, term in terms:
        if bound < (best[0] if best else least) - 1e-9:
            break
        if term == value or similar.indel_ratio(term, value) < (best[0] if best else least) - 1e-9:
            continue
        r = (difflib.SequenceMatcher(None, term, value).ratio(), term)
        if r[0] >= least and (best is None or r > best):
            best = r
    return best


_NEAREST = "value string, term string, similarity double"


def _rows(out: list[tuple[str, str, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[], [], []], (pa.string(), pa.string(), pa.float64()), strict=True)], ["value", "term", "similarity"])


def _matcher(sent, least: float):
    """For each value the most similar term of a block; letters in common bound the ratio, of those the longest common subsequence does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        theirs, sizes, text = similar.bags(terms, 1, 32), np.array(list(map(len, terms))), similar.columns(terms, 64)
        theirs = theirs.astype(np.uint8) if theirs.max(initial=0) < 256 else theirs
        for b in batches:
            values, out = b.column(0).to_pylist(), []
            for v, mine in zip(values, similar.bags(values, 1, 32).T, strict=True):
                mine = np.minimum(mine, 255).astype(np.uint8) if theirs.dtype == np.uint8 else mine
                shared = np.minimum(theirs, mine[:, None]).sum(0, dtype=np.uint8 if theirs.dtype == np.uint8 and len(v) < 256 else np.int64)
                at = np.flatnonzero(shared >= (least / 2 - 1e-9) * (sizes + len(v)))
                kept = shared[at].astype(np.int64)
                if len(v) <= 64:
                    kept = np.where(sizes[at] <= 64, similar.in_common(v, text[:, at]), kept)
                bound = 2 * kept / (sizes[at] + len(v))
                order = np.argsort(-bound, kind="stable")
                if best := _best(v, zip(bound[order].tolist(), (terms[k] for k in at[order].tolist()), strict=True), least):
                    out.append((v, best[1], best[0]))
            yield _rows(out)

    return run


def _nearest_of_listed(least: float):
    """For each value the most similar of its own listed terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, listed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if best := _best(v, sorted(((similar.indel_ratio(t, v), t) for t in listed), reverse=True), least):
                    out.append((v, best[1], best[0]))
            yield _rows(out)

    return run


def nearest(values: DataFrame, terms: DataFrame, tables: shared.Tables, least: float = LEAST, block: int = BLOCK_TERMS) -> DataFrame:
    """(value, term, similarity) of distinct values with their nearest other term by matching blocks at ``least`` or more; of equals the last by letters.

    Matching blocks are a common subsequence. So a join that loses no pair of an indel ratio of CLOSE settles all values with
    a term at CLOSE or more: no other term is as near. Most have one. The closest ratio comes first, since a value that has
    a term there needs none of the many pairs at the next. (At a ratio of 0.6 strings needn't share any two letters
    in a row, so that such a join would make nearly all pairs.) For the others the vocabulary goes out in blocks of bounded
    size, each against these values, which stay where they are; a value's best of each block meet in a sum. The letters that
    two strings have in common bound their matching blocks, and so does their longest common subsequence; the likeliest terms
    come first, and few pairs are compared in full.
    """
    spark, out = values.sparkSession, None
    cores = spark.sparkContext.defaultParallelism
    some = tables.write(values.select("value").where("value <> ''").distinct().repartition(cores), "distinct")
    known = tables.write(terms.select("term").where("term <> ''").distinct(), "known")
    kind = lambda df, c: df.select(F.lit(0).alias("kind"), F.col(c).alias("t"))
    settled = []
    for close in sorted({max(least, c) for c in CLOSE}, reverse=True):
        pairs = similar.near_pairs(kind(some, "value"), close, tables, kind(known, "term"), 0).groupBy("a").agg(F.collect_list("b").alias("terms"))
        settled.append(tables.write(pairs.mapInArrow(_nearest_of_listed(close), _NEAREST), "close"))
        if close > least:
            some = tables.write(some.join(settled[-1], "value", "left_anti").repartition(cores), "distant")
    near = reduce(DataFrame.unionByName, settled)
    if close == least:
        return near
    held: list[str] = []

    def ask(listed: list[str]) -> DataFrame:
        sent = spark.sparkContext.broadcast(listed)
        found = tables.write(some.mapInArrow(_matcher(sent, least), _NEAREST), "near")
        sent.destroy()
        return found

    for r in known.toLocalIterator():
        held.append(r.term)
        if len(held) == block:
            out = ask(held) if out is None else out.unionByName(ask(held))
            held = []
    if held or out is None:
        out = ask(held) if out is None else out.unionByName(ask(held))
    best = out.groupBy("value").agg(F.max(F.struct("similarity", "term")).alias("x"))
    return near.unionByName(best.select("value", "x.term", "x.similarity"))


def sorted_out(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", values: str = "values", least: float = LEAST) -> DataFrame:
    """A row for each document: ``valid`` (its values that are terms), ``replaced`` (value, nearest term) and ``suggested`` (values without a near term), each sorted.

    Compared without case and blanks at the ends; null and empty values are none. The vocabulary is (term); documents with
    one value don't meet in one task, since only distinct values are compared and sums by document gather its own.
    """
    tables = shared.Tables(docs.sparkSession, "vocabulary")
    known = tables.write(terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct(), "terms")
    mine = tables.write(docs.select(F.col(doc_id).alias("_id"), F.explode(F.array_distinct(F.transform(values, lambda x: F.lower(F.trim(x))))).alias("value")).where("value <> ''"), "values")
    odd = tables.write(mine.select("value").distinct().join(known.select(F.col("term").alias("value")), "value", "left_anti"), "odd")
    near = tables.write(nearest(odd, known, tables, least).select("value", F.col("term").alias("near")), "near")
    found = mine.join(known.select(F.col("term").alias("value"), F.lit(True).alias("valid")), "value", "left").join(near, "value", "left")
    of = lambda test, x, name: F.array_sort(F.collect_list(F.when(test, x))).alias(name)
    pair = F.struct("value", "near")
    by_doc = found.groupBy("_id").agg(of(F.col("valid"), F.col("value"), "valid"), of(F.col("valid").isNull() & F.col("near").isNotNull(), pair, "replaced"), of(F.col("valid").isNull() & F.col("near").isNull(), F.col("value"), "suggested"))
    out = docs.select(F.col(doc_id).alias("_id")).join(by_doc, "_id", "left")
    empty = F.array().cast("array<string>")
    return tables.keep(out.select(F.col("_id").alias(doc_id), F.coalesce("valid", empty).alias("valid"), F.coalesce("replaced", F.array().cast("array<struct<value:string,near:string>>")).alias("replaced"), F.coalesce("suggested", empty).alias("suggested")))


def common_words(spark, sf_dir: str, least: int = 20) -> DataFrame:
    """(term): the words of five letters or more that stand in ``least`` documents or more, as a vocabulary."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("term")


@query("vocabulary_terms", r"""WITH d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[A-Z][a-z]{4,}'), lambda x: lower(x))) AS v FROM documents),
t AS (SELECT term FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) AS term FROM documents) GROUP BY term HAVING count(*) >= 20), l AS (SELECT list(term) AS l FROM t)
SELECT doc_id, list_sort(list_filter(v, lambda x: list_contains(coalesce(l, []), x))) AS valid, len(list_filter(v, lambda x: NOT list_contains(coalesce(l, []), x)))::INT AS others FROM d, l""")
def vocabulary_terms(spark, sf_dir):
    """The capitalised words of each text that are common words of all texts, and how many others there are, with a near term or none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0)).alias("values"))
    out = sorted_out(docs, common_words(spark, sf_dir))
    return out.select("doc_id", "valid", (F.size("replaced") + F.size("suggested")).alias("others"))


@query("closest_terms")
def closest_terms(spark, sf_dir):
    """The capitalised words of all texts with the nearest common word."""
    values = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))).alias("value")).select(F.lower("value").alias("value")).distinct()
    tables = shared.Tables(spark, "closest")
    return tables.keep(nearest(values, common_words(spark, sf_dir), tables))
