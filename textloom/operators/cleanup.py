"""Clean-up of chats, manuals and notes, and concepts linked to a document's lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.registry import query, spread, table, typed

#: Sentences of assistants that say nothing.
BOILERPLATE = (r"(?im)^[ \t]*(as an ai( language)? model,?|i hope this helps[.!]?|let me know if you have (any )?(other |more )?questions[.!]?|is there anything else i can help you with\??|sure[,!]? here('s| is)|certainly[,!]?)[ \t]*$\n?",)
#: Texts that are changed at once.
ROWS = 256
_FENCED = re.compile(r"(?ms)^```.*?^```[ \t]*$")


def outside_code(text: str, change: Callable[[str], str]) -> str:
    """Applies a change to a text but for its fenced code."""
    out, at = [], 0
    for m in _FENCED.finditer(text):
        out += [change(text[at : m.start()]), m[0]]
        at = m.end()
    return "".join([*out, change(text[at:])])


def chat_clean(text: str) -> str:
    """Without boilerplate sentences and repeated role marks; code stays."""

    def change(part: str) -> str:
        for p in BOILERPLATE:
            part = re.sub(p, "", part)
        part = re.sub(r"(?im)^((?:user|assistant)\s*:)\s*\n(?:\s*\1\s*\n)+", r"\1\n", part)
        return re.sub(r"\n{3,}", "\n\n", part)

    return outside_code(text, change).strip()


def manual_clean(text: str) -> str:
    """Without a table of contents, page numbers, and copyright lines after the first if there are over two; code stays."""
    marks = len(re.findall(r"(?im)^.*(?:©|copyright).*$", text))
    seen = 0

    def once(m: re.Match) -> str:
        nonlocal seen
        seen += 1
        return m[0] if seen == 1 or marks <= 2 else ""

    def change(part: str) -> str:
        part = re.sub(r"(?im)^.*\.{4,}\s*\d+\s*$\n?", "", part)
        part = re.sub(r"(?im)^\s*table of contents\s*$\n?", "", part)
        part = re.sub(r"(?im)^\s*(?:page\s+)?\d+(?:\s+of\s+\d+)?\s*$\n?", "", part)
        part = re.sub(r"(?im)^.*(?:©|copyright).*$", once, part)
        return re.sub(r"\n{3,}", "\n\n", part)

    return outside_code(text, change).strip()


def paragraphs(text: str) -> str:
    """A blank line between plain lines; lists, tables, quotes, headings and code stay together."""

    def change(part: str) -> str:
        plain = r"(?![ \t]*(?:[-*+>|#]|\d+\.))[^\n]+"
        return re.sub(rf"(?m)^({plain})\n(?={plain})", r"\1\n\n", part)

    return outside_code(text, change)


def as_column(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as an Arrow-batched Column function; null stays null."""

    def column(c: Column) -> Column:
        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(change, na_action="ignore")

        return run(c)

    return column


def changed_batches(change: Callable[[str], str], place: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ROWS rows at most whose column at ``place`` is changed; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            columns = list(b.columns)
            columns[place] = pa.array([None if x is None else change(x) for x in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return run


def changed_rows(df: DataFrame, change: Callable[[str], str], body: str = "body") -> DataFrame:
    """``df`` with its column ``body`` changed, ROWS texts at once: a task holds so many, whatever the batches."""
    return df.mapInArrow(changed_batches(change, df.columns.index(body)), df.schema)


@query("chat_cleanup")
def chat_cleanup(spark, sf_dir):
    return changed_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.lit("\nI hope this helps!")).alias("body")), chat_clean)


@query("manual_cleanup")
def manual_cleanup(spark, sf_dir):
    return changed_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat(F.lit("Table of Contents\nA ....... 1\n"), "text").alias("body")), manual_clean)


@query("paragraph_format")
def paragraph_format(spark, sf_dir):
    return changed_rows(spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))), paragraphs)


def linked_concepts(docs: DataFrame, field: str, concepts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, linked): the concepts (label, concept) of a list field, sorted; an empty list if none is known."""
    one = docs.select(doc_id, F.explode(F.array_distinct(field)).alias("label")).join(concepts.select(F.lower("label").alias("key"), "concept"), F.lower("label") == F.col("key"))
    found = one.groupBy(doc_id).agg(F.array_sort(F.collect_set("concept")).alias("linked"))
    return docs.select(doc_id).join(found, doc_id, "left").select(doc_id, F.coalesce("linked", F.array().cast("array<string>")).alias("linked"))


@query("linked_concepts", "SELECT doc_id, list_sort(list_filter([CASE source WHEN 'src1' THEN 'one' WHEN 'src2' THEN 'two' END, CASE lang WHEN 'de' THEN 'german' END], lambda x: x IS NOT NULL)) AS linked FROM documents")
def linked_concepts_query(spark, sf_dir):
    concepts = spark.createDataFrame([("SRC1", "one"), ("src2", "two"), ("De", "german")], "label string, concept string")
    return linked_concepts(table(spark, sf_dir, "documents").withColumn("tags", F.array("source", "lang")), "tags", concepts)


@query("operation_tracking", typed("SELECT event_type, count(*) AS calls, sum((value > 50)::INT) AS slow, round(avg(value), 6) AS mean, max(ts) AS last FROM events GROUP BY event_type", slow="BIGINT"))
def operation_tracking(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum((F.col("value") > 50).cast("int")).alias("slow"), F.round(F.avg("value"), 6).alias("mean"), F.max("ts").alias("last"))


@query("prompts", "SELECT doc_id, 'Title: ' || source || chr(10) || 'Language: ' || lang || chr(10) || 'Which of these dates need action? Answer with a list.' AS prompt FROM documents")
def prompts(spark, sf_dir):
    """A prompt built from a document's fields."""
    return table(spark, sf_dir, "documents").select("doc_id", F.format_string("Title: %s\nLanguage: %s\nWhich of these dates need action? Answer with a list.", "source", "lang").alias("prompt"))
