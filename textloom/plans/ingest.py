"""The ingest chain as one lazy plan: clean, deduplicate, triage, enrich, score, gate, chunk; what stops is kept with its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import dates, scores, text
from textloom.operators.chunking import chunk_table, sliding
from textloom.registry import query, table

Stage = Callable[[DataFrame], DataFrame]


class Chain:
    """Stages in order; each takes and returns documents."""

    def __init__(self, *stages: tuple[str, Stage]):
        self.stages = list(stages)

    def add(self, name: str, stage: Stage, at: int | None = None) -> Chain:
        self.stages.insert(len(self.stages) if at is None else at, (name, stage))
        return self

    def remove(self, name: str) -> Chain:
        self.stages = [s for s in self.stages if s[0] != name]
        return self

    def get(self, name: str) -> Stage | None:
        return dict(self.stages).get(name)

    def __call__(self, docs: DataFrame) -> DataFrame:
        for _, stage in self.stages:
            docs = docs.transform(stage)
        return docs


def stop(docs: DataFrame, test, reason: str) -> DataFrame:
    """Marks documents that go no further; the first reason stays."""
    return docs.withColumn("gate_reason", F.coalesce("gate_reason", F.when(test, reason)))


def cleaned(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("text", text.clean(F.col("text"))).withColumn("gate_reason", F.lit(None).cast("string"))
    return stop(docs, F.coalesce(F.length("text") < 10, F.lit(True)), "too short")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Later copies stop. Sums by hash find the first, so that no group of copies meets in one task. A key that is never null needs no filter, in which each text would be cleaned and hashed once more."""
    docs = docs.withColumn("content_hash", text.content_hash(F.col("text")))
    key = F.coalesce("content_hash", F.lit("")).alias("_key")
    first = docs.groupBy(key).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    docs = docs.select("content_hash", *(c for c in docs.columns if c != "content_hash"), key).join(first, "_key", "left")
    return stop(docs, F.col("content_hash").isNotNull() & (F.col("first_id") < F.col("doc_id")), "duplicate").drop("_key", "first_id")


def triaged(docs: DataFrame) -> DataFrame:
    return stop(docs, scores.junk_count(F.col("text")) >= 2, "junk")


def enriched(docs: DataFrame) -> DataFrame:
    body = F.col("text")
    return docs.withColumns({"language": text.language(body), "dates": dates.absolute_dates(body), "numbers": text.numbers(body), "title": F.substring(F.split(body, "\n")[0], 1, 100), "word_count": text.word_count(body)})


def gated(docs: DataFrame) -> DataFrame:
    q = scores.quality(F.col("text"), structured=F.col("text").contains("#"))
    docs = docs.withColumn("quality", q).withColumn("signal", scores.signal(F.col("quality"), F.lit(0.9), scores.actionability(F.lit(False), F.lit(False), F.lit(False), F.size("dates") > 0)))
    docs = stop(docs, ~scores.gate(F.lit("generic"), F.col("quality"), F.col("signal")), "below the gate")
    return docs.withColumn("do_index", F.col("gate_reason").isNull())


def default_chain() -> Chain:
    return Chain(("clean", cleaned), ("deduplicate", deduplicated), ("triage", triaged), ("enrich", enriched), ("gate", gated))


def chunked(docs: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, position, content, tokens) of the documents that may be indexed; their other fields stay with the document."""
    rows = chunk_table(docs.where("do_index"), sliding)
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("position").cast("string")).alias("chunk_id"), "doc_id", "position", "content", "tokens")


@query("ingest_outcome", "WITH d AS (SELECT doc_id, text, sha256(text) AS h FROM documents), f AS (SELECT doc_id, length(text) AS n, min(doc_id) OVER (PARTITION BY h) < doc_id AS dup FROM d) SELECT doc_id, CASE WHEN n < 10 THEN 'too short' WHEN dup THEN 'duplicate' END AS early FROM f")
def ingest_outcome(spark, sf_dir):
    """What the first stages stop."""
    docs = table(spark, sf_dir, "documents").withColumn("gate_reason", F.lit(None).cast("string"))
    docs = deduplicated(stop(docs, F.length("text") < 10, "too short"))
    return docs.select("doc_id", F.col("gate_reason").alias("early"))


@query("ingest_documents")
def ingest_documents(spark, sf_dir):
    """The whole chain: one row for each document with its fields and, if it stopped, why."""
    return default_chain()(table(spark, sf_dir, "documents")).drop("text")


@query("ingest_chunks")
def ingest_chunks(spark, sf_dir):
    return chunked(default_chain()(table(spark, sf_dir, "documents")))
