"""A cleaning pipeline over documents; each stage is one operator of textloom.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, lines, simhash, toxicity
from textloom.llm.scratch import Scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity models, fitted on the labels of these documents, predict to be toxic. Null and empty texts hold no evidence and stay; equal texts stay or go together."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity_scores(docs, labels, order=2).where("predicted = 0").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each source's boilerplate lines; n_chars becomes the new length. No document goes; a null text or source stays as it is."""
    out = lines.drop_boilerplate(docs, Scratch(spark, "lines"))
    value = {"text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return out.select(*(value.get(c, F.col(f"row.`{c}`")) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group; rows without a doc_id stay, of a repeated doc_id all stay or go. Null and empty texts have fingerprint zero and are one group."""
    gone = simhash.simhash_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents. Null and wordless texts hold no item and stay; equal texts stay or go together, each row for itself; an empty benchmark drops nothing."""
    return decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's token ids and of their decoded text, a row for each document, also of null and empty texts."""
    return bpe.encode_decode(docs)


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_boilerplate), ("simhash", near_duplicates), ("decontaminate", decontaminated), ("bpe", encode)]
#: No SQL: the first and third stages can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again as the next one's documents."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        made = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.drop(docs)
        docs = made
    return docs
