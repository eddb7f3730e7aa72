"""A BM25 index that changes: segments of documents, tombstones, merges by size, and a manifest that is replaced at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import shared
from textloom.functions import text
from textloom.registry import spread

#: So many segments of one size class (their rows within this factor) become one.
FANOUT = 4
#: Documents whose words are counted at once.
ROWS = 256


@dataclass
class Manifest:
    """What makes up the index at one time. A tombstone hides its documents in all segments of a smaller place."""

    number: int = 0
    segments: list[list[int]] = field(default_factory=list)  # folder, place, documents
    tombstones: list[int] = field(default_factory=list)  # folder and place
    statistics: int = 0  # folder of the live documents' terms
    documents: int = 0
    words: int = 0


def once(docs: DataFrame) -> DataFrame:
    """One row of each doc_id. Only rows of repeated ones are shuffled with their texts: which these are is a count of the ids alone."""
    again = shared.written(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    return docs.join(again, "doc_id", "left_anti").unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, doc_id, tf, dl) of (doc_id, words): a document's words are in one row, so that counting them needs no shuffle."""
    for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().dictionary_encode()
        n = max(1, len(flat.dictionary))
        pair, tf = np.unique(np.repeat(np.arange(len(ids)), size) * n + flat.indices.to_numpy(), return_counts=True)
        doc, term = pair // n, pair % n
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(term)), pa.array(ids[doc], pa.int64()), pa.array(tf, pa.int64()), pa.array(size[doc], pa.int32())], ["term", "doc_id", "tf", "dl"])


class Segments:
    """An index in a folder that the cluster shares. Readers take a manifest and are not disturbed by later changes; ``vacuum`` deletes what no newer manifest names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # The manifest

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-"))

    def manifest(self, number: int | None = None) -> Manifest:
        """The last one, or that of a number; an empty one if there is none."""
        numbers = self._numbers()
        if not numbers:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.folder}/manifest-{numbers[-1] if number is None else number:09}"))
        try:
            return Manifest(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, m: Manifest) -> Manifest:
        """Renames a written file to the next manifest's name; fails if another writer was first, whose manifest then stays."""
        whole, part = self._path(f"{self.folder}/manifest-{m.number:09}"), self._path(f"{self.folder}/new-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(json.dumps(asdict(m)).encode())
        out.close()
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            self._fs.delete(part, False)
            raise RuntimeError(f"another writer has made manifest {m.number}")
        return m

    # Tables

    POSTINGS, FORWARD, TERMS = "term string, doc_id long, tf long, dl int", "doc_id long, dl int, terms array<string>", "term string, df long, idf double"

    def _read(self, kind: str, of: list[list[int]], schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/{x[0]}").withColumn("place", F.lit(x[1])) for x in of]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, place int")

    def _live(self, rows: DataFrame, m: Manifest) -> DataFrame:
        if not m.tombstones:
            return rows.drop("place")
        dead = self._read("dead", [[t, t] for t in m.tombstones], "doc_id long").groupBy("doc_id").agg(F.max("place").alias("dead"))
        return rows.join(dead, "doc_id", "left").where("dead is null or dead <= place").select(*[c for c in rows.columns if c != "place"])

    def postings(self, m: Manifest | None = None) -> DataFrame:
        """(term, doc_id, tf, dl) of the live documents. Sorted by term and document, so that a search reads its terms' row groups and a common term lies in many files."""
        m = m or self.manifest()
        return self._live(self._read("postings", m.segments, self.POSTINGS), m)

    def terms(self, m: Manifest | None = None) -> DataFrame:
        """(term, df, idf) of the live documents; a negative idf becomes a quarter of the mean one."""
        m = m or self.manifest()
        return self.spark.read.schema(self.TERMS).parquet(f"{self.folder}/idf/{m.statistics}") if m.statistics else self.spark.createDataFrame([], self.TERMS)

    def _write_terms(self, m: Manifest, changes: list[DataFrame]) -> None:
        """The live documents' terms: those of before, more and less those of ``changes`` (term, df). No posting is read."""
        df = reduce(DataFrame.unionByName, changes, self.terms(m).select("term", "df")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = shared.written(df.withColumn("raw", F.log(F.lit(m.documents) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "idf")
        mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        m.statistics = m.number
        idf = raw.select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.lit(mean)).otherwise(F.col("raw")).alias("idf"))
        idf.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.folder}/idf/{m.number}")

    def _write_segment(self, m: Manifest, place: int, forward: DataFrame, posted: DataFrame) -> list[int]:
        at = f"{self.folder}/{{}}/{m.number}"
        forward.write.mode("overwrite").parquet(at.format("forward"))
        posted.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(at.format("postings"))
        return [m.number, place, self.spark.read.parquet(at.format("forward")).count()]

    # Changes

    def _hide(self, m: Manifest, ids: DataFrame) -> list[DataFrame]:
        """Adds a tombstone for those of ``ids`` (doc_id) that are live, and takes them off the sums; their terms, less."""
        live = self._live(self._read("forward", m.segments, self.FORWARD), m)
        gone = shared.written(live.join(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi"), "gone")
        n, words = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return []
        gone.select("doc_id").write.mode("overwrite").parquet(f"{self.folder}/dead/{m.number}")
        m.tombstones.append(m.number)
        m.documents, m.words = m.documents - n, m.words - words
        return [gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))]

    def add(self, docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> Manifest:
        """Adds documents as a segment; those whose doc_id is known replace the old ones. Rows without a doc_id don't count, of a doc_id's rows any one does; a null text has no words."""
        m = self.manifest()
        m.number += 1
        words = once(spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(body).alias("body"))).where("doc_id is not null"))
        words = shared.written(words.select("doc_id", F.coalesce(text.tokens(F.col("body")), F.array().cast("array<string>")).alias("words")), "words")
        n, total = words.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        if n:
            changes = self._hide(m, words)
            posted = words.select("doc_id", "words").mapInArrow(counted, self.POSTINGS)
            m.segments.append(self._write_segment(m, m.number, words.select("doc_id", F.size("words").alias("dl"), F.array_distinct("words").alias("terms")), posted))
            m.documents, m.words = m.documents + n, m.words + total
            new = self.spark.read.schema(self.FORWARD).parquet(f"{self.folder}/forward/{m.number}").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
            self._write_terms(m, [*changes, new])
        self._commit(m)
        return self.merge()

    def delete(self, ids: DataFrame) -> Manifest:
        """Hides the documents of ``ids`` (doc_id); unknown ones don't matter."""
        m = self.manifest()
        m.number += 1
        if changes := self._hide(m, ids):
            self._write_terms(m, changes)
        return self._commit(m)

    def merge(self) -> Manifest:
        """While a size class has FANOUT segments or more, makes one of them, without hidden documents; tombstones that hide nothing any more go.

        A document is rewritten once for each size class, of which there are as many as the logarithm of all documents. The
        merged segment takes the last one's place: all tombstones up to there have been applied to it. Sums don't change.
        """
        m = self.manifest()
        while some := _crowded(m.segments):
            m.number += 1
            forward, posted = (self._live(self._read(kind, some, schema), m) for kind, schema in (("forward", self.FORWARD), ("postings", self.POSTINGS)))
            merged = self._write_segment(m, max(x[1] for x in some), forward, posted)
            m.segments = [x for x in m.segments if x not in some] + [merged]
            m.tombstones = [t for t in m.tombstones if any(x[1] < t for x in m.segments)]
            self._commit(m)
        return m

    def vacuum(self) -> int:
        """Deletes the tables and manifests that the last manifest doesn't need; how many. Readers of older ones must be done."""
        m, n = self.manifest(), 0
        needed = {"postings": {x[0] for x in m.segments}, "forward": {x[0] for x in m.segments}, "dead": set(m.tombstones), "idf": {m.statistics}}
        for kind, keep in needed.items():
            if self._fs.exists(self._path(f"{self.folder}/{kind}")):
                for f in self._fs.listStatus(self._path(f"{self.folder}/{kind}")):
                    if int(f.getPath().getName()) not in keep:
                        n += self._fs.delete(f.getPath(), True)
        for number in self._numbers()[:-1]:
            n += self._fs.delete(self._path(f"{self.folder}/manifest-{number:09}"), False)
        return n


def _crowded(segments: list[list[int]]) -> list[list[int]]:
    """The segments of the smallest size class that has FANOUT of them."""
    classes: dict[int, list[list[int]]] = {}
    for x in segments:
        size = 0
        while FANOUT ** (size + 1) <= x[2]:
            size += 1
        classes.setdefault(size, []).append(x)
    return next((some for _, some in sorted(classes.items()) if len(some) >= FANOUT), [])
