"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents on their rarest shingles."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.filters import bit_filter, passes
from textloom.llm.scratch import Scratch, as_row, lean
from textloom.llm.toxicity import _WORDS

#: Words of a window, and of a shingle.
WINDOW, SHINGLE = 13, 5
#: A document is contaminated if one in so many of its words is hit.
SHARE = 20
#: Bytes whose words are hashed in one go.
_PIECE = 1 << 20
_BASE, _NEXT, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=None)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Words:
    """The words of a batch of texts, one after the other: where each starts and ends, its text, and its 64-bit hash."""

    def __init__(self, texts: list[bytes | None]):
        self.raw = b" ".join(x.translate(_WORDS) if x else b"" for x in texts) + b" "
        size = np.fromiter((len(x) + 1 if x else 1 for x in texts), np.int64, len(texts))
        starts, ends, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(self.raw):
            stop = self.raw.rfind(b" ", at, at + _PIECE) + 1 or self.raw.index(b" ", at + _PIECE - 1) + 1
            piece = np.frombuffer(self.raw, np.uint8, stop - at, at)
            inside = np.concatenate([[0], (piece != 32).view(np.int8), [0]])
            edge = np.diff(inside)
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            power, inverse = _powers(max(1 << 16, 1 << int(len(piece)).bit_length()))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece.astype(np.uint64) * power[: len(piece)], dtype=np.uint64)])
            h = (sums[e] - sums[s]) * inverse[s]
            h = (h ^ (h >> np.uint64(29)) ^ (e - s).astype(np.uint64)) * _MIX
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(h ^ (h >> np.uint64(32)))
            at = stop
        self.start, self.end, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.text = np.searchsorted(np.cumsum(size), self.start, "right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of those words that a shingle of n words of one text starts with, and the shingles' hashes."""
        k = max(0, len(self.hash) - n + 1)
        h = np.full(k, np.uint64(n))
        for j in range(n):
            h = (h ^ self.hash[j : j + k]) * _NEXT
            h ^= h >> np.uint64(31)
        p = np.flatnonzero(self.text[:k] == self.text[n - 1 : n - 1 + k])
        return p, h[p]

    def between(self, s: int, e: int) -> str:
        """The words s to e, a blank between two."""
        return b" ".join(self.raw[self.start[s] : self.end[e - 1]].split()).decode()


def _windows(window: int, shingle: int):
    """Of each item its windows, and of each window its shingles: (item, wid, n, words, at, h)."""

    def run(batches):
        for b in batches:
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = Words([raw])
                k = len(w.start)
                if not k:
                    continue
                n = min(window, k)
                m = min(shingle, n)
                _, h = w.shingles(m)
                rows = [[], [], [], []]
                for s in range(k - n + 1):
                    text = w.between(s, s + n)
                    rows[0] += [hashlib.md5(text.encode()).digest()] * (n - m + 1)
                    rows[1] += [text] * (n - m + 1)
                    rows[2] += range(n - m + 1)
                    rows[3] += h[s : s + n - m + 1].view(np.int64).tolist()
                for at in range(0, len(rows[0]), 10_000):
                    wid, text, offset, hashes = (r[at : at + 10_000] for r in rows)
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(wid), pa.string()), pa.array(wid, pa.binary()), pa.array([n] * len(wid), pa.int32()), pa.array(text, pa.string()), pa.array(offset, pa.int32()), pa.array(hashes, pa.int64())], ["item", "wid", "n", "words", "at", "h"])

    return run


def _counts(bits, lengths: tuple[int, ...]):
    """Of each batch, in how many texts each shingle occurs that the filter lets pass."""

    def run(batches):
        for b in batches:
            w, seen = Words(b.column(0).to_pylist()), [np.zeros(0, np.uint64)]
            for n in lengths:
                p, h = w.shingles(n)
                on = passes(bits.value, h)
                seen.append(np.unique(np.stack([h[on], w.text[p[on]].astype(np.uint64)]), axis=1)[0])
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "texts"])

    return run


def _places(bits, lengths: tuple[int, ...], window: int):
    """Of each text the places of shingles that the filter lets pass: (key, h, at: words before it, around: the words that a window over it can hold, off: its own place there)."""

    def run(batches):
        for b in batches:
            keys, w = b.column(0).to_pylist(), Words(b.column(1).to_pylist())
            rows = [[], [], [], [], []]
            for n in lengths:
                p, h = w.shingles(n)
                on = passes(bits.value, h)
                for place, hashed in zip(p[on].tolist(), h[on].view(np.int64).tolist(), strict=True):
                    t = w.text[place]
                    s, e = max(w.first[t], place - window + 1), min(w.first[t + 1], place + window)
                    for col, x in zip(rows, (keys[t], hashed, place - w.first[t], w.between(s, e), place - s), strict=True):
                        col.append(x)
            for at in range(0, len(rows[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(r[at : at + 5000], t) for r, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], ["key", "h", "at", "around", "off"])

    return run


def prefixes(benchmark: DataFrame, docs: DataFrame, scratch: Scratch, *, item_id: str = "item_id", item_text: str = "text", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, tuple[int, ...]]:
    """(wid, item) of all windows; (h, wid, n, words, offset), each window's rarest shingle; and the lengths of shingles that there are.

    With a containment of 1, one shingle is a necessary prefix. Rarity is the number of documents with it, over all of them.
    """
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("binary").alias("text"))
    rows = scratch.write(items.mapInArrow(lean(_windows(window, shingle)), "item string, wid binary, n int, words string, at int, h long"), "windows")
    lengths = tuple(sorted(r.m for r in rows.select(F.least("n", F.lit(shingle)).alias("m")).distinct().collect()))  # 1 to shingle
    owners = rows.select("wid", "item").distinct()
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(rows, "h"))
    counts = docs.select(F.col(text).cast("binary")).where(F.length(text) > 0).mapInArrow(lean(_counts(bits, lengths)), "h long, texts long").groupBy("h").agg(F.sum("texts").alias("texts"))
    ranked = rows.select("wid", "n", "words", "at", "h").distinct().join(counts, "h", "left")
    best = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "h", "at", "n", "words")).alias("x"))
    chosen = best.select("wid", F.col("x.h").alias("h"), F.col("x.n").alias("n"), F.col("x.words").alias("words"), F.col("x.at").alias("offset"))
    return owners, scratch.write(chosen, "prefixes"), lengths


def _covered(spans: Column) -> Column:
    """How many places intervals [s, s + n) cover, given sorted by s."""
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["s"] + x["n"]).alias("end"), (acc["sum"] + F.greatest(F.lit(0), x["s"] + x["n"] - F.greatest(acc["end"], x["s"]))).alias("sum"))
    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum")), step, lambda acc: acc["sum"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with n_words, n_hit, items (sorted strings) and contaminated.

    Windows and texts meet in a join on the windows' rarest shingles; a shingle's place in text and window bounds where the
    window must lie, and its words are compared there. Neither benchmark nor texts pass through the driver: what is
    broadcast are filters of fixed size. Equal texts are judged once. A null or wordless text has no words and isn't
    contaminated; items without words never match; items of one id are one item, a null id counts as "null". An empty
    benchmark hits nothing; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    key = F.unhex(F.md5(F.col(text).cast("binary"))).alias("key")
    owners, chosen, lengths = prefixes(benchmark, docs, scratch, item_id=item_id, item_text=item_text, text=text, window=window, shingle=shingle)
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(chosen, "h"))
    places = docs.where(F.length(text) > 0).select(key, F.col(text).cast("binary").alias("text")).mapInArrow(lean(_places(bits, lengths, window)), "key binary, h long, at long, around string, off int")
    met = places.groupBy("key", "h", "at").agg(F.first("around").alias("around"), F.first("off").alias("off")).join(chosen, "h")
    inside = (F.col("off") >= F.col("offset")) & (F.col("at") >= F.col("offset"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("off") - F.col("offset") + 1, F.col("n")), " ") == F.col("words")
    hits = scratch.write(met.where(inside).where(same).select("key", (F.col("at") - F.col("offset")).alias("s"), F.col("n").cast("long").alias("n"), "wid").distinct(), "hits")
    covered = hits.groupBy("key").agg(_covered(F.array_sort(F.collect_set(F.struct("s", "n")))).alias("n_hit"))
    named = hits.select("key", "wid").distinct().join(owners, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = scratch.write(covered.join(named, "key"), "found")
    scratch.drop(*[t for t, _ in list(scratch.paths.values()) if t is not found])
    n_words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++")), F.lit(0)).cast("long")
    rows = docs.select(as_row(docs), key, n_words.alias("n_words")).join(found, "key", "left")
    out = rows.select("row", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 and {SHARE} * n_hit >= n_words"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, benchmark)
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_WORDS = rf"regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM b)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
occ AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, p, item_id FROM occ JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
