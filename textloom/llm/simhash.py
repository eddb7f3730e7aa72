"""SimHash near-duplicates: exact tiled comparison of all fingerprints within a small radius."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.components import components, forest
from textloom.llm.scratch import Scratch, lean

BITS = 64
SHINGLE, RADIUS, SEED, TILE = 3, 3, 42, 1024
#: bits of each byte value, lowest first
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SPACE, _PART = re.compile(rb"[\x20\x09-\x0d]"), 1 << 22


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces cut at white space, so that only one piece's words are held at a time."""
    at = 0
    while len(raw) - at > _PART:
        cut = _SPACE.search(raw, at + _PART)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:] if at else raw


def fingerprint(raw: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is set if over half of the shingles' XXH64 have it; no words give 0."""
    if not raw:
        return 0
    counts, n, words, digest = np.zeros(BITS, np.int64), 0, [], xxhash.xxh64_intdigest
    for part in _parts(raw):
        words = words[max(0, len(words) - shingle + 1) :] + part.lower().split()
        m = len(words) - shingle + 1
        if m < 1:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = (ends[:m] - [len(w) for w in words[:m]]).tolist()
        joined = b" ".join(words)
        hashes = np.fromiter((digest(joined[s:e], seed) for s, e in zip(begins, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, m)
        octets = hashes.astype("<u8").view(np.uint8).reshape(m, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BITS_OF
        n += m
    if not n:
        return digest(b" ".join(words), seed) if words else 0
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * counts > n)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; other columns are left out."""

    def run(batches):
        for b in batches:
            fps = [_signed(fingerprint(x, shingle, seed)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs into a and b (b None: a with itself, i < j) of fingerprints within the radius."""
    a, b = (None if x is None else x.astype(np.int64).view(np.uint64) for x in (a, b))  # bits of signed numbers are counted without their sign
    if b is None:
        i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= radius)
        return i[i < j], j[i < j]
    return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)


def _linked(radius: int):
    """Edges (a, b) between nodes that span the same groups as all links of a tile, or of two tiles."""

    def run(batches):
        for batch in batches:
            left, right = batch.column(0), batch.column(1)
            out_a, out_b = [], []
            for k in range(batch.num_rows):
                rows = left[k].values
                fp, node = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False)
                if right[k].is_valid:
                    rows, n = right[k].values, len(fp)
                    i, j = tile_links(fp, rows.field(0).to_numpy(zero_copy_only=False), radius)
                    node, j = np.concatenate([node, rows.field(1).to_numpy(zero_copy_only=False)]), j + n
                else:
                    i, j = tile_links(fp, None, radius)
                if len(i):
                    root = forest(len(node), i, j)
                    own = np.flatnonzero(root != np.arange(len(node)))
                    out_a.append(node[own])
                    out_b.append(node[root[own]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def fingerprint_links(classes: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) spanning every group of ``classes`` (fp, node) whose fingerprints differ in at most ``radius`` bits.

    Two such fingerprints agree in one of radius + 1 bands of bits, so tiles are made among the fingerprints that share
    a band's value. A value with more than ``tile`` fingerprints is laid out by population count in several tiles; two
    tiles meet only if their population counts come within the radius. Tiles are compared whole, so no link is lost.
    """
    n, at = radius + 1, [BITS * k // (radius + 1) for k in range(radius + 2)]
    band = lambda k: F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("fp", at[k]).bitwiseAND(F.lit((1 << (at[k + 1] - at[k])) - 1 if at[k + 1] - at[k] < 64 else -1)).alias("value"))
    keyed = classes.select("fp", "node", F.bit_count("fp").alias("pc"), F.explode(F.array(*map(band, range(n)))).alias("g")).select("fp", "node", "pc", "g.band", "g.value")
    counts = keyed.groupBy("band", "value", "pc").agg(F.count("*").alias("n"))
    counts = scratch.write(counts, "popcounts")
    large = counts.groupBy("band", "value").agg(F.sum("n").alias("size")).where(F.col("size") > tile).drop("size")
    before = Window.partitionBy("band", "value").orderBy("pc").rowsBetween(Window.unboundedPreceding, -1)
    laid = scratch.write(counts.join(large, ["band", "value"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "large")
    tiles = (
        keyed.join(laid, ["band", "value", "pc"], "left")
        .withColumn("tile", F.when(F.col("n").isNull(), 0).otherwise(F.floor((F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))) / tile)).cast("long"))
        .groupBy("band", "value", "tile")
        .agg(F.collect_list(F.struct("fp", "node")).alias("members"), F.min("pc").alias("low"), F.max("pc").alias("high"), F.max(F.col("n").isNotNull()).alias("split"))
        .where("split or size(members) > 1")
    )
    tiles = scratch.write(tiles, "tiles")
    of = lambda s: tiles.where("split").select("band", "value", F.col("tile").alias(f"tile_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
    near = of("a").join(of("b"), ["band", "value"]).where(f"tile_a < tile_b and low_b - high_a <= {radius} and low_a - high_b <= {radius}").select("band", "value", "tile_a", "tile_b")
    side = lambda s: tiles.where("split").select("band", "value", F.col("tile").alias(f"tile_{s}"), F.col("members").alias(f"members_{s}"))
    across = near.join(side("a"), ["band", "value", "tile_a"]).join(side("b"), ["band", "value", "tile_b"]).select("members_a", "members_b")
    within = tiles.select(F.col("members").alias("members_a"), F.lit(None).cast(tiles.schema["members"].dataType).alias("members_b"))
    return within.unionByName(across).mapInArrow(lean(_linked(radius)), "a long, b long")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest doc_id reachable over links.

    Null and blank texts have fingerprint 0 and link like any other. Equal fingerprints are one class. Rows whose doc_id
    is null take part, and have the component of their class (null if the class has no doc_id); a repeated doc_id stays
    repeated. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(fingerprints(docs, doc_id, text, shingle, seed), "fingerprints")
    classes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "classes")
    label = components(fingerprint_links(classes, scratch, radius, tile), scratch)
    by_fp = scratch.write(classes.join(label, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "components")
    return scratch.keep(fps.join(by_fp, "fp", "left").select("doc_id", "fp", "component_id"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
