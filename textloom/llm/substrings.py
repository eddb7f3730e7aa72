"""Repeated long substrings over a whole corpus, by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch, small_batches

#: Bytes of a repeated string; of the grams whose buckets are the first; contexts of a bucket that one task refines at most.
LENGTH, GRAM, CONTEXTS = 400, 32, 512
#: Positions that are looked at in one piece, and bytes that are refined in one go.
_PIECE, _GO = 1 << 22, 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]
_POS = np.uint64((1 << 24) - 1)


def _loads(raw: bytes, n: int) -> np.ndarray:
    """The eight bytes at each of the first n positions, as integers."""
    return np.ndarray((n,), "<u8", raw, 0, (1,)).copy()


def gram_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position."""
    n = len(raw) - GRAM + 1
    eight = _loads(raw, len(raw) - 7)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        h = (h ^ (eight[8 * k : 8 * k + n] * _MIX[k])) * _MIX[4]
        h ^= h >> np.uint64(31)
    return h


def anchors(raw: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(hash, position, first start, last start): the strings of ``length`` bytes that start in between have that gram as their least one.

    Which gram that is depends on a string's own bytes only (least hash, then the leftmost), so equal strings have equal
    grams at equal distances; every start has exactly one.
    """
    for at in range(0, len(raw) - length + 1, _PIECE):
        piece = raw[at : at + _PIECE + length - 1] if len(raw) > _PIECE + length - 1 else raw
        h, w, n = gram_hashes(piece), length - GRAM + 1, len(piece) - length + 1
        key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        wide = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        wide[: len(key)] = key
        blocks = wide.reshape(-1, w)
        before, after = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        p = least[first]
        yield from zip(h[p].view(np.int64).tolist(), (p + at).tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)


def _buckets(key: np.ndarray) -> np.ndarray:
    """A bucket for each key that occurs twice or more, -1 for the others."""
    out = np.full(len(key), -1, np.int64)
    if not len(key):
        return out
    slots = ((key.astype(np.uint64) * _MIX[0]) >> np.uint64(64 - max(1, len(key).bit_length() + 2))).astype(np.int64)
    some = np.flatnonzero(np.bincount(slots)[slots] > 1)  # the others are alone for sure
    _, bucket, n = np.unique(key[some], return_inverse=True, return_counts=True)
    out[some] = np.where(n[bucket] > 1, bucket, -1)
    return out


def refine(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """For each text, which of its starts have a string of ``length`` bytes that also starts elsewhere in ``texts``.

    The first buckets are those of the grams' hashes. A position's bucket for twice the bytes is found by sorting on the
    pointers to the buckets of itself and of the position that many bytes later; buckets of one leave the sort, and what a
    round finds is the next one's input. The last round overlaps, to end at ``length`` exactly. A wrong match would need
    64-bit collisions of all ``length / gram`` grams of two strings.
    """
    raw = b"".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    name, known = np.full(len(raw) + length, -1, np.int64), min(gram, length)
    if len(raw) >= gram:
        room = np.repeat(ends, size) - np.arange(len(raw))  # bytes up to the end of the own text
        p = np.flatnonzero(room >= known)
        name[p] = _buckets(gram_hashes(raw)[p])
        while known < length:
            step = min(known, length - known)
            p = np.flatnonzero(name[: len(raw)] >= 0)
            p = p[(name[p + step] >= 0) & (room[p] >= known + step)]
            bucket = _buckets(name[p] << 32 | name[p + step])
            name = np.full(len(name), -1, np.int64)
            name[p] = bucket
            known += step
    return [name[e - s : max(e - s, e - length + 1)] >= 0 for s, e in zip(size.tolist(), ends.tolist(), strict=True)]


def _first(length: int):
    """Of each row its class (MD5 of the text), length and SHA-256, and the anchors of its text."""

    def run(batches):
        for b in batches:
            doc, anchor = [], [[], [], [], [], [], []]
            for d, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = x.as_py() or b""
                c = hashlib.md5(raw).digest()
                doc.append((d, c, len(raw), hashlib.sha256(raw).hexdigest()))
                if len(raw) >= length:
                    for h, p, u, v in anchors(raw, length):
                        w = xxhash.xxh3_64_intdigest(raw[u : v + length])
                        for col, val in zip(anchor, (c, h, p, p - v, p - u, w - (1 << 64) if w >> 63 else w), strict=True):
                            col.append(val)
            n = len(doc)
            cols = list(zip(*doc, strict=True)) or [()] * 4
            types = (pa.int64(), pa.binary(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names)
            n = len(anchor[0])
            if n:
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(anchor[0], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *(pa.array(a, t) for a, t in zip(anchor[1:], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True))], names)

    names = ["doc_id", "c", "n", "sha", "g", "pos", "l0", "l1", "w"]
    return run, "doc_id long, c binary, n long, sha string, g long, pos long, l0 int, l1 int, w long"


_CONTEXT = "g long, c binary, rep long, pos long, l0 int, l1 int, contexts long, ctx binary"
_CONTEXT_ARROW = pa.schema([("g", pa.int64()), ("c", pa.binary()), ("rep", pa.int64()), ("pos", pa.int64()), ("l0", pa.int32()), ("l1", pa.int32()), ("contexts", pa.int64()), ("ctx", pa.binary())])


def _cut(length: int):
    """The bytes from an anchor's first start to the end of the string at its last."""

    def run(batches):
        for b in batches:
            rows = []
            for c, rep, text, wanted in zip(*(b.column(k) for k in range(4)), strict=True):
                raw = text.as_py()
                rows += [(w["g"], c.as_py(), rep.as_py(), w["pos"], w["l0"], w["l1"], w["contexts"], raw[w["pos"] - w["l1"] : w["pos"] - w["l0"] + length]) for w in wanted.as_py() or ()]
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[at : at + 5000], strict=True), _CONTEXT_ARROW, strict=True)], schema=_CONTEXT_ARROW)

    return run


def _split(length: int, low: int, high: int):
    """Halves of the starts of contexts in too large buckets: a half's bucket also holds the bytes that all its strings share."""

    def run(batches):
        half = (low + high) // 2
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for a, z in ((low, half), (half, high)):
                    l0, l1 = max(r["l0"], a), min(r["l1"], z - 1)
                    if l0 > l1:
                        continue
                    at = r["l1"]  # the anchor's place in ctx
                    core, ctx = r["ctx"][at - a : at + length - z + 1], r["ctx"][at - l1 : at - l0 + length]
                    g = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=(r["g"] & (1 << 64) - 1).to_bytes(8, "little"), person=a.to_bytes(4, "little")).digest(), "little", signed=True)
                    rows.append((g, r["c"], r["rep"], r["pos"], l0, l1, int.from_bytes(hashlib.blake2b(ctx, digest_size=8).digest(), "little", signed=True), ctx))
            for at in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[at : at + 5000], strict=True), _CONTEXT_ARROW, strict=True)], ["g", "c", "rep", "pos", "l0", "l1", "w", "ctx"])

    return run, "g long, c binary, rep long, pos long, l0 int, l1 int, w long, ctx binary"


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _refined(length: int):
    """Intervals [s, e) of the text that repeated strings cover, from contexts sorted by bucket; whole buckets are refined together."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            rows = list({(r[0], r[1], *r[3:6]): r for r in held}.values())  # an anchor at the border of two pieces has two ranges of starts
            out = [[], [], [], []]
            for r, on in zip(rows, refine([r[7] for r in rows], length), strict=True):
                s, e = _runs(on)
                out[0] += [r[1]] * len(s)
                out[1] += [r[2]] * len(s)
                out[2] += (r[3] - r[5] + s).tolist()
                out[3] += (r[3] - r[5] + e - 1 + length).tolist()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["c", "rep", "s", "e"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
                if size > _GO and r[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[7]), r[0]
        if held:
            yield flush()

    return run


def _removed(length: int):
    """A text's figures after the union of its intervals is removed."""

    def run(batches):
        for b in batches:
            rows = []
            for c, text, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = text.as_py()
                at, kept, removed, n = 0, hashlib.sha256(), 0, 0
                end = -1
                for x in sorted((x["s"], x["e"]) for x in spans.as_py()):
                    s, e = x
                    if s > end:
                        kept.update(raw[at:s])
                        n += 1
                    if e > end:
                        removed += e - max(s, end)
                        at = end = e
                kept.update(raw[at:])
                rows.append((c.as_py(), removed, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["c", "n_removed", "n_spans", "kept"])

    return run


def _weigh(rows: DataFrame, scratch: Scratch, length: int) -> tuple[DataFrame, DataFrame]:
    """One round over buckets g of contexts w: (intervals that are settled, one row for each context of the buckets that are not, with the bucket's contexts)."""
    key = ["g", "l0", "l1", "w"]
    rows = rows.withColumn("occ", F.xxhash64("c", "pos"))
    contexts = scratch.write(rows.groupBy(*key).agg(F.min("occ").alias("low"), F.max("occ").alias("high")), "contexts")
    open_ = contexts.groupBy("g").agg(F.count("*").alias("contexts"), F.sum((F.col("low") == F.col("high")).cast("long")).alias("single")).where("contexts > 1 and single > 0").select("g", "contexts")
    open_ = scratch.write(open_, "open")
    met = scratch.write(rows.join(contexts, key).join(open_, "g", "left").where("low <> high or (contexts is not null and occ = low)"), "met")
    settled = met.where("low <> high").select("c", "rep", (F.col("pos") - F.col("l1")).alias("s"), (F.col("pos") - F.col("l0") + length).alias("e"))
    return settled, met.where("contexts is not null and occ = low").drop("w", "occ", "low", "high")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH, contexts: int = CONTEXTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row: every byte that a string of ``length`` bytes covers which also starts elsewhere is removed.

    Texts are UTF-8 bytes, a null is empty, a text shorter than ``length`` stays; matches don't cross texts. Equal texts
    are one class, removed whole if it has two rows or more. Every string belongs to the bucket of its least gram; whole
    contexts (all strings of an anchor) that occur twice are settled by sums, and only buckets with other contexts need
    their bytes, fetched in one join. Buckets of at most ``contexts`` contexts are refined in tasks; larger ones are
    halved by offset and by the bytes that a half's strings share until they are small, or all alike. Every comparison in
    the end is of bytes or of 128 bits of hashes. Rows with a null or repeated doc_id are rows like others; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(None).cast("long")).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    run, schema = _first(length)
    first, path = rows.mapInArrow(run, schema), scratch.path("first")
    with small_batches(spark):
        first.withColumn("kind", F.when(F.col("pos").isNull(), "text").otherwise("anchor")).write.partitionBy("kind").parquet(path)
    first = spark.read.schema(first.schema.add("kind", "string")).parquet(path)
    texts, found = first.where("kind = 'text'").select("doc_id", "c", "n", "sha"), first.where("kind = 'anchor'").select("g", "c", "pos", "l0", "l1", "w")
    classes = scratch.write(texts.groupBy("c").agg(F.count("*").alias("rows"), F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("rep"), F.max("n").alias("n")), "classes")
    whole = (F.col("rows") > 1) & (F.col("n") >= length)
    occ = F.xxhash64("c", "pos")
    shared = scratch.write(found.groupBy("g").agg(F.min(occ).alias("low"), F.max(occ).alias("high")).where("low <> high").select("g"), "shared")
    mine = scratch.write(found.join(shared, "g", "left_semi").distinct(), "anchors")
    settled, open_ = _weigh(mine.join(classes.select("c", "rep"), "c"), scratch, length)
    parts = [settled]
    wanted = open_.select("c", "rep", F.struct("g", "pos", "l0", "l1", "contexts").alias("x")).unionByName(
        mine.select("c").distinct().join(classes.where(~whole), "c", "left_semi").join(classes.select("c", "rep"), "c").select("c", "rep", F.lit(None).cast("struct<g:bigint,pos:bigint,l0:int,l1:int,contexts:bigint>").alias("x"))
    )
    wanted = scratch.write(wanted.groupBy("c", "rep").agg(F.collect_list("x").alias("wanted")), "wanted")
    name, folder = f"textloom_{scratch.root.rsplit('-', 1)[1]}", scratch.path("bucketed")
    own = rows.select(F.unhex(F.md5("text")).alias("c"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rep"), "text").where(F.length("text") >= length)
    with small_batches(spark):
        own.join(wanted, ["c", "rep"]).select("c", "rep", "text", "wanted").write.option("path", folder).bucketBy(n, "c", "rep").saveAsTable(name)
    try:
        bucketed = spark.table(name)
        cut = scratch.write(bucketed.where(F.size("wanted") > 0).mapInArrow(_cut(length), _CONTEXT), "cut")
        ranges = [(0, length - GRAM + 1)]
        while ranges:
            cut = cut.select("g", "c", "rep", "pos", "l0", "l1", "contexts", "ctx")
            small = cut.where(F.col("contexts") <= contexts)
            parts.append(scratch.write(small.repartition("g").sortWithinPartitions("g").mapInArrow(_refined(length), "c binary, rep long, s long, e long"), "refined"))
            large = cut.where(F.col("contexts") > contexts)
            if large.isEmpty():
                break
            halves = []
            for low, high in ranges:
                run, schema = _split(length, low, high)
                inside = large.where((F.col("l0") >= low) & (F.col("l1") < high)) if len(ranges) > 1 else large
                halves.append(inside.mapInArrow(run, schema))
            ranges = [r for low, high in ranges for r in ((low, (low + high) // 2), ((low + high) // 2, high)) if r[0] < r[1]]
            split = halves[0]
            for h in halves[1:]:
                split = split.unionByName(h)
            settled, cut = _weigh(scratch.write(split, "halves"), scratch, length)
            parts.append(settled)
        spans = parts[0]
        for p in parts[1:]:
            spans = spans.unionByName(p)
        spans = spans.join(classes.where(~whole).select("c"), "c", "left_semi").groupBy("c", "rep").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        done = spark.table(name).select("c", "rep", "text").join(spans, ["c", "rep"]).select("c", "text", "spans").mapInArrow(_removed(length), "c binary, n_removed long, n_spans long, kept string")
        done = scratch.write(done.dropDuplicates(["c"]), "partly")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch._delete(folder)
    empty = hashlib.sha256(b"").hexdigest()
    done = done.unionByName(classes.where(whole).select("c", F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(empty).alias("kept")))
    done = scratch.write(done, "done")
    out = texts.join(done, "c", "left").select("doc_id", F.col("n").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
    out = scratch.keep(out)
    scratch._delete(path)
    return out


def op5_substrings(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, {2 * LENGTH})) AS k FROM (SELECT doc_id, x, unnest(range(n - {LENGTH} + 1)) AS p FROM h WHERE n >= {LENGTH})),
s AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT doc_id, min(p) AS s, max(p) + {LENGTH} AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS r FROM g) GROUP BY doc_id, r),
c AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM i),
k AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) || substr(any_value(x), 2 * max(e) + 1) AS rest FROM c JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
"""
