"""Exact duplicates by an extendible-hash index in shared files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

#: Bytes of text of a bucket, more only where the index would have more than MOST_BUCKETS; bits of the directory at most; bytes of text that a task holds to find its own copies.
BUCKET_BYTES, MOST_BUCKETS, MOST_BITS, HELD = 16 << 20, 1 << 15, 17, 24 << 20
_BLANK = b" \t\n\v\f\r"
_PAGE = "r long, id long, entry long, n long, size long, key long, sha binary, text binary"
_PAGE_NAMES = [x.split()[0] for x in _PAGE.split(", ")]


def normalised(raw: bytes | None) -> bytes:
    """Each run of blanks (0x20, 0x09 to 0x0D) as one space; null as empty."""
    if not raw:
        return b""
    words = b" ".join(raw.split())
    return (b" " if raw[0] in _BLANK else b"") + words + (b" " if words and raw[-1] in _BLANK else b"")


def _pages(key_bits: int, held: int):
    """The rows as members of entries, and each entry: one text of this task with its first copy, count and hash.

    Within a task, copies meet in a chained table of at most ``held`` bytes of text and are told by their bytes.
    """
    mask = (1 << 64) - (1 << 64 - key_bits)

    def run(batches: Iterator[pa.RecordBatch]):
        r, table, bytes_held = TaskContext.get().partitionId() << 33, {}, 0

        def entries():
            found = [[e["least"][2], e["least"][1], e["entry"], e["n"], len(e["text"]), key - (1 << 64) if key >> 63 else key, e["sha"], e["text"]] for key, chain in table.items() for e in chain]
            cols = list(zip(*found, strict=True)) if found else [[]] * len(_PAGE_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 6 + [pa.binary()] * 2, strict=True)], _PAGE_NAMES)

        for b in batches:
            ids, members = b.column(0).to_pylist(), []
            first = r
            for id, raw in zip(ids, b.column(1), strict=True):
                text = normalised(raw.as_py())
                sha = hashlib.sha256(text).digest()
                key = int.from_bytes(sha[:8]) & mask
                chain = table.setdefault(key, [])
                found, least = next((e for e in chain if e["text"] == text), None), (id is None, id, r)
                if found is None:
                    found = {"text": text, "sha": sha, "entry": r, "n": 0, "least": least}
                    chain.append(found)
                    bytes_held += len(text) + 300
                found["n"] += 1
                if least[:1] + ((least[1] or 0),) < found["least"][:1] + ((found["least"][1] or 0),):
                    found["least"] = least
                members.append(found["entry"])
                r += 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(range(first, r), pa.int64()), b.column(0), pa.array(members, pa.int64()), *(pa.nulls(n, pa.int64()) for _ in range(3)), *(pa.nulls(n, pa.binary()) for _ in range(2))], _PAGE_NAMES)
            if bytes_held > held:
                yield entries()
                table, bytes_held = {}, 0
        yield entries()

    return run


def directory(cells: dict[int, tuple[int, bool]], bits: int, capacity: int) -> tuple[int, np.ndarray, int]:
    """Bits, the owner of each of 2 ** bits beginnings of keys, and the number of owners.

    Starts with one bucket; one that is overfull is split by its next bit, and the directory doubles when that bucket has as
    many bits as it. A bucket whose keys are all the same, or that has ``bits`` bits, stays overfull. Neighbours that fit
    together have one owner, so that each owner's keys are a range. ``cells``: beginning of ``bits`` bits to bytes, and
    whether it holds several keys.
    """
    load, several = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
    for k, (size, more) in cells.items():
        load[k], several[k] = size, more
    total = np.concatenate([[0], np.cumsum(load)])
    used = np.concatenate([[0], np.cumsum(load > 0)])
    depth, pointers, buckets = 0, np.zeros(1, np.int64), {0: (0, bits)}  # bucket: its first cell, and the bits it has left
    while True:
        over = [(b, at, left) for b, (at, left) in buckets.items() if left and total[at + (1 << left)] - total[at] > capacity and (used[at + (1 << left)] - used[at] > 1 or several[at : at + (1 << left)].any())]
        if not over:
            break
        for b, at, left in over:
            if bits - left == depth:
                pointers, depth = np.repeat(pointers, 2), depth + 1
            half, new = 1 << left - 1, len(buckets)
            buckets[b], buckets[new] = (at, left - 1), (at + half, left - 1)
            pointers[at + half >> bits - depth : at + 2 * half >> bits - depth] = new
    owner, n, held = {}, 0, 0
    for b, (at, left) in sorted(buckets.items(), key=lambda x: x[1]):
        size = int(total[at + (1 << left)] - total[at])
        if held and held + size > capacity:
            n, held = n + 1, 0
        owner[b], held = n, held + size
    return depth, np.array([owner[b] for b in pointers.tolist()]), n + 1


def _owned(batches: Iterator[pa.RecordBatch]):
    """Each entry with the first entry of the same bytes. Keys come sorted; those of one key form a chain, longer than one only where different texts collide."""
    last, chain = None, []
    for b in batches:
        out = []
        for entry, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if key != last:
                last, chain = key, []
            text = text.as_py()
            found = next((c for c, x in chain if x == text), None)
            if found is None:
                found = entry
                chain.append((entry, text))
            out.append(found)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["entry", "same"])


def index(docs: DataFrame, scratch: Scratch, *, id: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES, key_bits: int = 64, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """The written pages (members and entries) and the written table (entry, same): which entry an entry's text stands under."""
    pages = scratch.write(docs.select(F.col(id).cast("long"), F.col(text).cast("binary")).mapInArrow(_pages(key_bits, held), _PAGE), "pages", compression="zstd")
    entries = pages.where("n is not null")
    size = int(entries.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    capacity = max(capacity, size // MOST_BUCKETS)
    bits = min(MOST_BITS, max(1, (size // max(1, capacity)).bit_length() + 4))
    begins = F.shiftrightunsigned("key", 64 - bits)
    cells = {r.k: (r.size, r.several) for r in entries.groupBy(begins.alias("k")).agg(F.sum("size").alias("size"), (F.min("key") < F.max("key")).alias("several")).toLocalIterator()}  # 2 ** MOST_BITS at most
    depth, owners, n = directory(cells, bits, capacity)
    spark = docs.sparkSession
    pointers = scratch.write(spark.createDataFrame(list(enumerate(owners.tolist())), "k long, owner int"), "directory")
    at = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    dealt = entries.select("entry", "key", "text", at.alias("k")).join(F.broadcast(pointers), "k").repartitionById(n, F.col("owner")).sortWithinPartitions("key", "entry").select("entry", "key", "text")
    return pages, scratch.write(dealt.mapInArrow(_owned, "entry long, same long"), "chains")


def duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", capacity: int = BUCKET_BYTES, key_bits: int = 64, held: int = HELD) -> DataFrame:
    """A row for each row of ``docs``: id, keep_id, group_size, kept and the SHA-256 of the normalised text.

    Each task combines its own copies, so that a text of a third of all rows is one entry a task. Entries lie in pages in the
    shared folder; sums of their bytes by the beginnings of their keys split the directory; each owner reads its range of
    keys in order, chains texts whose keys collide and compares bytes. Entries then give their group to their members.

    A null text is empty. Of equal texts exactly one row is kept, one with the smallest id; a null id comes after all others,
    so keep_id is null only if all ids of a group are. Repeated rows count each. An empty table gives an empty one. Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    pages, chains = index(docs, scratch, id=id, text=text, capacity=capacity, key_bits=key_bits, held=held)
    entries = pages.where("n is not null").select("entry", F.struct(F.col("id").isNull().alias("none"), "id", "r").alias("least"), "n", "sha").join(chains, "entry")
    groups = entries.groupBy("same").agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    known = scratch.write(entries.select("entry", "same", "sha").join(groups, "same").select("entry", "sha", F.col("least.id").alias("keep_id"), F.col("least.r").alias("keep_r"), "group_size"), "groups")
    out = pages.where("n is null").select("r", "id", "entry").join(known, "entry")
    return scratch.keep(out.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("r") == F.col("keep_r")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")))


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM x
"""
