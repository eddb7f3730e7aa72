"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch, lean, small_batches

#: Bytes of text that share one list of words at most.
BLOCK_BYTES = 64 << 20
#: The code points that the tokenizer's \s stands for; str.split() also takes U+001C to U+001F, which it does not.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAPS, _ODD = re.compile(f"[{_WHITE}]+"), re.compile(r"[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_words(text: str) -> list[str]:
    """The runs between white space; since the tokenizer drops white space and no merge crosses it, they are encoded one by one."""
    return [w for w in _GAPS.split(text) if w] if _ODD.search(text) else text.split()


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all first bytes before all second ones and so on, which compresses well."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_ints(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


_PACKED = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("positions", pa.binary()), ("bucket", pa.int64()), ("words", pa.binary()), ("numbers", pa.binary())])


def _pack(docs: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Rows of two kinds: each document's words as numbers in its block's list, and the lists, dealt into packets by a hash of the word."""

    def run(batches):
        task = TaskContext.get().partitionId()
        number: dict[str, int] = {}
        block, size = task * 1_000_003, 0

        def packets() -> pa.RecordBatch:
            words = list(number)
            of = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            cut = np.flatnonzero(np.diff(of[order], prepend=-1))
            parts = [order[s:e] for s, e in zip(cut, [*cut[1:], len(order)], strict=True)]
            n, compress = len(parts), zstandard.ZstdCompressor(level=1).compress
            texts = [compress("\n".join([words[k] for k in p.tolist()]).encode()) for p in parts]
            cols = [[None] * n, [block] * n, [None] * n, [int(of[p[0]]) for p in parts], texts, [pack_ints(np.diff(p, prepend=0)) for p in parts]]  # numbers rise within a packet
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACKED, strict=True)], schema=_PACKED)

        for b in batches:
            packed = []
            for x in b.column(1).to_pylist():
                found = split_words(x) if x else []
                for w in found:
                    if w not in number:
                        number[w] = len(number)
                packed.append(pack_ints(np.fromiter(map(number.__getitem__, found), "<u4", len(found))))
                size += len(x) if x else 0
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([block] * n, pa.int64()), pa.array(packed, pa.binary()), *(pa.nulls(n, f.type) for f in list(_PACKED)[3:])], schema=_PACKED)
            if size > block_bytes:
                yield packets()
                number.clear()
                block, size = block + 1, 0
        if number:
            yield packets()

    return docs.mapInArrow(lean(run), "doc_id long, block long, positions binary, bucket long, words binary, numbers binary")


def _encode(tokenizer: str):
    """The packets' ids. A word's packets meet in one task, in order of bucket, where the tokenizer encodes it once."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t, open_zstd = Tokenizer.from_file(tokenizer), zstandard.ZstdDecompressor().decompress
        t.no_truncation()
        t.no_padding()
        table: dict[str, list[int]] = {}
        last = None
        for b in batches:
            for bucket, block, words, numbers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last:
                    table, last = {}, bucket
                listed = open_zstd(words).decode().split("\n")
                fresh = [w for w in listed if w not in table]
                table.update(zip(fresh, (e.ids for e in t.encode_batch_fast(fresh, add_special_tokens=False)), strict=True))
                ids = [table[w] for w in listed]
                flat = np.fromiter((i for x in ids for i in x), "<u4")
                size = np.fromiter(map(len, ids), "<u4", len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([numbers], pa.binary()), pa.array([pack_ints(size)], pa.binary()), pa.array([pack_ints(flat)], pa.binary())], ["of", "numbers", "sizes", "ids"])

    return run


def pieces(spark: SparkSession, tokenizer: str) -> DataFrame:
    """(id, piece): the tokenizer's own table."""
    from tokenizers import Tokenizer

    table = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, w.encode()) for w, i in table.items()], "id int, piece binary")


def _distinct_ids(batches):
    """(of, id) of each packet."""
    for b in batches:
        for of, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.unique(unpack_ints(raw)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), of, np.int64)), pa.array(ids)], ["of", "id"])


def _assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Joins the words' ids to the documents' positions within a block, and the pieces of the block's ids to their places."""
    lists, named = right.filter(pc.is_valid(right.column("numbers"))), right.filter(pc.is_valid(right.column("id")))
    size, ids = (np.concatenate([np.zeros(0, "<u4"), *map(unpack_ints, lists.column(c).to_pylist())]) for c in ("sizes", "ids"))
    number = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack_ints(x), dtype=np.int64) for x in lists.column("numbers").to_pylist())])
    length, begin = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    length[number] = size
    begin[number] = np.cumsum(size, dtype=np.int64) - size
    known, piece = named.column("id").to_numpy(), named.column("piece").combine_chunks()
    row = np.zeros(int(known.max()) + 1 if len(known) else 0, np.int64)
    row[known] = np.arange(len(known))
    out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for doc_id, raw in zip(left.column("doc_id").to_pylist(), left.column("positions").to_pylist(), strict=True):
        at = unpack_ints(raw)
        n = length[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        mine = ids[np.repeat(begin[at] - (ends - n), n) + np.arange(total)] if total else ids[:0]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, total], pa.int32()), piece.take(pa.array(row[mine]))), b" ")[0].as_py() if total else b""
        out["doc_id"].append(doc_id)
        out["n_tokens"].append(total)
        out["ids_sha256"].append(hashlib.sha256(mine.tobytes()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
    return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())], list(out))


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``docs``.

    Texts are split once; a block of up to ``block_bytes`` of text keeps the list of its distinct words and each text as
    numbers in that list. The lists are dealt by a hash of the word, so that equal words meet in one table, where each is
    encoded once, and go back to their blocks by number; a document's ids are its positions' entries. Each block's distinct
    ids are joined with the table of pieces, and a document's decoded text is its ids' pieces (as the tokenizer's decode
    joins them). Lists move in packets, one for a block and a bucket of words; the
    packed texts lie bucketed by block, so that they meet their lists without another shuffle. A null or empty text has no
    tokens and decodes to the empty text; rows with a null or repeated doc_id are rows like others; other columns are ignored.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    scratch = Scratch(spark, "bpe")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = _pack(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), block_bytes, 4 * n)
    name, path = f"textloom_{scratch.root.rsplit('-', 1)[1]}", scratch.path("packed")
    kind = F.when(F.col("bucket").isNull(), "text").otherwise("word").alias("kind")
    with small_batches(spark):
        packed.select("*", kind).write.option("path", path).partitionBy("kind").bucketBy(n, "block").saveAsTable(name)
    try:
        texts = spark.table(name).where("kind = 'text'").select("doc_id", "block", "positions")
        words = spark.table(name).where("kind = 'word'").select("bucket", F.col("block").alias("of"), "words", "numbers")
        lists = scratch.write(words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_encode(tokenizer)), "of long, numbers binary, sizes binary, ids binary"), "lists")
        scratch._delete(f"{path}/kind=word")  # encoded, so no longer needed
        used = lists.select("of", "ids").mapInArrow(lean(_distinct_ids), "of long, id int").distinct()
        decoded = used.join(pieces(spark, tokenizer), "id")
        right = lists.select("*", F.lit(None).cast("int").alias("id"), F.lit(None).cast("binary").alias("piece")).unionByName(decoded.select("of", "id", "piece"), allowMissingColumns=True)
        out = texts.groupBy("block").cogroup(right.groupBy("of")).applyInArrow(lean(_assemble), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
        return scratch.keep(out)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch._delete(path)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
