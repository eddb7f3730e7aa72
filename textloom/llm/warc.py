"""WARC archives in Zstandard frames: a writer, and a reader that checks headers, lengths and digests."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

#: Magic numbers of the dictionary's skippable frame, of any skippable frame (the low four bits vary), of a frame and of a dictionary.
DICTIONARY_FRAME, SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0x184D2A50, 0xFD2FB528, 0xEC30A437
#: A file's dictionary is trained on its first payloads, up to so many and so many bytes of each. It changes sizes, never contents.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 64, 16 << 10, 32 << 10
LEVEL, _CHUNK = 3, 64 << 10
#: A task goes on to its next archive after so many bytes, so that a reader's task gets one whole archive of bounded size (but for a last large record).
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
RESPONSE, REVISIT = "response", "revisit"
#: Equal payloads of so many bytes or more become revisits.
LEAST_BYTES = 0


class WarcError(ValueError):
    """An archive that isn't as the format has it."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == RESPONSE else b"")
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == REVISIT:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples of payloads and on heads of records, of which there are always enough."""
    urls = [f"http{'s' * (k % 2)}://{'www.' * (k % 3 > 0)}site{k * 37 % 101}.{('com', 'org', 'net')[k % 3]}/{'page/' * (k % 4)}{k * 7919}" for k in range(256)]
    heads = [record(k * 104729, u, b"", 1000 + k * 31, digest(u.encode()), (RESPONSE, REVISIT)[k % 2], k) for k, u in enumerate(urls)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, [*samples, *heads]).as_bytes()


class Writer:
    """Writes records to a binary file, each in a frame of its own, after a skippable frame with the dictionary."""

    def __init__(self, out, trained: bytes | None):
        self.out, self.size = out, 0
        if trained:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
            self.size += out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.frames = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)

    def write(self, rec: bytes) -> None:
        self.size += self.out.write(self.frames.compress(rec))


def frames(data: bytes, most: int | None = None) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; the leading skippable frame is the dictionary, plain or compressed.

    ``most`` bounds what a frame may decode to, for archives from elsewhere; without it a record may have any size.
    """
    at, loaded, most = 0, None, most or (1 << 62)
    view = memoryview(data)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError(f"{len(data) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            body = view[at + 8 : at + 8 + size]
            if len(body) < size:
                raise WarcError(f"the skippable frame at {at} is cut short")
            if at == 0 and magic == DICTIONARY_FRAME:
                raw = bytes(body)
                if raw[:4] == struct.pack("<I", FRAME):
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                if raw[:4] != struct.pack("<I", DICTIONARY):
                    raise WarcError("the dictionary frame holds no dictionary")
                loaded = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        if magic != FRAME:
            raise WarcError(f"no frame at {at}")
        one, out, held = zstandard.ZstdDecompressor(dict_data=loaded).decompressobj(), io.BytesIO(), 0
        try:
            while not one.eof and at < len(data):
                chunk = view[at : at + _CHUNK]
                held += out.write(one.decompress(chunk))
                at += len(chunk) - len(one.unused_data)
                if held > most:
                    raise WarcError(f"a record has more than {most} bytes")
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from None
        if not one.eof:
            raise WarcError("the last frame is cut short")
        yield out.getvalue()


def _headers(raw: bytes, first: str) -> tuple[str, dict[str, str]]:
    lines = raw.decode("utf-8", "strict").split("\r\n")
    if not lines[0].startswith(first):
        raise WarcError(f"{lines[0][:40]!r} instead of {first}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"no header: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return lines[0], out


def _page(uri: str) -> int | None:
    body = uri.strip("<>").removeprefix("urn:page:")
    return None if body == "None" else int(body)


def parse(rec: bytes) -> dict:
    """A record's fields, after checks of its version, mandatory headers, length, end and digests."""
    head, gap, rest = rec.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("a record without an end of its headers")
    _, h = _headers(head, "WARC/1.")
    if missing := [k for k in ("warc-record-id", "content-length", "warc-date", "warc-type") if k not in h]:
        raise WarcError(f"headers are missing: {missing}")
    if not h["content-length"].isdigit():
        raise WarcError(f"a length of {h['content-length']!r}")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{len(rest) - 4} bytes in a block of {size}")
    block = rest[:size]
    if h.get("warc-block-digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise WarcError("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    _, fields = _headers(http, "HTTP/1.")
    kind, sha1 = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
    full = int(fields["content-length"])
    if kind == RESPONSE and (len(payload) != full or digest(payload) != sha1):
        raise WarcError("the payload's length or digest differs")
    if kind == REVISIT and (payload or "warc-refers-to" not in h):
        raise WarcError("a revisit with a payload or without a target")
    return {
        "page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": payload if kind == RESPONSE else None, "payload_bytes": full, "payload_digest": sha1, "record_type": kind,
        "refers_to": _page(h["warc-refers-to"]) if kind == REVISIT else None,
    }


def classify(pages: DataFrame, scratch: Scratch, *, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, size, sha1, kind, refers_to): which records are responses and which revisit them.

    Payloads that occur more than once are found by sums over their digests; their table is written, so that the join
    with the pages is one of two plain exchanges, whose large keys Spark splits.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"size": F.length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    often = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    often = scratch.write(often, "repeated")
    revisit = F.coalesce((F.col("size") >= least) & (F.coalesce("page_id", F.lit(-(1 << 63))) < F.col("first")), F.lit(False))
    return rows.join(often, "sha1", "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1", F.when(revisit, REVISIT).otherwise(RESPONSE).alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _writer(folder: str, archive_bytes: int, part: int, attempt: int):
    """Writes the records of one attempt of a task, and yields its archives' paths and numbers of records."""

    def run(batches):
        system, root = _filesystem(folder)
        trained, files, out, writer, n, name = None, 0, None, None, 0, None

        def close():
            nonlocal writer, files
            out.close()
            writer, files = None, files + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "n"])

        def rows():  # the first few are looked at before any is written
            first = []
            for b in batches:
                for k in range(b.num_rows):
                    r = b.slice(k, 1).to_pylist()[0]
                    if first is None:
                        yield None, r
                        continue
                    first.append(r)
                    if len(first) == SAMPLES:
                        yield from ((first, x) for x in first)
                        first = None
            yield from ((first, x) for x in first or ())

        for first, r in rows():
            if trained is None:
                trained = dictionary([x["payload"][:SAMPLE_BYTES] for x in first if x["payload"]])
            if writer is None:
                system.create_dir(root, recursive=True)
                name = f"{root}/part-{part:06d}-{attempt:09d}-{files:05d}.warc.zst"
                out, n = system.open_output_stream(name, compression=None), 0
                writer = Writer(out, trained)
            writer.write(record(r["page_id"], r["url"], r["payload"] or b"", r["size"], base64.b32encode(r["sha1"]).decode(), r["kind"], r["refers_to"]))
            n += 1
            if writer.size >= archive_bytes:
                yield close()
        if writer is not None:
            yield close()

    return run


def write_archives(classified: DataFrame, folder: str, scratch: Scratch, *, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives to ``folder``, each of about ``archive_bytes`` at most, and returns a written table (path, n) of them with their numbers of records.

    A file's name has its task's attempt, so that attempts never touch each other's files, whatever the order of their rows
    and however many archives each makes. Which attempt counts is settled by the table: Spark commits one for each task.
    Files that it doesn't name are no part of the result.
    """
    folder = folder.replace("file:///", "/").replace("file:/", "/") if folder.startswith("file:") else folder

    def run(batches):
        task = TaskContext.get()
        yield from _writer(folder, archive_bytes, task.partitionId(), task.taskAttemptId())(batches)

    return scratch.write(classified.mapInArrow(run, "path string, n long"), "manifest")


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _parsed(path: str, data, payload: bool, most: int | None, n: int | None = None):
    """An archive's records in small batches; ``n`` is how many there must be."""
    rows, held, found = [], 0, 0
    try:
        for raw in frames(data, most):
            row = parse(raw)
            if not payload:
                row["payload"] = None
            rows.append(row)
            held, found = held + (len(raw) if payload else 0), found + 1
            if len(rows) >= 1000 or held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if n not in (None, found):
            raise WarcError(f"{found} records instead of {n}")
    except WarcError as e:
        raise WarcError(f"{path}: {e}") from None
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark, folder: str, *, payload: bool = True, most: int | None = None) -> DataFrame:
    """The records of all ``*.warc.zst`` archives in ``folder``; a broken archive raises WarcError with its name.

    ``payload`` False leaves the payloads out after they have been checked; ``most`` bounds a record's bytes. An archive is
    one task's; one of 2 GB or more, which this writer never makes, can't be read.
    """

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _parsed(path, data.as_buffer(), payload, most)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def read_written(manifest: DataFrame, *, payload: bool = True, most: int | None = None) -> DataFrame:
    """The records of exactly the archives that ``manifest`` (path, n) names, each of which must hold n."""

    def run(batches):
        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = _filesystem(path)
                with system.open_input_file(name) as f:
                    data = f.read()
                yield from _parsed(path, data, payload, most, n)

    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, SCHEMA)


def round_trip(pages: DataFrame, *, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives in the shared folder and reads them back, without payloads.

    A null html is an empty payload, a null url is replaced by the record's own name, a null page_id is older than any
    other; of several rows with the largest page_id and one payload, all are responses, as are all if no page_id is
    known. An empty table makes no archive and an empty result. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc", rows=200)
    folder = scratch.path("archives")
    manifest = write_archives(classify(pages, scratch, least=least), folder, scratch, archive_bytes=archive_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], SCHEMA).drop("payload")
    out = scratch.keep(read_written(manifest, payload=False).drop("payload"))
    scratch._delete(folder)
    return out


def op1_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
top AS (SELECT hex, max(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
    (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER) + 1, 1), '' ORDER BY k) FROM range(32) AS r(k)) AS payload_digest,
    CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < first THEN first END AS refers_to
FROM p JOIN top USING (hex)
"""
