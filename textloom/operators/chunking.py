"""Splitting texts into chunks. Each chunker folds over one text at a time, so it is an Arrow function from texts to arrays of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.registry import query, spread, table

CHUNK = StructType([StructField("position", IntegerType()), StructField("content", StringType()), StructField("kind", StringType()), StructField("title", StringType()), StructField("tokens", IntegerType())])
#: Texts that are split at once.
ROWS = 256
Piece = tuple[str, str, str | None]


def sliding(text: str, size: int = 1000, overlap: int = 200, ends: str = ".!?", back: int = 100, blank: int = 50) -> list[str]:
    """Windows of ``size`` characters that end after a sentence, else before a blank, and overlap."""
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            reach = range(end - 1, max(at, end - min(back, size // 4)) - 1, -1)
            cut = next((k + 1 for k in reach if text[k] in ends), None)
            if cut is None:
                cut = next((k for k in range(end - 1, max(at, end - min(blank, size // 8)) - 1, -1) if text[k] == " "), None)
            end = cut if cut and cut > at else end
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        step = end - overlap
        at = step if step > at else end
    return out


_HEADING, _FENCE = re.compile(r"^(#{1,6})\s+(.+?)\s*$"), re.compile(r"^\s*(```|~~~)")


def sections(text: str) -> Iterator[tuple[str, int, tuple[str, ...], str]]:
    """(kind, level, titles, content) of a markdown text: headings, fenced code, tables, lists and paragraphs."""
    titles: list[tuple[int, str]] = []
    held: list[str] = []
    kind, fence = "paragraph", None

    def close():
        body = "\n".join(held).strip("\n")
        held.clear()
        return [(kind, titles[-1][0] if titles else 0, tuple(t for _, t in titles), body)] if body.strip() else []

    for line in text.split("\n"):
        if fence:
            held.append(line)
            if line.strip().startswith(fence):
                yield from close()
                fence, kind = None, "paragraph"
            continue
        mark, head = _FENCE.match(line), _HEADING.match(line)
        want = "code" if mark else "heading" if head else "table" if line.lstrip().startswith("|") else "list" if re.match(r"\s*([-*+]|\d+\.)\s", line) else "blank" if not line.strip() else "paragraph"
        if want == "blank" and kind in ("paragraph", "list"):
            held.append(line)
            continue
        if want != kind:
            yield from close()
            kind = want if want != "blank" else "paragraph"
        if mark:
            fence = mark[1]
            held.append(line)
        elif head:
            level = len(head[1])
            while titles and titles[-1][0] >= level:
                titles.pop()
            titles.append((level, head[2]))
            held.append(line)
            yield from close()
            kind = "paragraph"
        else:
            held.append(line)
    yield from close()


def structural(text: str, target: int = 512, most: int = 800) -> list[Piece]:
    """Sections packed up to ``target`` tokens; tables and code stand alone, a chapter starts a new chunk."""
    text = re.sub(r"(?is)<!--\s*RAG:IGNORE-START\s*-->.*?<!--\s*RAG:IGNORE-END\s*-->", "", text)
    out: list[Piece] = []
    held: list[str] = []
    size, title = 0, None

    def close():
        nonlocal size
        if held:
            out.append(("\n\n".join(held), "text", title))
        held.clear()
        size = 0

    for kind, level, titles, body in sections(text):
        n = len(body) // 4
        if kind in ("table", "code"):
            close()
            out.append((body, kind, titles[-1] if titles else None))
            continue
        if held and (size >= target or size + n > most or (kind == "heading" and level <= 2)):
            close()
        if not held:
            title = titles[-1] if titles else None
        held.append(body)
        size += n
    close()
    return out


_TURN = re.compile(r"^\s*(?:\*\*)?(user|human|you|assistant|ai|chatgpt|claude)(?:\*\*)?\s*:(?:\*\*)?\s*", re.IGNORECASE | re.MULTILINE)


def chat_turns(text: str) -> list[tuple[str, str]]:
    """(question, answer) by role marks at line starts; an answer without a question is dropped, of two questions the last stays."""
    marks = list(_TURN.finditer(text))
    out, asked = [], None
    for k, m in enumerate(marks):
        body = text[m.end() : marks[k + 1].start() if k + 1 < len(marks) else len(text)].strip()
        if m[1].lower() in ("user", "human", "you"):
            asked = body
        elif asked is not None:
            out.append((asked, body))
            asked = None
    return out + ([(asked, "")] if asked else [])


def chat(text: str, most: int = 800, turns: int = 3, least: int = 100) -> list[Piece]:
    """Turns packed until they have ``most`` tokens, or three of them and 100 tokens, or the topic shifts."""
    out: list[Piece] = []
    held, size, before = [], 0, set()
    for asked, answer in chat_turns(text):
        n = (len(asked) + len(answer)) // 4
        words = set(re.findall(r"\w{5,}", asked.lower())[:10])
        shift = bool(before and words) and len(words & before) / len(words | before) < 0.2
        if held and (size + n > most or shift or (len(held) >= turns and size >= least)):
            out.append(("\n\n".join(held), "chat", None))
            held, size = [], 0
        held.append(f"User: {asked}\n\nAssistant: {answer}")
        size, before = size + n, words
    if held:
        out.append(("\n\n".join(held), "chat", None))
    return out


def chunker(split: Callable[[str], list]) -> Callable[[Column], Column]:
    """A Column function from texts to arrays of chunks; a null text has none."""

    @F.pandas_udf(ArrayType(CHUNK))
    def chunks(texts: pd.Series) -> pd.Series:
        of = lambda p: p if isinstance(p, tuple) else (p, "text", None)
        return texts.map(lambda t: [(k, c, kind, title, max(1, len(c) // 4)) for k, (c, kind, title) in enumerate(map(of, split(t)))] if t else [])

    return chunks


def chunk_rows(split: Callable[[str], list]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches of (doc_id, text) to batches of chunks, of ROWS texts at once: a task holds the chunks of so many, whatever the batches."""
    chunks = chunker(split).func

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            listed = chunks(pd.Series(b.column(1).to_pylist(), dtype=object))
            of = [k for k, cs in enumerate(listed) for _ in cs]
            cols = list(zip(*(c for cs in listed for c in cs), strict=True)) or [[]] * len(CHUNK)
            types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *CHUNK.names])

    return run


def chunk_table(docs: DataFrame, split: Callable[[str], list], doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, position, content, kind, title, tokens): a row for each chunk."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(body).alias("body")))
    return rows.mapInArrow(chunk_rows(split), StructType([rows.schema["doc_id"], *CHUNK]))


def _sliding_sql(size: int, overlap: int, ends: str, back: int = 100, blank: int = 50) -> str:
    """The same windows by recursion: where each ends, and where the next begins."""
    end, near, far = f"(s + {size})", f"greatest(s, s + {size} - {min(back, size // 4)})", f"greatest(s, s + {size} - {min(blank, size // 8)})"
    sentence = f"length(regexp_extract(substr(text, ({near} + 1)::BIGINT, ({end} - {near})::BIGINT), '(?s)^.*[{ends}]'))"
    gap = f"length(regexp_extract(substr(text, ({far} + 1)::BIGINT, ({end} - {far})::BIGINT), '(?s)^.* '))"
    cut = f"CASE WHEN {end} >= length(text) THEN {end} WHEN {sentence} > 0 THEN {near} + {sentence} WHEN {gap} > 0 AND {far} + {gap} - 1 > s THEN {far} + {gap} - 1 ELSE {end} END"
    white = "chr(32) || chr(9) || chr(10) || chr(13)"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0::BIGINT AS s FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, text, CASE WHEN e - {overlap} > s THEN e - {overlap} ELSE e END AS s FROM (SELECT doc_id, text, s, ({cut})::BIGINT AS e FROM w) WHERE e < length(text)),
p AS (SELECT doc_id, s, trim(substr(text, s + 1, e - s), {white}) AS content FROM (SELECT doc_id, text, s, ({cut})::BIGINT AS e FROM w))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS position, content, 'text' AS kind, NULL::VARCHAR AS title, greatest(1, length(content) // 4)::INT AS tokens FROM p WHERE content <> ''"""


@query("chunks_sliding", _sliding_sql(1000, 200, ".!?"))
def chunks_sliding(spark, sf_dir):
    return chunk_table(table(spark, sf_dir, "documents"), sliding)


@query("chunks_sentences", _sliding_sql(2048, 200, ".!?\\n"))
def chunks_sentences(spark, sf_dir):
    return chunk_table(table(spark, sf_dir, "documents"), lambda t: sliding(t, 2048, 200, ".!?\n"))


@query("chunks_structural")
def chunks_structural(spark, sf_dir):
    return chunk_table(table(spark, sf_dir, "documents"), structural)


@query("chunks_chat")
def chunks_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return chunk_table(rows.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text")), chat)
