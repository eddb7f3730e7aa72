"""Files of any kind to text: a router by name and content, readers of office documents, pluggable readers for the rest; a file that fails is a row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.parsers import read_folder

#: A file's size from which it isn't read.
MAX_BYTES = 100 << 20
Reader = Callable[[bytes], tuple[str, dict[str, str]]]
# Extensions of code and of plain text, and the names of office formats.
CODE = "py js ts java go rs c cpp h sh sql rb php css json yaml yml toml xml".split()
PLAIN = "txt md markdown rst log csv tsv".split()
KINDS = {"pdf": "pdf", "docx": "word", "pptx": "slides", "xlsx": "sheets", "eml": "email", "html": "web", "htm": "web", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image"}
_CHAT = re.compile(r"^\[?\d{1,4}[./-]\d{1,2}[./-]\d{1,4},? \d{1,2}:\d{2}(?: [AP]M)?\]?(?: -)? [^:\n]{1,60}: ", re.MULTILINE)


def kind_of(path: str, head: bytes) -> str:
    """What a file is: by its extension; a text file by what it begins with."""
    ext = posixpath.basename(path).lower().rpartition(".")[2]
    if ext in KINDS:
        return KINDS[ext]
    start = head[:4096].decode("utf-8", "ignore")
    if ext in PLAIN or ext == "json" or "." not in posixpath.basename(path):
        if _CHAT.search(start):
            return "whatsapp"
        if '"mapping"' in start or '"chat_messages"' in start:
            return "llm_export"
    return "code" if ext in CODE else "text" if ext in PLAIN or b"\0" not in head[:4096] else "unknown"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _properties(z: zipfile.ZipFile) -> dict[str, str]:
    root = _part(z, "docProps/core.xml")
    names = {"title": "title", "creator": "author", "created": "created"}
    return {} if root is None else {names[_tag(e)]: e.text for e in root if _tag(e) in names and e.text}


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(e.text or "" if _tag(e) == "t" else "\t" if _tag(e) == "tab" else "\n" if _tag(e) == "br" else "" for e in p.iter())


def word(data: bytes) -> tuple[str, dict[str, str]]:
    """The paragraphs that aren't blank, a line each; title, author and date."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _part(z, "word/document.xml")
        if root is None:
            raise ValueError("no document inside")
        lines = [_paragraph(p) for p in root.iter() if _tag(p) == "p"]
        return "\n".join(x for x in lines if x.strip()), _properties(z)


def slides(data: bytes) -> tuple[str, dict[str, str]]:
    """Each slide's number, then its shapes' texts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = {int(m[1]): m[0] for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))}
        out = []
        for k, n in enumerate(sorted(names), 1):
            out.append(f"--- Slide {k} ---")
            for shape in (e for e in _part(z, names[n]).iter() if _tag(e) == "sp"):
                body = "\n".join(_paragraph(p) for p in shape.iter() if _tag(p) == "p")
                if body.strip():
                    out.append(body)
        return "\n".join(out), _properties(z) | {"slides": str(len(names))}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def sheets(data: bytes) -> tuple[str, dict[str, str]]:
    """Each sheet's name, then its rows, cells separated by tabs, blank ones kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, rels, shared = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels"), _part(z, "xl/sharedStrings.xml")
        if book is None or rels is None:
            raise ValueError("no workbook inside")
        strings = [] if shared is None else ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in shared if _tag(s) == "si"]
        target = {r.get("Id"): r.get("Target") for r in rels}
        out, n = [], 0
        for sheet in (e for e in book.iter() if _tag(e) == "sheet"):
            n += 1
            out.append(f"--- Sheet: {sheet.get('name')} ---")
            where = target[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            for row in (e for e in _part(z, where if where.startswith("xl/") else f"xl/{where}").iter() if _tag(e) == "row"):
                cells: list[str] = []
                for c in row:
                    value = next((v.text or "" for v in c if _tag(v) == "v"), "".join(t.text or "" for t in c.iter() if _tag(t) == "t"))
                    cells += [""] * (_column(c.get("r", "")) - 1 - len(cells))
                    cells.append(strings[int(value)] if c.get("t") == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.get("t") == "b" else value)
                out.append("\t".join(cells))
        return "\n".join(out), {"sheets": str(n)}


def plain(data: bytes) -> tuple[str, dict[str, str]]:
    return data.decode("utf-8", "replace"), {}


READERS: dict[str, Reader] = {"word": word, "slides": slides, "sheets": sheets, **dict.fromkeys(("text", "code", "whatsapp", "llm_export", "email", "web"), plain)}
FIELDS = "path string, kind string, text string, properties map<string,string>, status string, error string"


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, kind, text, properties, status, error) of files (path, content): a row for each, done or failed.

    ``readers`` adds readers by kind, such as of PDF pages or images, which need libraries or models. A file without a
    reader, over ``max_bytes``, empty of content or broken fails with its reason; the others go on.
    """
    table = READERS | (readers or {})
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("properties", pa.map_(pa.string(), pa.string())), ("status", pa.string()), ("error", pa.string())])

    def one(path: str, data: bytes | None) -> tuple:
        kind = None
        try:
            if data is None:
                raise ValueError("no content")
            kind = kind_of(path or "", data)
            if len(data) > max_bytes:
                raise ValueError(f"{len(data)} bytes, over {max_bytes}")
            if kind not in table:
                raise ValueError(f"no reader for {kind}")
            text, properties = table[kind](data)
            return path, kind, text, list(properties.items()), "done", None
        except Exception as e:  # whatever a file does to its reader, the others go on
            return path, kind, None, [], "failed", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = one(b.column(0)[k].as_py(), b.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, FIELDS)


def ingest_folder(spark: SparkSession, folder: str, pattern: str = "*", readers: dict[str, Reader] | None = None) -> DataFrame:
    """All files below a folder in one job; bad ones are failed rows."""
    return extracted(read_folder(spark, folder, pattern), readers)
