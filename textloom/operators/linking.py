"""Mentions of known names become links: an automaton for the names of one text, a join by whole words for those of a vault."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from textloom import shared
from textloom.registry import query, table

#: Letters and texts that are linked together at most, which bounds what a task holds; a longer text is alone.
BLOCK_LETTERS, BLOCK_TEXTS = 1 << 20, 256
_RUNS = re.compile(r"\w+|\W+")


def folded(text: str) -> str:
    """In lower case letter by letter, so that places stay; the few letters whose lower case is two stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def automaton(names: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """Of (name, value): each folded name gives the values of all names that it is."""
    by_name: dict[str, list] = {}
    for name, value in names:
        by_name.setdefault(folded(name), []).append(value)
    out = ahocorasick.Automaton()
    for name, values in by_name.items():
        out.add_word(name, (len(name), values))
    if by_name:
        out.make_automaton()
    return out


def _part_of_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def mentions(line: str, found: ahocorasick.Automaton) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of whole-word mentions: at both ends a word begins or ends."""
    if not len(found):
        return
    low = folded(line)
    word = [False, *map(_part_of_word, low), False]
    for last, (size, values) in found.iter(low):
        start = last - size + 1
        if word[start] != word[start + 1] and word[last + 1] != word[last + 2]:
            for v in values:
                yield start, last + 1, v


def open_lines(body: str) -> Iterator[tuple[int, str, bool]]:
    """(number, line, whether it may hold new links): not in code, front matter, nor beside a link."""
    code = front = False
    for k, line in enumerate(body.split("\n")):
        mark = line.strip()
        if mark.startswith("```") or mark == "---":
            code, front = code ^ mark.startswith("```"), front ^ (mark == "---")
            yield k, line, False
        else:
            yield k, line, not code and not front and "[[" not in line


def placed(body: str, found: dict[int, list[tuple[int, int, tuple]]]) -> str:
    """``body`` with the first free mention of each name as a link. found: by line (start, end, (rank, name, target)); in a line the lowest rank goes first."""
    out, used = [], set()
    for k, line in enumerate(body.split("\n")):
        by_name: dict[tuple, list[tuple[int, int]]] = {}
        for s, e, v in found.get(k, ()):
            by_name.setdefault(v, []).append((s, e))
        taken: list[tuple[int, int, str]] = []
        for v in sorted(by_name):
            if v in used:
                continue
            for s, e in sorted(by_name[v]):
                at = bisect_left(taken, (s,))
                if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                    insort(taken, (s, e, f"[[{v[2]}|{v[1]}]]"))
                    used.add(v)
                    break
        parts, at = [], 0
        for s, e, link in taken:
            parts += [line[at:s], link]
            at = e
        out.append("".join([*parts, line[at:]]))
    return "\n".join(out)


def ranked(names: Iterable[tuple[str, str]]) -> list[tuple[str, tuple]]:
    """(name, (rank, name, target)): the longest first, then by letters; of a name given twice the last target holds."""
    return [(n, (k, n, t)) for k, (n, t) in enumerate(sorted(dict(names).items(), key=lambda x: (-len(x[0]), x[0]))) if n]


def linked(body: str, names: list[tuple[str, str]]) -> str:
    """A text in which the first mention of each name (name, target) is a link, the longest names first.

    A mention is whole words, whatever the case; code blocks, front-matter and lines with links stay as they are, and no
    mention lies within another that is linked. Takes one pass over the text, however many names there are.
    """
    known = automaton(ranked(names))
    return placed(body, {k: list(mentions(line, known)) for k, line, free in open_lines(body) if free})


def linked_text(body: Column, names: Column) -> Column:
    """The same as a column; names: array<struct<name, target>>. A null text or list leaves the text."""

    @F.pandas_udf("string")
    def run(bodies: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([b if b is None or n is None else linked(b, [(x["name"], x["target"]) for x in n if x["name"]]) for b, n in zip(bodies, lists, strict=True)], dtype=object)

    return run(body, names)


def whole_runs(line: str, counts: Iterable[int]) -> Iterator[tuple[int, int, str]]:
    """(start, end, folded letters) of all that may be a mention of a name of so many runs of letters or of other characters.

    A mention begins and ends where a word begins or ends, so it is whole runs; blanks or marks at the ends of a line have
    no such edge.
    """
    low = folded(line)
    ends = [m.end() for m in _RUNS.finditer(low)]
    if not ends:
        return
    starts = [0, *ends]
    first, last = int(not _part_of_word(low[0])), len(ends) - int(not _part_of_word(low[-1]))
    for k in counts:
        for i in range(first, last - k + 1):
            yield starts[i], ends[i + k - 1], low[starts[i] : ends[i + k - 1]]


def _known_runs(line: str, counts: list[int], known: dict[str, list]) -> Iterator[tuple[int, int, object]]:
    """Those of ``whole_runs`` that are known, with each of their values."""
    if counts != [1]:
        yield from ((s, e, v) for s, e, x in whole_runs(line, counts) if x in known for v in known[x])
        return
    at, end = 0, len(line)
    for x in _RUNS.findall(folded(line)):
        start, at = at, at + len(x)
        if x in known and (_part_of_word(x[0]) or 0 < start and at < end):
            yield from ((start, at, v) for v in known[x])


def _blocks(sizes: list[int], letters: int) -> Iterator[tuple[int, int]]:
    """Neighbours of at most so many letters together, and at most BLOCK_TEXTS."""
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (held + n > letters or k - start == BLOCK_TEXTS):
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _dealt(text: str, counts: list[int], letters: int):
    """Blocks of rows, each with all that its texts may mention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            rows = b.column(0)
            bodies = rows.field(text).to_pylist()
            for start, end in _blocks([len(x or "") for x in bodies], letters):
                seen: set[str] = set()
                for body in bodies[start:end]:
                    for _, line, free in open_lines(body or ""):
                        if free and counts == [1]:
                            seen.update(_RUNS.findall(folded(line)))
                        elif free:
                            seen.update(x for _, _, x in whole_runs(line, counts))
                some = rows.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), pa.array([list(seen)], pa.list_(pa.string()))], ["block", "rows", "seen"])
                block += 1

    return run


def _linked(text: str, counts: list[int]):
    """The rows of blocks and their linked texts; found: the names that a block's texts mention."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, known, own = b.column(0)[k].values, {}, b.column(1)[k].values
                for low, name, target in zip(*(own.field(x).to_pylist() for x in ("low", "name", "target")), strict=True) if own is not None else ():
                    known.setdefault(low, []).append((-len(name), name, target))
                out = []
                for body in rows.field(text).to_pylist():
                    found: dict[int, list] = {}
                    for n, line, free in open_lines(body or ""):
                        if free and known:
                            found[n] = list(_known_runs(line, counts, known))
                    out.append(placed(body, found) if body else body)
                yield pa.RecordBatch.from_arrays([rows, pa.array(out, pa.string())], ["row", "linked"])

    return run


def linked_by(docs: DataFrame, names: DataFrame, text: str = "text", letters: int = BLOCK_LETTERS) -> DataFrame:
    """``docs`` with the column ``linked``: the text with the first mentions of all ``names`` (name, target) linked, as ``linked`` does for a list.

    Names of any number: texts are dealt into blocks, what each block's texts may mention is joined to the names, and a block
    gets those that it does. Work and shuffles grow with the texts, times the numbers of runs that names have (one for single
    words). A null text stays null; empty or null names are none; of a name with several targets the least holds.
    """
    spark, tables = docs.sparkSession, shared.Tables(docs.sparkSession, "links")

    @F.pandas_udf("low string, runs int")
    def fold(some: pd.Series) -> pd.DataFrame:
        low = some.map(folded)
        return pd.DataFrame({"low": low, "runs": low.map(lambda x: len(_RUNS.findall(x)))})

    one = names.where("name <> ''").groupBy("name").agg(F.min("target").alias("target"))
    known = tables.write(one.select(fold("name").alias("f"), "name", "target").select("f.*", "name", "target"), "names")
    counts = sorted(r.runs for r in known.select("runs").distinct().collect())
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    schema = StructType().add("block", "long").add("rows", ArrayType(rows.schema["row"].dataType)).add("seen", ArrayType(StringType()))
    with shared.small_batches(spark, BLOCK_TEXTS):
        blocks = tables.write(rows.mapInArrow(_dealt(text, counts, letters), schema), "blocks")
    found = blocks.select("block", F.explode("seen").alias("low")).join(known, "low").groupBy("block").agg(F.collect_list(F.struct("low", "name", "target")).alias("found"))  # what one block mentions
    with shared.small_batches(spark, 4):
        done = blocks.select("block", "rows").join(found, "block", "left").select("rows", "found").mapInArrow(_linked(text, counts), StructType([rows.schema["row"]]).add("linked", "string"))
        return tables.keep(done.select("row.*", "linked"))


@query("linked_texts")
def linked_texts(spark, sf_dir):
    """All texts with their own longer capitalised words linked."""
    names = F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))), lambda x: F.struct(x.alias("name"), F.concat(F.lit("refs/persons/"), F.lower(x)).alias("target")))
    return table(spark, sf_dir, "documents").select("doc_id", linked_text(F.col("text"), names).alias("text"))


@query(
    "vault_links",
    r"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]{6,}')) AS name FROM documents),
w AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS w FROM documents),
k AS (SELECT lower(name) AS w, count(*) AS n FROM n GROUP BY 1) SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS links FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN k USING (w) GROUP BY doc_id""",
)
def vault_links(spark, sf_dir):
    """How many names of the whole vault, the longer capitalised words of all texts, each text links; every text is linked in full. A name in two forms of case is two names, and the second takes the next mention."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = docs.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))).alias("name")).distinct().withColumn("target", F.concat(F.lit("refs/"), F.lower("name")))
    return linked_by(docs, names).select("doc_id", F.regexp_count("linked", F.lit(r"\[\[refs/")).cast("long").alias("links"))
