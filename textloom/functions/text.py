"""Text functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a word: \w is ASCII only in Spark.
WORD = r"[\p{L}\p{N}_]+"
_EDGES = r"^[\s ]+|[\s ]+$"

#: Marker words of each language, in the order that decides ties.
LANGUAGE_MARKERS = {
    "en": ["the", "and", "is", "are", "was", "were", "have", "has"],
    "de": ["der", "die", "das", "und", "ist", "sind", "haben", "mit"],
    "fr": ["le", "la", "les", "et", "est", "sont", "avec", "dans"],
    "es": ["el", "la", "los", "las", "y", "es", "son", "con"],
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def tokens(c: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    """Runs between blanks; none for a blank text."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def drop_ignored(c: Column) -> Column:
    """Without the parts between the ignore marks."""
    return F.regexp_replace(c, r"(?is)<!--\s*RAG:IGNORE-START\s*-->.*?<!--\s*RAG:IGNORE-END\s*-->", "")


def clean(c: Column) -> Column:
    """No control characters, single blanks, stripped lines, at most one empty line in a row."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    c = F.regexp_replace(c, r"\t[ \t]*| [ \t]+", " ")  # single blanks are left alone
    c = F.regexp_replace(c, r"(?m)^ +| +$", "")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def estimated_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def content_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def normal_subject(c: Column) -> Column:
    """Without one reply or forward prefix, single blanks, lower case."""
    return F.lower(strip(F.regexp_replace(F.regexp_replace(strip(c), r"(?i)^(re|fw|fwd):\s*", ""), r"\s+", " ")))


def thread_id(c: Column) -> Column:
    return F.substring(F.md5(normal_subject(c).cast("binary")), 1, 12)


def one_line(c: Column, most: int = 500) -> Column:
    """A front-matter value: one line of at most ``most`` characters, cut with an ellipsis."""
    c = strip(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def drop_front_matter(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)^---\n.*?\n---\n*", "")


def plain_name(c: Column) -> Column:
    """Letters, digits, umlauts and dashes, in lower case."""
    return F.lower(F.regexp_replace(strip(F.regexp_replace(c, r"[^a-zA-Z0-9\s\-äöüÄÖÜß]", "")), r"\s+", "-"))


def calendar_escape(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\n", "\\n")], c)


def clean_title(c: Column) -> Column:
    """Unwrapped, without characters that file names can't have, at most 100 long."""
    c = F.regexp_replace(strip(c), r"^\[(.*)\]$", "$1")
    c = F.regexp_replace(c, r'[<>:"/\\|?*]', "")
    return F.substring(F.regexp_replace(c, r"^[\s-]+|[\s-]+$", ""), 1, 100)


def language(c: Column) -> Column:
    """The language with most marker words between blanks; the first of equals; unknown without any."""
    every = F.array(*(F.lit(w) for w in sorted({w for ws in LANGUAGE_MARKERS.values() for w in ws})))
    count = lambda found: F.array(*(F.array_size(F.array_intersect(found, F.array(*map(F.lit, ws)))) for ws in LANGUAGE_MARKERS.values()))
    between = lambda words: F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    names = F.array(*map(F.lit, LANGUAGE_MARKERS))
    pick = lambda n: F.when(F.array_max(n) == 0, "unknown").otherwise(F.get(names, (F.array_position(n, F.array_max(n)) - 1).cast("int")))
    found = F.transform(F.array(F.split(F.lower(c), " ")), lambda words: F.array_intersect(every, between(words)))
    return F.transform(F.transform(found, lambda x: count(x)), lambda n: pick(n))[0]  # each text is lowered, split and counted once


def address_of(c: Column) -> Column:
    """The e-mail address in a sender field."""
    inner = F.regexp_extract(c, "<(.+?)>", 1)
    return F.when(inner != "", inner).when(c.contains("@") & c.contains("."), strip(c))


def split_list(c: Column) -> Column:
    """The non-empty parts between commas."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


#: Fixed patterns of numbers that are extracted.
NUMBER_PATTERNS = (
    r"\b(\d{1,4}\s*[A-Z]?\s*\d{1,4}/\d{2,4})\b", r"\b(\d{1,3}-\d{1,3}\s*Nr\.\s*\d+)\b", r"(\+?\d{1,3}[\s-]?\(?\d{2,4}\)?[\s-]?\d{3,4}[\s-]?\d{3,4})", r"([€$£]\s*[\d,]+(?:\.\d{2})?)",
    r"\b(\d{1,3}(?:\.\d+)?%)\b", r"\b([A-Z]{2}\d{2}[A-Z0-9]{12,30})\b", r"\b(\d{4}-\d{4}-\d{4})\b", r"\b(\d{1,2}:\d{2}(?:\s*(?:Uhr|AM|PM|am|pm))?)\b",
)


#: What a text must hold for a match of the pattern at that place; None: no fixed character.
NUMBER_MARKS = ("/", "Nr.", None, "€$£", "%", None, "-", ":")


def _marked(c: Column, marks: str | None) -> Column:
    if marks is None:
        return F.lit(True)
    return c.contains(marks) if marks == "Nr." else reduce(lambda a, b: a | b, (c.contains(m) for m in marks))


def numbers(c: Column, most: int = 50) -> Column:
    """Case numbers, amounts, shares, accounts and times: distinct, sorted. As the rule has it, a share counts only where a letter or digit follows its sign.

    A pattern is looked for only in texts that hold its mark, and all of them only where there is a digit.
    """
    none = F.array().cast("array<string>")
    every = lambda x: F.concat(*(F.when(_marked(x, m), F.regexp_extract_all(x, F.lit(p), F.lit(1))).otherwise(none) for p, m in zip(NUMBER_PATTERNS, NUMBER_MARKS, strict=True)))
    found = F.transform(F.array(c), lambda x: F.when(x.isNull() | x.rlike("[0-9]"), every(x)).otherwise(none))[0]
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def from_html(c: Column) -> Column:
    """The text of a page: without script, style, nav, footer and header; a line for each tag; entities decoded."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->|<(script|style|nav|footer|header)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), "\n")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
