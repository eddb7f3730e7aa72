"""Scores and decisions about documents, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least quality and signal of each type.
GATES = {
    "email_thread": (0.70, 0.60), "chat_daily": (0.65, 0.60), "pdf_report": (0.75, 0.65), "web_article": (0.70, 0.60),
    "note": (0.60, 0.50), "text": (0.65, 0.55), "legal": (0.80, 0.70), "generic": (0.65, 0.55),
}
#: Substrings of a type's name, in order.
TYPE_NAMES = (("email_thread", ("email", "thread")), ("chat_daily", ("chat",)), ("pdf_report", ("pdf", "report")), ("web_article", ("web", "article")), ("note", ("note",)), ("legal", ("legal", "court")), ("text", ("text",)))
JUNK_WORDS = ("advertisement", "promotion", "unsubscribe", "click here", "special offer")
CRITIC_WEIGHTS = (0.15, 0.25, 0.20, 0.15, 0.10, 0.10, 0.05)


def length_score(text: Column) -> Column:
    n = F.length(F.btrim(text, F.lit(" \t\n\r\x0b\x0c\u00a0")))  # only the ends are looked at
    return F.when(n < 100, n / 100.0).when(n < 300, 0.7).otherwise(1.0)


def quality(text: Column, ocr: Column | None = None, parse: Column | None = None, structured: Column | None = None) -> Column:
    """The mean of those of OCR confidence, parse quality, length and structure that are known."""
    sure = [length_score(text), F.when(structured if structured is not None else F.lit(True), 1.0).otherwise(0.7)]
    maybe = [x.cast("double") for x in (ocr, parse) if x is not None]
    known = reduce(lambda a, b: a + b, (x.isNotNull().cast("int") for x in maybe), F.lit(2))
    return reduce(lambda a, b: a + b, (F.coalesce(x, F.lit(0.0)) for x in maybe), sure[0] + sure[1]) / known


def novelty(existing: Column) -> Column:
    return F.when(existing < 10, 0.9).when(existing < 50, 0.7).when(existing < 200, 0.6).otherwise(0.5)


def actionability(people: Column, project: Column, topic: Column, dates: Column) -> Column:
    add = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + add(people, 0.2) + add(project, 0.2) + add(topic, 0.1) + add(dates, 0.1))


def signal(quality_: Column, novelty_: Column, actionability_: Column) -> Column:
    return 0.4 * quality_ + 0.3 * novelty_ + 0.3 * actionability_


def gate_type(name: Column) -> Column:
    low, out = F.lower(name), F.when(F.lit(False), "")
    for kind, parts in TYPE_NAMES:
        out = out.when(low.rlike("|".join(parts)), kind)
    return out.otherwise("generic")


def gate(kind: Column, quality_: Column, signal_: Column) -> Column:
    """Whether quality and signal reach the type's gates."""
    least = lambda k: F.create_map(*(x for name, gates in GATES.items() for x in (F.lit(name), F.lit(gates[k]))))[kind]
    return F.coalesce((quality_ >= least(0)) & (signal_ >= least(1)), F.lit(False))  # each score stands here once, however long its expression


def junk_count(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in JUNK_WORDS))


def priority(urgent: Column, action: Column, question: Column, todo: Column) -> Column:
    many = action.cast("int") + question.cast("int") + todo.cast("int") >= 2
    return F.when(urgent & action, "critical").when(urgent | many, "high").when(action | todo, "medium").otherwise("low")


def status(urgent: Column, action: Column, question: Column, kind: Column) -> Column:
    return F.when(action | urgent | question, "pending").when(kind.isin("pdf", "text"), "reference").otherwise("active")


def critic(scores: list[Column]) -> Column:
    """The weighted mean of seven scores, those outside 0 to 5 counting 2.5."""
    inside = lambda c: F.when(c.between(0, 5), c.cast("decimal(6,3)")).otherwise(F.lit("2.5").cast("decimal(6,3)"))
    return F.round(reduce(lambda a, b: a + b, (inside(c) * F.lit(str(w)).cast("decimal(4,2)") for c, w in zip(scores, CRITIC_WEIGHTS, strict=True))), 2)


def bm25(tf: Column, length: Column, average: Column, idf: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
