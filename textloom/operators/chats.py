"""Rules over chats, people lists, scans and dates in texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import dates, text
from textloom.operators.rules import FENCE_NAME, FENCED
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, table, typed

# Marks of a new topic, question words, patterns of turns, technologies and things to do.
SHIFT_MARKS = ("moving on", "new question", "different topic", "another question", "switching to", "next question")
QUESTION_WORDS = ("what", "how", "why", "when", "where", "which", "who")
TURNS = (r"(?im)^(?:User|Human|You):\s*", r"(?im)^(?:Assistant|Claude|ChatGPT|AI):\s*", r"(?im)^\*\*User\*\*:\s*", r"(?im)^\*\*Assistant\*\*:\s*")
TECHNOLOGIES = (
    r"(?i)\b(Python|JavaScript|TypeScript|Java|Go|Rust|Ruby|PHP)\b", r"(?i)\b(Docker|Kubernetes|AWS|Azure|GCP)\b", r"(?i)\b(React|Vue|Angular|Django|Flask|FastAPI|Express)\b", r"(?i)\b(SQL|PostgreSQL|MongoDB|Redis|Elasticsearch)\b",
)
TODO = r"(?i)\b(?:TODO|FIXME|Action item|Next step)"
_LONG = r"\b[a-z]{5,}\b"
#: The same in Spark, where Java's \b doesn't part a letter beyond ASCII from one of ASCII, as SQL's does.
_LONG_WORDS = r"(?<![A-Za-z0-9_])[a-z]{5,}(?![A-Za-z0-9_])"


def shifted(before: Column, now: Column) -> Column:
    """Whether a question leaves the topic of the one before: a mark of it, other question words, or under a fifth of the first ten words of five letters or more in common."""
    a, b = F.lower(before), F.lower(now)
    asked = lambda c: F.filter(F.array(*map(F.lit, QUESTION_WORDS)), lambda w: c.contains(w))
    terms = lambda c: F.array_distinct(F.slice(F.regexp_extract_all(c, F.lit(_LONG_WORDS), F.lit(0)), 1, 10))
    share = F.size(F.array_intersect(terms(a), terms(b))) / F.nullif(F.size(F.array_union(terms(a), terms(b))), F.lit(0))
    mark = reduce(lambda x, y: x | y, (b.contains(m) for m in SHIFT_MARKS))
    other = (F.size(asked(a)) > 0) & (F.size(asked(b)) > 0) & (asked(a) != asked(b))
    return mark | other | F.coalesce((F.size(terms(a)) > 0) & (F.size(terms(b)) > 0) & (share < 0.2), F.lit(False))


_OPENING = Varied(("", "What is this? ", "Moving on: ", "how and why ", "who ", ""), 3, "(conv_id + turn)")


@query("topic_shift", f"""WITH q AS (SELECT conv_id, turn, lower({_OPENING.sql} || text) AS b FROM conversations WHERE role = 'user'), p AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM q),
t AS (SELECT *, list_distinct(regexp_extract_all(a, '{_LONG}')[1:10]) AS x, list_distinct(regexp_extract_all(b, '{_LONG}')[1:10]) AS y, list_filter({list(QUESTION_WORDS)}, lambda w: contains(a, w)) AS qa, list_filter({list(QUESTION_WORDS)}, lambda w: contains(b, w)) AS qb FROM p WHERE a IS NOT NULL)
SELECT conv_id, turn, len(list_filter({list(SHIFT_MARKS)}, lambda m: contains(b, m))) > 0 OR (len(qa) > 0 AND len(qb) > 0 AND qa <> qb) OR coalesce(len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) < 0.2, false) AS shifted FROM t""")
def topic_shift(spark, sf_dir):
    """Questions with openings of many forms, against the one before."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(_OPENING.column, "text").alias("now"))
    rows = rows.withColumn("before", F.lag("now").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    return rows.select("conv_id", "turn", shifted(F.col("before"), F.col("now")).alias("shifted"))


def chat_fields(body: Column) -> Column:
    """struct of turns, code_blocks, languages, technologies (ten at most, as written), sessions, questions, todos, strategy."""
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    blocks = F.regexp_extract_all(body, F.lit(FENCED), F.lit(0))
    turns = reduce(lambda a, b: a + b, map(count, TURNS))
    found = F.concat(*(F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in TECHNOLOGIES))
    return F.struct(
        turns.alias("turns"), F.size(blocks).alias("code_blocks"), F.array_sort(F.array_distinct(F.filter(F.transform(blocks, lambda x: F.regexp_extract(x, FENCE_NAME, 1)), lambda x: x != ""))).alias("languages"),
        F.slice(F.array_sort(F.array_distinct(found)), 1, 10).alias("technologies"), F.greatest(F.lit(1), F.floor(turns / 10)).cast("int").alias("sessions"), body.contains("?").alias("questions"), body.rlike(TODO).alias("todos"),
        F.when(turns < 10, "whole").when(turns < 50, "session").otherwise("semantic").alias("strategy"),
    )


_CHAT = Joined((
    Varied(("User: hi\n", "**User**: what?\n", "", "Human: a\nAI: b\nYou: c\n"), 3), Varied(("Assistant: use Python and redis\n", "ChatGPT: docker, Docker or Go\n", "", "**Assistant**: SQL\n"), 5), Varied(("```python\nx\n```\n", "", "```\ny\n```\n```sh\nz\n```\n"), 7),
    Varied(("todo: one\n", "Next step two\n", "", "mastodon\n"), 11), Varied(("User: x\nAI: y\n" * 6, ""), 13), "text", Varied(("\nJava? TypeScript, Flask", ""), 17),
))


@query("chat_features", f"""WITH d AS (SELECT doc_id, {_CHAT.sql} AS b FROM documents), x AS (SELECT *, ({" + ".join(f"len(regexp_extract_all(b, '{p}'))" for p in TURNS)})::INT AS turns, regexp_extract_all(b, '{FENCED}') AS blocks FROM d)
SELECT doc_id, turns, len(blocks)::INT AS code_blocks, list_sort(list_distinct(list_filter(list_transform(blocks, lambda x: regexp_extract(x, '{FENCE_NAME}', 1)), lambda x: x <> ''))) AS languages,
list_sort(list_distinct(flatten([{", ".join(f"regexp_extract_all(b, '{p}', 1)" for p in TECHNOLOGIES)}])))[1:10] AS technologies, greatest(1, turns // 10)::INT AS sessions, contains(b, '?') AS questions, regexp_matches(b, '{TODO}') AS todos,
CASE WHEN turns < 10 THEN 'whole' WHEN turns < 50 THEN 'session' ELSE 'semantic' END AS strategy FROM x""")
def chat_features(spark, sf_dir):
    """Features of texts with turns, code and technologies before and after them."""
    return table(spark, sf_dir, "documents").select("doc_id", chat_fields(_CHAT.column).alias("x")).select("doc_id", "x.*")


# Roles that a legal or a school document's people are chosen by.
LEGAL_ROLES, SCHOOL_ROLES = ("richter", "anwalt", "kläger", "beklagt", "judge", "lawyer", "attorney"), ("instructor", "professor", "teacher", "dozent")


def people_of(kind: Column, people: Column) -> Column:
    """The people (array<struct<name, role, email, phone>>) kept for a type of document, by its prefix; a rule that keeps none or all goes on to the next."""
    n = F.size(people)
    first = lambda k, p=people: F.slice(p, 1, k)
    with_role = lambda roles: F.filter(people, lambda p: reduce(lambda a, b: a | b, (F.lower(F.coalesce(p["role"], F.lit(""))).contains(r) for r in roles)))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    contacts = F.filter(people, lambda p: some(p["email"]) | some(p["phone"]) | some(p["role"]))
    legal, school = with_role(LEGAL_ROLES), with_role(SCHOOL_ROLES)
    return (
        F.when(kind.rlike("^(reference/report|government/)") & (n > 10), first(5)).when(kind.startswith("legal/") & (F.size(legal) > 0), first(10, legal)).when(kind.startswith("education/") & (F.size(school) > 0), first(5, school))
        .when(kind.startswith("education/") & (n > 5), first(5)).when(kind.startswith("reference/brochure") & (F.size(contacts) < n), contacts).when(kind.rlike("^(form/|communication/meeting)"), people).otherwise(first(15))
    )


_KIND = Varied(("reference/report", "legal/law", "education/x", "reference/brochure", "form/y", "communication/meeting-notes", "government/z", "note"), 3)
_ROLE_OF = ("", "Judge at court", "Teacher", "clerk", "Dozentin")


@query("people_by_type", f"""WITH d AS (SELECT doc_id, {_KIND.sql} AS kind, list_transform(list_filter(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'), lambda x: true)[1:(doc_id % 23)::INT], lambda x: {{'name': x, 'role': list_element({list(_ROLE_OF)}, (length(x) % 5 + 1)::INT), 'mail': CASE WHEN length(x) % 3 = 0 THEN x || '@x' END}}) AS p FROM documents),
r AS (SELECT *, list_filter(p, lambda q: len(list_filter({list(LEGAL_ROLES)}, lambda r: contains(lower(q.role), r))) > 0) AS l, list_filter(p, lambda q: len(list_filter({list(SCHOOL_ROLES)}, lambda r: contains(lower(q.role), r))) > 0) AS s, list_filter(p, lambda q: coalesce(q.mail, '') <> '' OR q.role <> '') AS c FROM d)
SELECT doc_id, list_transform(CASE WHEN regexp_matches(kind, '^(reference/report|government/)') AND len(p) > 10 THEN p[1:5] WHEN kind LIKE 'legal/%' AND len(l) > 0 THEN l[1:10] WHEN kind LIKE 'education/%' AND len(s) > 0 THEN s[1:5] WHEN kind LIKE 'education/%' AND len(p) > 5 THEN p[1:5]
WHEN kind LIKE 'reference/brochure%' AND len(c) < len(p) THEN c WHEN regexp_matches(kind, '^(form/|communication/meeting)') THEN p ELSE p[1:15] END, lambda q: q.name) AS kept FROM r""")
def people_by_type(spark, sf_dir):
    """Capitalised words of texts as people with roles and addresses, for types of many kinds."""
    names = F.slice(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)), F.lit(1), (F.col("doc_id") % 23).cast("int"))
    role = lambda x: F.element_at(F.array(*map(F.lit, _ROLE_OF)), F.length(x) % 5 + 1)
    people = F.transform(names, lambda x: F.struct(x.alias("name"), role(x).alias("role"), F.when(F.length(x) % 3 == 0, F.concat(x, F.lit("@x"))).alias("email"), F.lit(None).cast("string").alias("phone")))
    rows = table(spark, sf_dir, "documents").select("doc_id", _KIND.column.alias("kind"), people.alias("people"))
    return rows.select("doc_id", F.transform(people_of(F.col("kind"), F.col("people")), lambda p: p["name"]).alias("kept"))


def scan_fields(body: Column) -> Column:
    """struct of tables, forms, checkboxes, signature of a scanned text."""
    boxes = F.size(F.regexp_extract_all(body, F.lit(r"☐|☑|\[\s?\]"), F.lit(0)))
    return F.struct(body.rlike(r".\s{3,}.+\s{3,}.").alias("tables"), body.rlike(r"_{5,}|☐|☑|\[\s?\]").alias("forms"), boxes.alias("checkboxes"), body.rlike(r"(?i)(?:Signature|Unterschrift).*?_+").alias("signature"))


_SCAN = Joined((Varied(("", "a   b    c\n", "[ ] yes [] no ☑\n", "name _____\n"), 3), Varied(("Signature: ____\n", "Unterschrift\n", "", "_"), 5), "text"))


@query("scan_fields", f"SELECT doc_id, regexp_matches(b, '.+\\s{{3,}}.+\\s{{3,}}.+') AS tables, regexp_matches(b, '_{{5,}}|☐|☑|\\[\\s?\\]') AS forms, len(regexp_extract_all(b, '☐|☑|\\[\\s?\\]'))::INT AS checkboxes, regexp_matches(b, '(?i)(?:Signature|Unterschrift).*?_+') AS signature FROM (SELECT doc_id, {_SCAN.sql} AS b FROM documents)")
def scan_fields_query(spark, sf_dir):
    """Features of scans in texts with lines, boxes and columns before them."""
    return table(spark, sf_dir, "documents").select("doc_id", scan_fields(_SCAN.column).alias("x")).select("doc_id", "x.*")


def date_context(body: Column, day: Column, around: int = 100) -> Column:
    """What stands up to ``around`` characters about the first place of an ISO date, of it with points, or of it as day, month and year, on one line; empty without any."""
    forms = [day, F.replace(day, F.lit("-"), F.lit(".")), F.concat(F.substring(day, 9, 2), F.lit("."), F.substring(day, 6, 2), F.lit("."), F.substring(day, 1, 4))]
    out = F.lit("")
    for form in reversed(forms):
        at = F.instr(body, form)
        start = F.greatest(F.lit(1), at - around)
        part = F.trim(F.replace(F.substr(body, start, at + F.length(form) + around - start), F.lit("\n"), F.lit(" ")))
        out = F.when(at > 0, part).otherwise(out)
    return out


_DATED = Joined((Varied(("", "Deadline 2024-03-15. ", "Meeting am 05.04.2024\n", "2024-03-15 and the court on 2024-06-07 ", "x 1.2.2024 "), 3), "text", Varied(("", " until 31/12/2023", "\nhearing 2024-01-09 ends", " 2024.03.15"), 5)))
_ISO = r"(\d{4}-\d{2}-\d{2})"


def _sql_context(b: str, d: str) -> str:
    forms = [d, f"replace({d}, '-', '.')", f"{d}[9:10] || '.' || {d}[6:7] || '.' || {d}[1:4]"]
    return "CASE " + " ".join(f"WHEN strpos({b}, {f}) > 0 THEN trim(replace(substr({b}, greatest(1, strpos({b}, {f}) - 100)::BIGINT, (strpos({b}, {f}) + length({f}) + 100 - greatest(1, strpos({b}, {f}) - 100))::BIGINT), chr(10), ' '))" for f in forms) + " ELSE '' END"


def _sql_dates(b: str) -> str:
    day = lambda p, f: f"list_transform(list_filter(regexp_extract_all({b}, '{p}', 1), lambda x: try_strptime(x, '{f}') IS NOT NULL), lambda x: strftime(try_strptime(x, '{f}'), '%Y-%m-%d'))"
    return f"list_distinct(list_concat(list_concat(regexp_extract_all({b}, '{_ISO}', 1), {day('(\\d{1,2}\\.\\d{1,2}\\.\\d{4})', '%d.%m.%Y')}), {day('(\\d{1,2}/\\d{1,2}/\\d{4})', '%d/%m/%Y')}))"


_EVENT_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(context), '{'|'.join(words)}') THEN '{kind}'" for kind, words in dates.EVENT_WORDS) + " ELSE 'Event' END"


@query("dated_events", f"""WITH d AS (SELECT doc_id, source, {_DATED.sql} AS b FROM documents), x AS (SELECT doc_id, source, b, unnest({_sql_dates("b")}) AS day FROM d), c AS (SELECT *, {_sql_context("b", "day")} AS context FROM x)
SELECT doc_id, day, {_EVENT_CASE} || ': ' || source AS title, nullif(substr(context, 1, 200), '') AS description, CASE WHEN source LIKE '%1' THEN 'Legal' WHEN source LIKE '%2' THEN 'Education' END AS category FROM c""")
def dated_events(spark, sf_dir):
    """An event for each date in a text: its kind and description by what stands around it, its category by topic."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", _DATED.column.alias("b")).withColumn("day", F.explode(dates.absolute_dates(F.col("b")))).withColumn("context", date_context(F.col("b"), F.col("day")))
    category = F.when(F.col("source").endswith("1"), "Legal").when(F.col("source").endswith("2"), "Education")
    return rows.select("doc_id", "day", F.concat(dates.event_type(F.col("context")), F.lit(": "), "source").alias("title"), F.nullif(F.substring("context", 1, 200), F.lit("")).alias("description"), category.alias("category"))


@query("service_stats", typed("SELECT count(*) AS documents, round(sum(length(text)) / 1048576.0, 2) AS megabytes, max(o.o_orderdate) AS newest FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id", megabytes="DOUBLE"))
def service_stats(spark, sf_dir):
    """Documents, their size, and when the newest came; orders of the same number lend the dates."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate"), "doc_id", "left")
    return docs.agg(F.count("*").alias("documents"), F.round(F.sum(F.length("text")) / (1 << 20), 2).alias("megabytes"), F.max("o_orderdate").alias("newest"))


def tidy(c: Column) -> Column:
    """Without NULs and blanks at ends of lines, single blanks, at most one empty line in a row and none at the end."""
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\0"), F.lit("")), r"[ \t]+(?=\n|$)", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"\s+$", "")


_UNTIDY = Joined((Varied(("", "a \0 b\t\tc  \n", "\n\n\n\nx"), 3), "text", Varied(("", " \n\n\n", "  end   "), 5)))


@query("tidy_texts", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(b, chr(0), ''), '(?m)[ \\t]+$', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') AS body FROM (SELECT doc_id, {_UNTIDY.sql} AS b FROM documents)")
def tidy_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tidy(_UNTIDY.column).alias("body"))


def kept_table(rows: Column, least_rows: int = 2, least_columns: int = 2) -> Column:
    """Whether a table (array of rows of cells) is large enough: in rows, and in columns in each of them."""
    return (F.size(rows) >= least_rows) & F.forall(rows, lambda r: F.size(r) >= least_columns)


@query("kept_tables", "SELECT doc_id, len(r) AS rows, len(r) >= 2 AND len(list_filter(r, lambda x: len(x) < 2)) = 0 AS kept FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split(x, ', ')) AS r FROM documents)")
def kept_tables(spark, sf_dir):
    """Lines as rows, cells separated by commas."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, ", ")).alias("r"))
    return rows.select("doc_id", F.size("r").cast("long").alias("rows"), kept_table(F.col("r")).alias("kept"))
