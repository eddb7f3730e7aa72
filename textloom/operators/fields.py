"""Titles, types, lists and renderings: the fields of a document's record."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import dates, models, text
from textloom.operators.documents import _NOTED, noted
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, table

#: Question words and auxiliaries that a topic leaves out.
ASKING = ("what", "how", "why", "when", "where", "who", "which", "can", "could", "do", "does", "is", "are")


def people(body: Column) -> Column:
    """Titled names, names before a role in brackets, and the names in addresses: distinct, in order, at most twenty."""
    word = r"\p{Lu}[\p{Ll}]+"
    titled = F.regexp_extract_all(body, F.lit(rf"(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Herr|Frau)\s+({word}(?:\s+{word})?)"), F.lit(1))
    roles = F.regexp_extract_all(body, F.lit(rf"({word}\s+{word})\s+\([\p{{L}} ]+\)"), F.lit(1))
    mail = F.transform(F.regexp_extract_all(body, F.lit(r"\b([a-z]+\.[a-z]+)@"), F.lit(1)), lambda x: F.initcap(F.regexp_replace(x, r"\.", " ")))
    return F.slice(F.array_distinct(F.concat(titled, roles, mail)), 1, 20)


_WHO = Varied(("Dr. Anna Weber met ", "Frau Berta asked ", "", "Herr Cy Dee and "), 3)
_WHOM = Varied(("Bo Meyer (judge). ", "cy.smith@x.org ", "Di Eden (court clerk), ", "", "nobody "), 5)
_TITLED, _ROLED, _MAILED = r"(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Herr|Frau)\s+(\p{Lu}[\p{Ll}]+(?:\s+\p{Lu}[\p{Ll}]+)?)", r"(\p{Lu}[\p{Ll}]+\s+\p{Lu}[\p{Ll}]+)\s+\([\p{L} ]+\)", r"\b([a-z]+\.[a-z]+)@"


@query("people_in_texts", f"""WITH b AS (SELECT doc_id, {_WHO.sql} || {_WHOM.sql} || text || {_WHO.sql} AS b FROM documents),
p AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(b, '{_TITLED}', 1), regexp_extract_all(b, '{_ROLED}', 1)), list_transform(regexp_extract_all(b, '{_MAILED}', 1), lambda x: array_to_string(list_transform(string_split(x, '.'), lambda w: upper(w[1]) || lower(w[2:])), ' '))) AS p FROM b)
SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:20] AS people FROM p""")
def people_in_texts(spark, sf_dir):
    """People named in all texts, and in what stands around them."""
    return table(spark, sf_dir, "documents").select("doc_id", people(F.concat(_WHO.column, _WHOM.column, "text", _WHO.column)).alias("people"))


def topic(question: Column) -> Column:
    """A question's topic: without question words, the first eight words, capitalised, at most sixty characters."""
    words = F.filter(text.tokens(question), lambda w: ~w.isin(*ASKING))
    out = F.substring(F.initcap(F.array_join(F.slice(words, 1, 8), " ")), 1, 60)
    return F.when(out == "", "Conversation").otherwise(out)


@query("topics", "WITH w AS (SELECT conv_id, turn, list_slice(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: NOT list_contains(['what', 'how', 'why', 'when', 'where', 'who', 'which', 'can', 'could', 'do', 'does', 'is', 'are'], x)), 1, 8) AS w FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 'Conversation' ELSE substr(array_to_string(list_transform(w, lambda x: replace(upper(x[1]), 'ẞ', 'Ss') || x[2:]), ' '), 1, 60) END AS topic FROM w")
def topics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", topic(F.col("text")).alias("topic"))


@query("upcoming_dates", f"SELECT doc_id, list_filter(list_sort(list_distinct(list_concat(regexp_extract_all(body, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), ['2023-12-31']))), lambda d: d >= '2024-03-01')[1:5] AS upcoming FROM ({_NOTED})")
def upcoming_dates(spark, sf_dir):
    """The first five dates from thirty days before a given day on."""
    since = F.date_format(F.date_sub(F.lit("2024-03-31").cast("date"), 30), "yyyy-MM-dd")
    return noted(spark, sf_dir).select("doc_id", F.slice(F.filter(dates.absolute_dates(F.col("body")), lambda d: d >= since), 1, 5).alias("upcoming"))


_PHRASED = Joined((
    Varied(("see you tomorrow then. ", "due in 3 days at last\n", "pay in 2 weeks. ", "It was gestern, am Montag and next Friday! ", "letzten Freitag. kurz. nächste Woche geht es ", "übermorgen und in 4 Monaten, IN 1 year. ", "someday soon, next time. ", "next month. in 12 apples. "), 3),
    Varied(("am Sonntag kommen wir. ", "letzte Woche war es so. ", "", "nächsten Dienstag oder next year. "), 5), "text",
))


def _sql_means(x: str, base: str) -> str:
    of = lambda d: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in d.items()) + "}"
    w, low = f"string_split(lower({x}), ' ')[-1]", f"lower({x})"
    n = f"CASE WHEN {low} LIKE 'in %' THEN TRY_CAST(string_split({low}, ' ')[2] AS INT) WHEN {low} LIKE 'letzte%' THEN -1 ELSE 1 END"
    day, here = f"{of(dates.WEEKDAYS)}[{w}]", f"isodow({base})"
    to = f"CASE WHEN {low} LIKE 'letzte%' THEN -(({here} - {day} + 6) % 7) - 1 ELSE ({day} - {here} + 6) % 7 + 1 END"
    fixed = f"CASE WHEN {low} IN ('morgen', 'tomorrow') THEN 1 WHEN {low} IN ('gestern', 'yesterday') THEN -1 WHEN {low} = 'übermorgen' THEN 2 END"
    shift = f"coalesce({fixed}, CASE WHEN {low} NOT LIKE 'in %' THEN {to} END, CASE WHEN {low} NOT LIKE 'am %' THEN {n} * {of(dates.UNIT_DAYS)}[{w}] END)"
    return f"coalesce({base} + ({shift})::INT, CASE WHEN {low} NOT LIKE 'am %' THEN ({base} + to_months(({n} * {of(dates.UNIT_MONTHS)}[{w}])::INT))::DATE END)::DATE::VARCHAR"


@query("relative_dates", f"""WITH d AS (SELECT doc_id, {_PHRASED.sql} AS b, DATE '2024-01-31' + (doc_id % 400)::INT AS base FROM documents), s AS (SELECT doc_id, base, list_filter(string_split_regex(substr(b, 1, 3000), '[.!?\\n]')[1:50], lambda x: length(trim(x)) >= 10) AS s FROM d),
f AS (SELECT doc_id, base, unnest(flatten(list_transform(s, lambda x: {" || ".join(f"regexp_extract_all(x, '{p}', 1)" for p in dates.PHRASES)}))) AS x FROM s)
SELECT d.doc_id, coalesce(list_sort(list_distinct(list(v) FILTER (v IS NOT NULL))), []) AS dates FROM d LEFT JOIN (SELECT doc_id, {_sql_means("x", "base")} AS v FROM f) USING (doc_id) GROUP BY d.doc_id""")
def relative_dates(spark, sf_dir):
    """What the relative phrases of all texts mean, each seen from its own date."""
    base = F.date_add(F.lit("2024-01-31").cast("date"), (F.col("doc_id") % 400).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", dates.relative_dates(_PHRASED.column, base).alias("dates"))


@query("list_fields", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS csv, len(list(DISTINCT event_type)) AS n FROM events GROUP BY user_id")
def list_fields(spark, sf_dir):
    """Lists as comma text and back."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("csv"))
    return rows.select("user_id", "csv", F.size(text.split_list(F.col("csv"))).alias("n"))


@query("storage_record", "SELECT doc_id, json_object('doc_id', doc_id, 'lang', lang, 'source', source)::VARCHAR AS record FROM documents")
def storage_record(spark, sf_dir):
    """Fields for storage: nulls and empty lists go, lists become text."""
    none = F.array_join(F.array().cast("array<string>"), ",")
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source", F.nullif(none, F.lit("")).alias("tags"), F.lit(None).cast("string").alias("summary"))).alias("record"))


@query("tag_names", "SELECT doc_id, 'topic/' || source AS tag FROM documents")
def tag_names(spark, sf_dir):
    """Tags stripped, in lower case, without their mark."""
    tag = F.concat(F.lit(" #Topic/"), F.upper("source"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower(text.strip(tag)), "^#", "").alias("tag"))


@query("note_links", "SELECT event_id, 'weeks/' || isoyear(ts) || '-W' || lpad(weekofyear(ts)::VARCHAR, 2, '0') AS week, 'months/' || strftime(ts, '%Y-%m') AS month FROM events")
def note_links(spark, sf_dir):
    week = F.concat(F.lit("weeks/"), F.expr("extract(YEAROFWEEK from ts)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", week.alias("week"), F.concat(F.lit("months/"), F.date_format("ts", "yyyy-MM")).alias("month"))


@query("chat_rendering", "SELECT conv_id, turn, '## Turn ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || '/' || count(*) OVER (PARTITION BY conv_id) || chr(10) || '**' || role || '**' || chr(10) || text AS body FROM conversations")
def chat_rendering(spark, sf_dir):
    """Each turn with its number of how many."""
    w = Window.partitionBy("conv_id")
    head = F.concat(F.lit("## Turn "), F.row_number().over(w.orderBy("turn")).cast("string"), F.lit("/"), F.count("*").over(w).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(head, F.lit("\n**"), "role", F.lit("**\n"), "text").alias("body"))


@query("link_edges", "SELECT doc_id, unnest(list_filter(['there', 'that', 'nicht', 'pour'], lambda w: list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), w))) AS entity FROM documents")
def link_edges(spark, sf_dir):
    """Which names a text mentions as whole words: the edges of the link graph."""
    words = text.tokens(F.col("text"))
    names = F.array(*map(F.lit, ("there", "that", "nicht", "pour")))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_intersect(names, words)).alias("entity"))


@query("stub_pages", "SELECT source, '# ' || source || chr(10) || 'Documents: ' || count(*) || chr(10) || 'Languages: ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) AS body FROM documents GROUP BY source")
def stub_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("langs"))
    return rows.select("source", F.concat(F.lit("# "), "source", F.lit("\nDocuments: "), F.col("n").cast("string"), F.lit("\nLanguages: "), F.array_join("langs", ", ")).alias("body"))


@query("question_variants", "SELECT conv_id, turn, unnest([text, 'A passage that answers: ' || text, 'Background on ' || text]) AS variant FROM conversations WHERE role = 'user'")
def question_variants(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(models.variants(F.col("text"))).alias("variant"))


def answered(hits: DataFrame, question: str) -> DataFrame:
    """One row: the context of hits (doc_id, rank, text), an answer by the offline generator, and the sources; a refusal without hits."""
    part = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit("] "), "text")
    rows = hits.agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part"), "doc_id"))).alias("h"))
    context = F.array_join(F.transform("h", lambda x: x["part"]), "\n\n---\n\n")
    return rows.select(F.when(F.size("h") == 0, "No documents answer this.").otherwise(models.template_answer(F.concat(F.lit(f"{question}\n"), context))).alias("answer"), F.transform("h", lambda x: x["doc_id"]).alias("sources"))


@query("health_checks", "SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'unhealthy' WHEN value > 80 THEN 'degraded' ELSE 'healthy' END AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def health_checks(spark, sf_dir):
    """Each component's last check; slow ones are degraded. The last is found by a sum, not in a window."""
    state = F.when(F.col("event_type") == "error", "unhealthy").when(F.col("value") > 80, "degraded").otherwise("healthy")
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", state.alias("state"))).alias("x"))
    return last.select("user_id", "x.event_id", "x.state")
