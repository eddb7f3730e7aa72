"""Enrichment, gates, triage and filters of documents."""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.functions import dates, scores, text
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, spread, table, typed

#: A header with every feature that the invented prose lacks, made alike in Spark and in SQL.
HEAD = "'Re: Offer ' || doc_id || chr(10) || 'Due until 2024-0' || (doc_id % 9 + 1) || '-15 or 31.12.2023, call at ' || (doc_id % 12 + 1) || ':30 PM about $' || (doc_id % 900) || '.50 and ' || (doc_id % 100) || '%.' || chr(10)"
_NOTED = f"SELECT *, {HEAD} || text AS body FROM documents"


def noted(spark, sf_dir: str) -> DataFrame:
    n = lambda k: (F.col("doc_id") % k).cast("string")
    head = F.concat(
        F.lit("Re: Offer "), F.col("doc_id").cast("string"), F.lit("\nDue until 2024-0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit("-15 or 31.12.2023, call at "), (F.col("doc_id") % 12 + 1).cast("string"),
        F.lit(":30 PM about $"), n(900), F.lit(".50 and "), n(100), F.lit("%.\n"),
    )
    return table(spark, sf_dir, "documents").withColumn("body", F.concat(head, "text"))


@query("tokens", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS n_distinct, floor(length(text) / 4)::BIGINT AS estimated FROM documents")
def tokens(spark, sf_dir):
    words = text.tokens(F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(words).alias("n_tokens"), F.size(F.array_distinct(words)).alias("n_distinct"), text.estimated_tokens(F.col("text")).alias("estimated"))


@query("content_ids", "SELECT doc_id, sha256(text) AS content_hash, substr(sha256(text), 1, 16) AS short_hash, substr(sha256(text), 1, 4) AS short_id, md5(source || ':' || lang) AS cache_key FROM documents")
def content_ids(spark, sf_dir):
    h = text.content_hash(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash"), F.substring(h, 1, 16).alias("short_hash"), F.substring(h, 1, 4).alias("short_id"), F.md5(F.concat_ws(":", "source", "lang").cast("binary")).alias("cache_key"))


_MARKS = {k: " + ".join(f"(contains(lower(text), ' {w} '))::INT" for w in ws) for k, ws in text.LANGUAGE_MARKERS.items()}


@query("detect_language", f"""WITH s AS (SELECT doc_id, lang, {', '.join(f'{v} AS {k}' for k, v in _MARKS.items())} FROM documents)
SELECT doc_id, lang, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS detected FROM s""")
def detect_language(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", text.language(F.col("text")).alias("detected"))


@query("extract_dates", f"""WITH d AS ({_NOTED}), x AS (SELECT doc_id, list_concat(regexp_extract_all(body, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), list_transform(list_filter(regexp_extract_all(body, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}'), lambda v: try_strptime(v, '%d.%m.%Y') IS NOT NULL), lambda v: strftime(strptime(v, '%d.%m.%Y'), '%Y-%m-%d'))) AS v FROM d)
SELECT doc_id, list_sort(list_distinct(v)) AS dates FROM x""")
def extract_dates(spark, sf_dir):
    return noted(spark, sf_dir).select("doc_id", dates.absolute_dates(F.col("body")).alias("dates"))


@query("extract_numbers")
def extract_numbers(spark, sf_dir):
    """Amounts, shares and times (no SQL: DuckDB's word boundaries are ASCII)."""
    return noted(spark, sf_dir).select("doc_id", text.numbers(F.col("body")).alias("numbers"))


@query("event_types", f"SELECT doc_id, CASE WHEN regexp_matches(lower(body), 'deadline|frist|späteste|bis|until|due') THEN 'Deadline' WHEN regexp_matches(lower(body), 'meeting|termin|besprechung|conference|call') THEN 'Meeting' WHEN regexp_matches(lower(body), 'hearing|verhandlung|gericht|court') THEN 'Court Hearing' WHEN regexp_matches(lower(body), 'anmeldung|einschulung|school|enrollment') THEN 'School Event' ELSE 'Event' END AS event_type FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE body END AS body FROM ({_NOTED}))")
def event_types(spark, sf_dir):
    body = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.col("body"))
    return noted(spark, sf_dir).select("doc_id", dates.event_type(body).alias("event_type"))


_LEN = "CASE WHEN length(trim(text)) < 100 THEN length(trim(text)) / 100.0 WHEN length(trim(text)) < 300 THEN 0.7 ELSE 1.0 END"
_SCORED = f"""SELECT doc_id, q, nv, a, 0.4 * q + 0.3 * nv + 0.3 * a AS s, kind FROM (SELECT doc_id, ({_LEN} + CASE WHEN contains(text, '.') THEN 1.0 ELSE 0.7 END + (doc_id % 11) / 10.0) / 3 AS q,
CASE WHEN doc_id < 10 THEN 0.9 WHEN doc_id < 50 THEN 0.7 WHEN doc_id < 200 THEN 0.6 ELSE 0.5 END AS nv,
least(1.0, 0.5 + CASE WHEN source = 'src1' THEN 0.2 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.2 ELSE 0 END + CASE WHEN lang = 'fr' THEN 0.1 ELSE 0 END + CASE WHEN n_chars > 1000 THEN 0.1 ELSE 0 END) AS a,
CASE doc_id % 5 WHEN 0 THEN 'email_thread' WHEN 1 THEN 'chat_daily' WHEN 2 THEN 'note' WHEN 3 THEN 'legal' ELSE 'generic' END AS kind FROM documents)"""
_GATES = " ".join(f"WHEN '{k}' THEN round(q, 9) >= {q} AND round(s, 9) >= {s}" for k, (q, s) in scores.GATES.items())


def scored(docs: DataFrame) -> DataFrame:
    """Quality, novelty, actionability, signal and gate of documents; parts that the tables lack are made from the id."""
    q = scores.quality(F.col("text"), ocr=(F.col("doc_id") % 11) / 10.0, structured=F.col("text").contains("."))
    a = scores.actionability(F.col("source") == "src1", F.col("lang") == "de", F.col("lang") == "fr", F.col("n_chars") > 1000)
    name = F.element_at(F.array(*map(F.lit, ("Email thread", "chat log", "notes", "court file", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    parts = F.struct(q.alias("quality"), scores.novelty(F.col("doc_id")).alias("novelty"), a.alias("actionability"), scores.gate_type(name).alias("kind"))

    def rest(x):  # each part is computed once, however often it is used here
        s = scores.signal(x["quality"], x["novelty"], x["actionability"])
        good = scores.gate(x["kind"], F.round(x["quality"], 9), F.round(s, 9))
        return F.struct(*(x[k].alias(k) for k in ("quality", "novelty", "actionability", "kind")), s.alias("signal"), good.alias("do_index"), (good & (F.round(x["quality"], 9) >= 0.6) & (F.round(s, 9) >= 0.5)).alias("canonical"))

    return docs.select("*", F.transform(F.array(parts), rest)[0].alias("scored")).select(*docs.columns, "scored.*")


@query("score_documents", typed(f"SELECT doc_id, round(q, 3) AS quality, round(nv, 3) AS novelty, round(a, 3) AS actionability, round(s, 6) AS signal, kind, CASE kind {_GATES} END AS do_index FROM ({_SCORED})", novelty="DOUBLE", actionability="DOUBLE"))
def score_documents(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents")).select("doc_id", F.round("quality", 3).alias("quality"), F.round("novelty", 3).alias("novelty"), F.round("actionability", 3).alias("actionability"), F.round("signal", 6).alias("signal"), "kind", "do_index")


@query("canonical_corpus", f"""WITH s AS ({_SCORED}), f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text))
SELECT doc_id FROM s JOIN f USING (doc_id) WHERE CASE kind {_GATES} END AND round(q, 9) >= 0.6 AND round(s, 9) >= 0.5""")
def canonical_corpus(spark, sf_dir):
    """What may be indexed, is good enough, and isn't a duplicate."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(text.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    good = scored(docs).where("canonical").select("doc_id")
    return good.join(first, "doc_id", "left_semi")


@query("search_filters", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') AND d.source = 'src1' AND l.quality >= 1 AND l.toxic = 0")
def search_filters(spark, sf_dir):
    """The hard filters as predicates that reach the scans."""
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de") & (F.col("source") == "src1")).select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").where("quality >= 1 and toxic = 0").select("doc_id"), "doc_id", "left_semi")


_JUNK = " + ".join(f"(contains(lower(body), '{w}'))::INT" for w in scores.JUNK_WORDS)


@query("triage", typed(f"""WITH d AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 7 = 0 THEN 'Special offer, click here! ' WHEN doc_id % 7 = 1 THEN 'Invoice. ' WHEN doc_id % 7 = 2 THEN 'Wedding on 2024-05-01. ' ELSE '' END || text AS body FROM documents),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first, {_JUNK} AS junk FROM d)
SELECT doc_id, CASE WHEN first < doc_id THEN 'duplicate' WHEN junk >= 2 THEN 'junk' WHEN regexp_matches(lower(body), 'hochzeit|wedding|heiraten|marry|married') AND regexp_matches(body, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'personal_actionable'
WHEN regexp_matches(lower(body), 'invoice|rechnung|payment|betrag|total') THEN 'financial_actionable' ELSE 'archival' END AS category,
round(CASE WHEN first < doc_id THEN 1.0 WHEN junk >= 2 THEN least(0.9, 0.5 + 0.1 * junk) WHEN regexp_matches(lower(body), 'hochzeit|wedding|heiraten|marry|married') AND regexp_matches(body, '\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 0.85
WHEN regexp_matches(lower(body), 'invoice|rechnung|payment|betrag|total') THEN 0.8 ELSE 0.5 END, 6) AS confidence FROM f""", confidence="DOUBLE"))
def triage(spark, sf_dir):
    """What becomes of each document: ordered rules, exact duplicates first."""
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(text.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    lead = F.when(F.col("doc_id") % 7 == 0, "Special offer, click here! ").when(F.col("doc_id") % 7 == 1, "Invoice. ").when(F.col("doc_id") % 7 == 2, "Wedding on 2024-05-01. ").otherwise("")
    d = docs.select("doc_id", text.content_hash(F.col("text")).alias("h"), F.concat(lead, "text").alias("body")).withColumn("junk", scores.junk_count(F.col("body")))
    low = F.lower("body")
    wedding = low.rlike("hochzeit|wedding|heiraten|marry|married") & F.col("body").rlike(r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d{2}-\d{2}")
    invoice = low.rlike("invoice|rechnung|payment|betrag|total")
    d = d.select("doc_id", "h", "junk", wedding.alias("wedding"), invoice.alias("invoice")).join(first, "h", "left")
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    pick = lambda a, b, c, d_, e: F.when(copy, a).when(F.col("junk") >= 2, b).when(F.col("wedding"), c).when(F.col("invoice"), d_).otherwise(e)
    return d.select("doc_id", pick("duplicate", "junk", "personal_actionable", "financial_actionable", "archival").alias("category"), F.round(pick(1.0, F.least(F.lit(0.9), 0.5 + 0.1 * F.col("junk")), 0.85, 0.8, 0.5), 6).alias("confidence"))


#: The rule of a rough fingerprint: the commonest terms among the first words; and how far lengths may lie apart.
FIRST_WORDS, TOP_TERMS, WORDS_APART = 1000, 50, 100


def fuzzy_hash(words: Column) -> Column:
    """MD5 of the 50 commonest of the first thousand words with their counts, of equals the first in the text."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        of = lambda w: hashlib.md5(",".join(f"{t}:{n}" for t, n in Counter(w).most_common(TOP_TERMS)).encode()).hexdigest()
        return lists.map(lambda w: of(w if w is not None else []))

    return run(F.slice(words, 1, FIRST_WORDS))


def rough_duplicates(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, fuzzy_hash, n_links, component_id) of documents that share their fuzzy hash with others less than 100 words longer or shorter.

    n_links counts those; component_id is the smallest doc_id that links lead to. Documents of one hash and length are
    one class with a count first, and chains are runs of lengths without a gap, so no pair is made. A null text is empty.
    """
    whole = F.coalesce(F.col(body), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), text.word_count(whole).alias("words"), fuzzy_hash(text.tokens(whole)).alias("fuzzy_hash"))
    d = shared.written(d, "fuzzy")
    classes = d.groupBy("fuzzy_hash", "words").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    by = Window.partitionBy("fuzzy_hash").orderBy("words")
    near = F.sum("n").over(by.rangeBetween(1 - WORDS_APART, WORDS_APART - 1))
    fresh = F.coalesce((F.col("words") - F.lag("words").over(by) >= WORDS_APART).cast("int"), F.lit(0))
    classes = classes.withColumn("near", near).withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(by)).where("near > 1")
    classes = classes.withColumn("component_id", F.min("first").over(Window.partitionBy("fuzzy_hash", "run")))
    return d.join(classes.select("fuzzy_hash", "words", "near", "component_id"), ["fuzzy_hash", "words"]).select("doc_id", "fuzzy_hash", (F.col("near") - 1).alias("n_links"), "component_id")


@query("fuzzy_duplicates", """WITH w AS (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1, 1000) AS w, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM documents),
t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w), c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS p FROM t GROUP BY doc_id, term QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) <= 50),
g AS (SELECT doc_id, md5(string_agg(term || ':' || n, ',' ORDER BY n DESC, p)) AS h FROM c GROUP BY doc_id), h AS (SELECT doc_id, words, coalesce(h, md5('')) AS h FROM w LEFT JOIN g USING (doc_id)),
l AS (SELECT a.doc_id, a.h, a.words, b.doc_id AS other FROM h a JOIN h b ON a.h = b.h AND a.doc_id <> b.doc_id AND abs(a.words - b.words) < 100),
r AS (SELECT h, words, CASE WHEN words - lag(words) OVER (PARTITION BY h ORDER BY words) >= 100 THEN 1 ELSE 0 END AS fresh FROM (SELECT DISTINCT h, words FROM h)), i AS (SELECT h, words, sum(fresh) OVER (PARTITION BY h ORDER BY words) AS run FROM r),
m AS (SELECT h.h, run, min(doc_id) AS component_id FROM h JOIN i ON h.h = i.h AND h.words = i.words GROUP BY ALL)
SELECT doc_id, l.h AS fuzzy_hash, count(*) AS n_links, any_value(component_id) AS component_id FROM l JOIN i ON l.h = i.h AND l.words = i.words JOIN m ON m.h = i.h AND m.run = i.run GROUP BY ALL""")
def fuzzy_duplicates(spark, sf_dir):
    """Documents that share a rough fingerprint and nearly their length."""
    return rough_duplicates(table(spark, sf_dir, "documents"))


@query("html_text", """WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->', '', 'g') AS h FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<nav\\b.*?</nav\\s*>', '', 'g'), '(?is)<footer\\b.*?</footer\\s*>', '', 'g'), '(?is)<header\\b.*?</header\\s*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', chr(10), 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM b)
SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM c""")
def html_text(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", text.from_html(F.col("html")).alias("body"))


@query("subjects", "WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'FWD:  ' WHEN 2 THEN 'Re: re: ' ELSE '' END || source || '  report' AS subject FROM documents), n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(trim(subject), '(?i)^(re|fw|fwd):\\s*', ''), '\\s+', ' ', 'g'))) AS normal FROM d) SELECT normal, substr(md5(normal), 1, 12) AS thread_id, count(*) AS messages, min(doc_id) AS first FROM n GROUP BY normal")
def subjects(spark, sf_dir):
    """Threads by subject."""
    prefix = F.element_at(F.array(*map(F.lit, ("Re: ", "FWD:  ", "Re: re: ", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(prefix, "source", F.lit("  report")).alias("subject"))
    return d.groupBy(text.normal_subject(F.col("subject")).alias("normal"), text.thread_id(F.col("subject")).alias("thread_id")).agg(F.count("*").alias("messages"), F.min("doc_id").alias("first"))


@query("front_matter", "SELECT doc_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 500 THEN substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 497) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS summary FROM documents")
def front_matter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.one_line(F.col("text")).alias("summary"))


@query("calendar_events", "SELECT doc_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || substr(md5(doc_id || source), 1, 16) || chr(13) || chr(10) || 'SUMMARY:' || replace(replace(replace(replace(string_split(text, chr(10))[1], '\\', '\\\\'), ',', '\\,'), ';', '\\;'), chr(10), '\\n') || chr(13) || chr(10) || 'END:VEVENT' AS event FROM documents")
def calendar_events(spark, sf_dir):
    uid = F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), "source").cast("binary")), 1, 16)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.concat(F.lit("SUMMARY:"), text.calendar_escape(F.split("text", "\n")[0])), F.lit("END:VEVENT")).alias("event"))


#: Texts with urgent words, tasks, questions and dates before and after them.
_ASKED = Joined((Varied(("", "URGENT: ", "Please reply asap. ", "Note. "), 3), Varied(("Todo: call back. ", "", "Action needed by us. "), 5), "text", Varied((" Can we meet?", "", " On 2024-05-01.", " Why? 2023-01-02"), 7)))
_URGENT, _TASKED, _DATED_AT = r"(?i)\b(urgent|asap|immediately|dringend|sofort)\b", r"(?i)\b(todo|action needed|next step|aufgabe)\b", r"\d{4}-\d{2}-\d{2}"


@query("priorities", f"SELECT doc_id, CASE WHEN u AND a THEN 'critical' WHEN u OR a::INT + q::INT + t::INT >= 2 THEN 'high' WHEN a OR t THEN 'medium' ELSE 'low' END AS priority, CASE WHEN a OR u OR q THEN 'pending' WHEN lang IN ('en') THEN 'reference' ELSE 'active' END AS status FROM (SELECT doc_id, lang, regexp_matches(b, '{_URGENT}') AS u, regexp_matches(b, '{_TASKED}') AS a, contains(b, '?') AS q, regexp_matches(b, '{_DATED_AT}') AS t FROM (SELECT doc_id, lang, {_ASKED.sql} AS b FROM documents))")
def priorities(spark, sf_dir):
    """Urgent words, tasks, questions and dates of all texts make their priority and status."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", _ASKED.column.alias("b"))
    u, a, q, t = F.col("b").rlike(_URGENT), F.col("b").rlike(_TASKED), F.contains("b", F.lit("?")), F.col("b").rlike(_DATED_AT)
    return rows.select("doc_id", scores.priority(u, a, q, t).alias("priority"), scores.status(u, a, q, F.when(F.col("lang") == "en", "pdf").otherwise("email")).alias("status"))


def rubric_scores(body: Column, record: dict[str, Column]) -> list[Column]:
    """The offline critic's seven scores, 0 to 5, of a record (title, summary, topics, names, dates) against its text; a hosted model may give them instead.

    Fields present, names found per hundred words, topics that the text has, a summary of up to 500 characters that is shorter
    than the text, dates found where the text has digits, no address left open, and paragraphs to cut at.
    """
    d = lambda c: c.cast("decimal(6,3)")
    five = lambda c: d(F.when(c, 5).otherwise(0))
    words = F.greatest(text.word_count(body), F.lit(1))
    topics = F.coalesce(record["topics"], F.array().cast("array<string>"))
    kept = F.size(F.filter(topics, lambda t: F.contains(F.lower(body), F.lower(t))))
    filled = sum((F.when(F.length(record[k]) > 0, 1).otherwise(0) for k in ("title", "summary")), F.when(F.size(topics) > 0, 1).otherwise(0))
    return [
        d(F.element_at(F.array(*(F.lit(x).cast("decimal(6,3)") for x in ("0", "1", "3", "5"))), filled + 1)), d(F.least(F.lit(5), F.floor(F.size(F.coalesce(record["names"], F.array().cast("array<string>"))) * 100 / words))),
        d(F.when(F.size(topics) == 0, 0).otherwise(F.floor(5 * kept / F.greatest(F.size(topics), F.lit(1))))), d(F.when(F.length(record["summary"]).between(1, 500) & (F.length(record["summary"]) < F.length(body)), 5).when(F.length(record["summary"]) > 0, 3).otherwise(0)),
        d(F.when(~body.rlike("[0-9]"), 3).when(F.size(record["dates"]) > 0, 5).otherwise(1)), five(~body.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")), d(F.least(F.lit(5), F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")))),
    ]


_RUBRICS = (
    "CASE WHEN length(title) > 0 THEN 5 ELSE 3 END", "least(5, floor(len(names) * 100 / greatest(n, 1)))", "floor(5 * len(list_filter([lang, source], lambda t: contains(lower(text), lower(t)))) / 2)", "CASE WHEN length(summary) BETWEEN 1 AND 500 AND length(summary) < length(text) THEN 5 WHEN length(summary) > 0 THEN 3 ELSE 0 END",
    "CASE WHEN NOT regexp_matches(text, '[0-9]') THEN 3 WHEN len(dates) > 0 THEN 5 ELSE 1 END", r"CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}') THEN 0 ELSE 5 END", "least(5, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))",
)


@query("critic_scores", r"""WITH d AS (SELECT *, substr(string_split(text, chr(10))[1], 1, 100) AS title, substr(text, 1, 400) AS summary, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}')) AS names, regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS dates, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, round(""" + " + ".join(f"({r})::DECIMAL(6, 3) * {w}" for r, w in zip(_RUBRICS, scores.CRITIC_WEIGHTS, strict=True)) + ", 2)::DOUBLE AS overall FROM d")
def critic_scores(spark, sf_dir):
    """The critic's mean of the records of all texts: first line, first characters, language and source as topics, longer names, dates."""
    record = {"title": F.substring(F.split("text", "\n")[0], 1, 100), "summary": F.substring("text", 1, 400), "topics": F.array("lang", "source"), "names": F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{4,}"), F.lit(0))), "dates": F.regexp_extract_all("text", F.lit("[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit(0))}
    return table(spark, sf_dir, "documents").select("doc_id", scores.critic(rubric_scores(F.col("text"), record)).cast("double").alias("overall"))


def confidence(hits: DataFrame, words: list[str]) -> DataFrame:
    """Per query the confidence in an answer: relevance, coverage and quality of the hits (query_id, doc_id, score, body), and what to do."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    h = hits.withColumn("rank", rank)
    band = F.when(F.length("body").between(100, 2000), 0.4).otherwise(0.2)
    one = h.groupBy("query_id").agg(
        F.least(F.avg(F.when((F.col("rank") <= 3) & (F.col("score") > 0), F.col("score"))), F.lit(1.0)).alias("relevance"), F.least(F.avg(band + F.when(F.col("body").contains("\n"), 0.3).otherwise(0.0) + 0.3), F.lit(1.0)).alias("quality"),
        *(F.max(F.lower("body").contains(w).cast("int")).alias(f"w{k}") for k, w in enumerate(words)),
    )
    cover = sum((F.col(f"w{k}") for k in range(len(words))), F.lit(0)) / len(words)
    total = 0.5 * F.col("relevance") + 0.3 * cover + 0.2 * F.col("quality")
    return one.select("query_id", F.round("relevance", 6).alias("relevance"), F.round(cover, 6).alias("coverage"), F.round("quality", 6).alias("quality"), F.round(total, 6).alias("confidence"), F.when(F.round(total, 9) < 0.3, "refuse").when(F.round(total, 9) < 0.4, "clarify").when(F.round(total, 9) < 0.6, "partial").otherwise("answer").alias("decision"))
