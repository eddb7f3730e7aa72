"""Features and clean-up by kind of document: e-mail, chat, invoice, manual, scanned page; people and attachments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.functions import text
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, table, typed

ACTION_WORDS = ("todo", "action", "please", "required", "deadline", "asap", "task")
URGENT_WORDS = ("urgent", "asap", "immediately", "critical", "emergency")
#: Least confidence of a read page by kind, and for the rest.
READ_AGAIN = {"invoice": 0.8, "receipt": 0.8, "legal": 0.8, "note": 0.6, "email": 0.6}
READ_AGAIN_ELSE = 0.7


def any_word(c: Column, words: tuple[str, ...]) -> Column:
    return F.lower(c).rlike("|".join(words))


@query("mail_flags", f"SELECT doc_id, regexp_matches(lower(body), '{'|'.join(ACTION_WORDS)}') AS action, regexp_matches(lower(body), '{'|'.join(URGENT_WORDS)}') AS urgent FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'URGENT: ' WHEN 1 THEN 'Please ' ELSE '' END || text AS body FROM documents)")
def mail_flags(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 3 == 0, "URGENT: ").when(F.col("doc_id") % 3 == 1, "Please ").otherwise("")
    body = F.concat(lead, "text")
    return table(spark, sf_dir, "documents").select("doc_id", any_word(body, ACTION_WORDS).alias("action"), any_word(body, URGENT_WORDS).alias("urgent"))


@query("keep_together", "SELECT conv_id, count(*) < 5 AS together FROM conversations GROUP BY conv_id")
def keep_together(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.count("*") < 5).alias("together"))


@query("read_quality", "SELECT doc_id, round(1 - least(1.0, 0.7 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[aeiouáéíóúàèêäöü]') AND length(x) > 3)) / greatest(len(w), 1) + 0.3 * len(list_filter(w, lambda x: length(x) = 1)) / greatest(len(w), 1)), 6) AS quality FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)")
def read_quality(spark, sf_dir):
    """Quality of recognised text: the share of words without vowels and of single letters counts against it."""
    w = text.tokens(F.col("text"))
    share = lambda f: F.size(F.filter(w, f)) / F.greatest(F.size(w), F.lit(1))
    bad = 0.7 * share(lambda x: ~x.rlike("[aeiouáéíóúàèêäöü]") & (F.length(x) > 3)) + 0.3 * share(lambda x: F.length(x) == 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(1 - F.least(F.lit(1.0), bad), 6).alias("quality"))


# What recognised text shouldn't hold: runs of unusual characters, of pipes, of underscores; words of so many letters.
SCAN_NOISE = (r"""[^\p{L}\p{N}_\s\-.,;:!?()\[\]{}@#$%&*+=<>'"\/\\]+""", r"[|]{2,}", r"_{5,}")
LETTERS_LONG, CHARACTERS_LONG = 20, 20


def scan_quality(body: Column) -> Column:
    """1 less the share of artifacts, words of over twenty characters and single characters among the words, 0 at least; 0 without words. A word of twenty ASCII letters or more is an artifact, too."""
    w = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    n = F.size(w)
    of = lambda f: F.size(F.filter(w, f))
    noise = sum((F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0))) for p in SCAN_NOISE), of(lambda x: x.rlike(f"^[A-Za-z]{{{LETTERS_LONG},}}$")))
    bad = noise + of(lambda x: F.length(x) > CHARACTERS_LONG) + of(lambda x: F.length(x) == 1)
    return F.when(n == 0, 0.0).otherwise(1.0 - F.least(F.lit(1.0), bad / n))


_SCAN = Joined((Varied(("", "~~ ^ x || |||\n", "abcdefghijklmnopqrstuvwxyz ", "§§ • _________ y ", "a b c "), 3), "text", Varied(("", " ünüberschaubarlangeswort_und_mehr", "\n_____ |||| "), 5)))
_SQL_NOISE = " + ".join("len(regexp_extract_all(b, '" + p.replace("'", "''") + "'))" for p in SCAN_NOISE)


@query("scan_quality", f"""WITH d AS (SELECT doc_id, {_SCAN.sql} AS b FROM documents), w AS (SELECT *, regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+') AS w FROM d)
SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE 1 - least(1.0, ({_SQL_NOISE} + len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{{20,}}$'))) + len(list_filter(w, lambda x: length(x) > 20)) + len(list_filter(w, lambda x: length(x) = 1)))::DOUBLE / len(w)) END, 6) AS quality FROM w""")
def scan_quality_query(spark, sf_dir):
    """Quality of texts as recognised ones with artifacts around them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(scan_quality(_SCAN.column), 6).alias("quality"))


@query("read_again", "SELECT event_id, value / 100 < CASE event_type WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.6 ELSE 0.7 END AS again FROM events")
def read_again(spark, sf_dir):
    """Pages to be read again, by kind and confidence."""
    kind = F.when(F.col("event_type") == "view", "invoice").when(F.col("event_type") == "click", "note").otherwise("other")
    least = reduce(lambda c, kv: F.when(kind == kv[0], kv[1]).otherwise(c), READ_AGAIN.items(), F.lit(READ_AGAIN_ELSE))
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100 < least).alias("again"))


def scanned_clean(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, text): pages (split at form feeds) without the short lines that stand near the top or bottom of half of them."""
    pages = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(body, "\f")).alias("page", "content"))
    lines = pages.select("doc_id", "page", F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("l"))
    near = lines.select("doc_id", "page", F.explode(F.array_distinct(F.concat(F.slice("l", 1, 5), F.when(F.size("l") > 5, F.slice("l", F.greatest(F.lit(1), F.size("l") - 4), F.lit(5))).otherwise(F.array().cast("array<string>"))))).alias("line")).where(F.length("line") < 100)
    bad = near.groupBy("doc_id", "line").agg(F.count("*").alias("n")).join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id").where("pages > 1 and n * 2 >= pages").groupBy("doc_id").agg(F.collect_set("line").alias("bad"))
    out = pages.join(bad, "doc_id", "left").withColumn("kept", F.array_join(F.filter(F.split("content", "\n"), lambda x: F.col("bad").isNull() | ~F.array_contains("bad", F.trim(x))), "\n"))
    return out.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "kept"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: x["kept"]), "\f").alias("text"))


_TOP = Varied(("HEADER of all\n", "", "  Page\n", "A\nB\nC\nD\nE\nF\n"), 3)
_FOOT = Varied(("", "\nfoot ", "\nthe end of it\n"), 5)


@query("scanned_cleanup", f"""WITH d AS (SELECT doc_id, {_TOP.sql} || replace(text, chr(10), {_FOOT.sql} || chr(12) || {_TOP.sql}) || {_FOOT.sql} AS b FROM documents), p AS (SELECT doc_id, unnest(string_split(b, chr(12))) AS content, unnest(range(len(string_split(b, chr(12))))) AS page FROM d),
l AS (SELECT doc_id, page, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM p), n AS (SELECT DISTINCT doc_id, page, unnest(list_concat(l[1:5], CASE WHEN len(l) > 5 THEN l[greatest(1, len(l) - 4):] ELSE [] END)) AS line FROM l),
k AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id), bad AS (SELECT doc_id, list(line) AS bad FROM (SELECT n.doc_id, line FROM n JOIN k USING (doc_id) WHERE length(line) < 100 AND pages > 1 GROUP BY n.doc_id, line, pages HAVING count(*) * 2 >= pages) GROUP BY doc_id)
SELECT doc_id, string_agg(array_to_string(list_filter(string_split(content, chr(10)), lambda x: bad IS NULL OR NOT list_contains(bad, trim(x))), chr(10)), chr(12) ORDER BY page) AS text FROM l LEFT JOIN bad USING (doc_id) GROUP BY doc_id""")
def scanned_cleanup(spark, sf_dir):
    """Lines of all texts as pages, with heads and feet of several forms."""
    body = F.concat(_TOP.column, F.replace(F.col("text"), F.lit("\n"), F.concat(_FOOT.column, F.lit("\f"), _TOP.column)), _FOOT.column)
    return scanned_clean(table(spark, sf_dir, "documents").select("doc_id", body.alias("text")))


@query("attachments", "SELECT page_id AS parent_id, length(html) AS size, CASE WHEN length(html) > 10000 THEN NULL WHEN length(html) > 500 THEN substr(html, 1, 500) || '...' ELSE html END AS summary FROM pages WHERE length(html) >= 20")
def attachments(spark, sf_dir):
    """Attachments that are long enough, with their beginnings; large ones have none."""
    n = F.length("html")
    return table(spark, sf_dir, "pages").where(n >= 20).select(F.col("page_id").alias("parent_id"), n.alias("size"), F.when(n > 10000, None).when(n > 500, F.concat(F.substring("html", 1, 500), F.lit("..."))).otherwise(F.col("html")).alias("summary"))


@query("actionable_dates", "SELECT event_id, ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY OR event_type = 'purchase' AS actionable FROM events")
def actionable_dates(spark, sf_dir):
    """Dates of kept topics, or not too old."""
    return table(spark, sf_dir, "events").select("event_id", ((F.col("ts") >= F.expr("timestamp_ntz'2024-01-31 00:00:00' - interval 14 days")) | (F.col("event_type") == "purchase")).alias("actionable"))


def similar_tags(tags: DataFrame, least: float = 0.7, top: int = 5) -> DataFrame:
    """(tag, other, similarity): each tag's five most similar others: 1 if they differ in case, dashes and underscores only, 0.9 if one holds the other, else the share of common parts of their paths in the larger number of parts, if it is ``least`` or more.

    A tag that another holds shares all its trigrams with it, so that its rarest one (or itself, if shorter) is the key;
    paths with enough common parts share one of a few rarest parts. Nothing else meets.
    """
    t = tags.select("tag").distinct().withColumn("low", F.translate(F.lower("tag"), "-_", "  ")).where("low <> ''").withColumn("parts", F.array_distinct(F.split("low", "/")))
    t = shared.written(t, "tags")
    grams = lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - (n - 1)), lambda k: F.substr("low", k, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    every = t.select("tag", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    often = every.groupBy("gram").agg(F.count("*").alias("n"))
    own = every.join(t.select("tag", F.least(F.length("low"), F.lit(3)).alias("size")), "tag").where(F.length("gram") == F.col("size")).join(often, "gram")
    held = own.groupBy("tag").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram")).join(every.withColumnRenamed("tag", "other"), "gram").select("tag", "other")
    part = t.select("tag", F.size("parts").alias("size"), F.explode("parts").alias("part"))
    part = part.join(part.groupBy("part").agg(F.count("*").alias("n")), "part").withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy("n", "part"))).where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least) + 1)
    common = part.select("tag", "part").join(part.select(F.col("tag").alias("other"), "part"), "part").select("tag", "other")
    pairs = held.unionByName(held.select(F.col("other").alias("tag"), F.col("tag").alias("other"))).unionByName(common).where("tag <> other").distinct()
    both = pairs.join(t, "tag").join(t.select(F.col("tag").alias("other"), F.col("low").alias("other_low"), F.col("parts").alias("other_parts")), "other")
    share = F.size(F.array_intersect("parts", "other_parts")) / F.greatest(F.size("parts"), F.size("other_parts"))
    similar = F.when(F.col("low") == F.col("other_low"), 1.0).when(F.col("low").contains(F.col("other_low")) | F.col("other_low").contains(F.col("low")), 0.9).when(F.round(share, 9) >= least, share)
    ranked = both.select("tag", "other", F.round(similar, 6).alias("similarity")).where("similarity is not null").withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("similarity"), "other")))
    return ranked.where(F.col("rank") <= top).drop("rank")


_TAG = Varied(("", "project/", "tech/ai/ml/", "Tech_AI/", "a-b/"), 3)
_END = Varied(("", "/x", "/active/now", "-y"), 5)


@query("tag_similarity", typed(f"""WITH t AS (SELECT tag, translate(lower(tag), '-_', '  ') AS low, list_distinct(string_split(translate(lower(tag), '-_', '  '), '/')) AS parts FROM (SELECT DISTINCT {_TAG.sql} || source || {_END.sql} AS tag FROM documents)),
p AS (SELECT a.tag, b.tag AS other, CASE WHEN a.low = b.low THEN 1.0 WHEN contains(a.low, b.low) OR contains(b.low, a.low) THEN 0.9 WHEN round(len(list_intersect(a.parts, b.parts)) / greatest(len(a.parts), len(b.parts)), 9) >= 0.7 THEN round(len(list_intersect(a.parts, b.parts)) / greatest(len(a.parts), len(b.parts)), 6) END AS similarity FROM t a JOIN t b ON a.tag <> b.tag)
SELECT tag, other, similarity FROM p WHERE similarity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tag ORDER BY similarity DESC, other) <= 5""", similarity="DOUBLE"))
def tag_similarity(spark, sf_dir):
    """Tags of many forms and the tags most like them."""
    return similar_tags(table(spark, sf_dir, "documents").select(F.concat(_TAG.column, "source", _END.column).alias("tag")))


@query("run_comparison", "WITH r AS (SELECT event_type, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS a, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS b FROM events GROUP BY event_type) SELECT event_type, round(b - a, 6) AS delta, CASE WHEN b - a > 0.05 * a THEN 'up' WHEN a - b > 0.05 * a THEN 'down' ELSE 'steady' END AS trend FROM r")
def run_comparison(spark, sf_dir):
    """Two runs' means and their trend."""
    half = F.col("ts") < F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    r = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.when(half, F.col("value"))).alias("a"), F.avg(F.when(~half, F.col("value"))).alias("b"))
    d = F.col("b") - F.col("a")
    return r.select("event_type", F.round(d, 6).alias("delta"), F.when(d > 0.05 * F.col("a"), "up").when(-d > 0.05 * F.col("a"), "down").otherwise("steady").alias("trend"))


@query("overlap_rerank", "WITH q AS (SELECT ['the', 'thble', 'hest'] AS w), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents), s AS (SELECT doc_id, len(list_intersect(t, w)) / 3.0 AS score, len(t) AS n FROM d, q) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, n, doc_id LIMIT 10")
def overlap_rerank(spark, sf_dir):
    """The offline reranker: the share of the query's words that a text has, shorter texts first."""
    words = F.array_distinct(text.tokens(F.col("text")))
    score = F.size(F.array_intersect(words, F.array(F.lit("the"), F.lit("thble"), F.lit("hest")))) / 3.0
    return table(spark, sf_dir, "documents").select("doc_id", score.alias("score"), F.size(words).alias("n")).orderBy(F.desc("score"), "n", "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query("thread_lookup", "SELECT turn, role, substr(text, 1, 200) AS summary FROM conversations WHERE conv_id = 3 ORDER BY turn")
def thread_lookup(spark, sf_dir):
    """One thread's messages in order."""
    return table(spark, sf_dir, "conversations").where("conv_id = 3").orderBy("turn").select("turn", "role", F.substring("text", 1, 200).alias("summary"))


@query("corpus_views", "SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'canonical' ELSE 'full' END AS view, count(*) AS documents, list_sort(list(doc_id))[:5] AS sample FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def corpus_views(spark, sf_dir):
    """Documents of each view with five of them, found by rank."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id", F.lit("canonical").alias("v"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(good, "doc_id", "left").select("doc_id", F.coalesce("v", F.lit("full")).alias("view"))
    sums = rows.groupBy("view").agg(F.count("*").alias("documents"))
    few = [rows.where(F.col("view") == v).orderBy("doc_id").limit(5) for v in ("canonical", "full")]
    return sums.join(few[0].unionByName(few[1]).groupBy("view").agg(F.array_sort(F.collect_list("doc_id")).alias("sample")), "view")


@query("gap_rank", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events QUALIFY rank <= 3")
def gap_rank(spark, sf_dir):
    """The three largest values of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("user_id", "event_id", "rank")
