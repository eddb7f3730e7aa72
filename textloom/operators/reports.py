"""Snapshots, trends and gates over the corpus, its names and its vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import shared
from textloom.functions import models, text
from textloom.operators.retrieval import _EVAL, _evaluation
from textloom.registry import query, table, typed

AS_OF = "2024-01-31"
#: Gates of an evaluation; the price of a page that a vision model reads; weights of a reading's quality.
GATES = {"p_5": 0.50, "r_10": 0.60, "mrr": 0.40, "any_hit": 0.70}
PAGE_PRICE, READ_WEIGHT, COMPLETE_WEIGHT, READ_ELSE = 0.0025, 0.6, 0.4, 0.8


def _histogram(rows: DataFrame, by: str, top: int | None = None) -> DataFrame:
    """One row: 'value=count' of the commonest values first; the distinct values of a type or source are few, topics are cut to the top."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).cast("string").alias("v")).agg(F.count("*").alias("n"))
    if top:
        counts = counts.orderBy(F.desc("n"), "v").limit(top)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "v"))), lambda x: F.concat(x["v"], F.lit("="), (-x["m"]).cast("string")))
    return counts.agg(listed.alias(by))


def snapshot(docs: DataFrame, as_of: Column) -> DataFrame:
    """One row over (type, source, topics, signal, quality, size, ingested, hash): histograms of types and sources, the ten commonest topics, means of positive scores, duplicates and their share, how many came in the last 1, 7 and 30 days, and sizes."""
    age = (as_of.cast("timestamp").cast("double") - F.col("ingested").cast("timestamp").cast("double")) / 86400
    positive = lambda c: F.round(F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), 6).alias(f"mean_{c}")
    within = lambda d: F.count_if(age < d).alias(f"last_{d}_days")
    plain = docs.agg(F.count("*").alias("documents"), positive("signal"), positive("quality"), within(1), within(7), within(30), F.round(F.coalesce(F.sum("size"), F.lit(0)) / (1 << 20), 6).alias("megabytes"), F.round(F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))), F.lit(0)) / 1024, 6).alias("mean_kilobytes"))
    copies = docs.where("hash <> ''").groupBy("hash").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))
    out = plain.crossJoin(copies).withColumn("duplicate_rate", F.round(F.coalesce(F.col("duplicates") / F.nullif("documents", F.lit(0)), F.lit(0.0)), 6))  # one row each
    for rows, by, top in ((docs, "type", None), (docs, "source", None), (docs.select(F.explode("topics").alias("topic")), "topic", 10)):
        out = out.crossJoin(_histogram(rows, by, top))
    return out


def _ingested(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = F.expr(f"timestamp_ntz'{AS_OF} 00:00:00' - make_interval(0, 0, 0, 0, cast(doc_id % 1500 as int))")
    words = F.slice(F.array_distinct(text.tokens(F.col("text"))), 1, 3)
    return docs.select(F.col("lang").alias("type"), "source", words.alias("topics"), (F.col("doc_id") % 10 / 10.0).alias("signal"), F.when(F.col("doc_id") % 3 == 0, 0.0).otherwise(F.col("doc_id") % 7 / 7.0).alias("quality"), F.col("n_chars").alias("size"), at.alias("ingested"), text.content_hash(F.col("text")).alias("hash"))


_HIST = lambda rows, by: f"(SELECT list(v || '=' || n ORDER BY n DESC, v) FROM (SELECT {by} AS v, count(*) AS n FROM {rows} GROUP BY 1))"


@query("corpus_snapshot", typed(f"""WITH d AS (SELECT *, (doc_id % 10) / 10.0 AS signal, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE (doc_id % 7) / 7.0 END AS quality, (doc_id % 1500) / 24.0 AS age, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS u, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
t AS (SELECT unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3]) AS topic FROM d), n AS (SELECT topic, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, topic LIMIT 10)
SELECT count(*) AS documents, round(coalesce(avg(signal) FILTER (signal > 0), 0), 6) AS mean_signal, round(coalesce(avg(quality) FILTER (quality > 0), 0), 6) AS mean_quality, count(*) FILTER (age < 1) AS last_1_days, count(*) FILTER (age < 7) AS last_7_days, count(*) FILTER (age < 30) AS last_30_days,
round(sum(n_chars) / 1048576.0, 6) AS megabytes, round(avg(n_chars) FILTER (n_chars > 0) / 1024.0, 6) AS mean_kilobytes, count(*) - count(DISTINCT sha256(text)) AS duplicates, round((count(*) - count(DISTINCT sha256(text))) / count(*), 6) AS duplicate_rate,
{_HIST("documents", "lang")} AS type, {_HIST("documents", "source")} AS source, (SELECT list(topic || '=' || n ORDER BY n DESC, topic) FROM n) AS topic FROM d""", mean_signal="DOUBLE", mean_quality="DOUBLE", megabytes="DOUBLE", mean_kilobytes="DOUBLE", duplicate_rate="DOUBLE"))
def corpus_snapshot(spark, sf_dir):
    """The whole state of the corpus in one row."""
    return snapshot(_ingested(spark, sf_dir), F.expr(f"timestamp_ntz'{AS_OF} 00:00:00'"))


def drift_report(now: DataFrame, base: DataFrame) -> DataFrame:
    """The snapshots ``now`` (source, signal, duplicate_rate, topics, critical) against the one in ``base``: trends of signal (5 %) and duplicates (10 %), and what to look at."""
    one = now.crossJoin(base.select(*(F.col(c).alias(f"b_{c}") for c in ("signal", "duplicate_rate", "topics"))))  # base is one row
    trend = lambda c, by: F.when(F.col(f"b_{c}") > 0, F.when(F.col(c) > F.col(f"b_{c}") * (1 + by), "increasing").when(F.col(c) < F.col(f"b_{c}") * (1 - by), "decreasing").otherwise("stable"))
    todo = F.array_compact(F.array(F.when(F.col("critical"), "quality"), F.when(F.col("duplicate_rate") > 0.15, "duplicates"), F.when(F.col("signal") < 0.5, "signal"), F.when(F.col("topics") < F.col("b_topics") * 0.7, "topics")))
    return one.select("source", trend("signal", 0.05).alias("signal"), trend("duplicate_rate", 0.1).alias("duplicates"), todo.alias("recommendations"))


@query("drift_report", """WITH s AS (SELECT source, avg(n_chars) / 10000 AS signal, 1 - count(DISTINCT sha256(text)) / count(*) AS dup, count(DISTINCT lang) AS topics FROM documents GROUP BY source), b AS (SELECT * FROM s WHERE source = 'src1')
SELECT s.source, CASE WHEN b.signal > 0 THEN CASE WHEN s.signal > b.signal * 1.05 THEN 'increasing' WHEN s.signal < b.signal * 0.95 THEN 'decreasing' ELSE 'stable' END END AS signal, CASE WHEN b.dup > 0 THEN CASE WHEN s.dup > b.dup * 1.1 THEN 'increasing' WHEN s.dup < b.dup * 0.9 THEN 'decreasing' ELSE 'stable' END END AS duplicates,
list_filter([CASE WHEN s.signal < 0.75 * b.signal THEN 'quality' END, CASE WHEN s.dup > 0.15 THEN 'duplicates' END, CASE WHEN s.signal < 0.5 THEN 'signal' END, CASE WHEN s.topics < b.topics * 0.7 THEN 'topics' END], lambda x: x IS NOT NULL) AS recommendations FROM s, b""")
def drift_report_query(spark, sf_dir):
    """Each source against the first."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg((F.avg("n_chars") / 10000).alias("signal"), (1 - F.countDistinct(text.content_hash(F.col("text"))) / F.count("*")).alias("duplicate_rate"), F.countDistinct("lang").alias("topics"))
    base = s.where("source = 'src1'").select("signal", "duplicate_rate", "topics")
    now = s.crossJoin(base.select(F.col("signal").alias("level"))).withColumn("critical", F.col("signal") < 0.75 * F.col("level"))
    return drift_report(now, base)


@query("dedup_stats", typed("""WITH a AS (SELECT lower(w) AS canonical, lang AS kind, count(DISTINCT w) AS aliases FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(text, '[\\p{L}]{4,}'))) AS w FROM documents) GROUP BY ALL)
SELECT count(*) AS entities, sum(aliases) AS aliases, round(sum(aliases) / count(*), 2) AS mean_aliases, round((sum(aliases) - count(*)) / sum(aliases) * 100, 1) AS dedup_rate, (SELECT list(kind || '=' || n ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM a GROUP BY kind)) AS by_kind FROM a""", aliases="BIGINT", mean_aliases="DOUBLE", dedup_rate="DOUBLE"))
def dedup_stats(spark, sf_dir):
    """Canonical names, their spellings, and how many the deduplication saves; by kind."""
    a = spellings(spark, sf_dir).groupBy("canonical", "kind").agg(F.countDistinct("name").alias("aliases"))
    kinds = a.groupBy("kind").agg(F.count("*").alias("entities"), F.sum("aliases").alias("aliases"))
    listed = F.array_sort(F.collect_list(F.concat("kind", F.lit("="), F.col("entities").cast("string"))))
    return kinds.agg(F.sum("entities").alias("entities"), F.sum("aliases").alias("aliases"), F.round(F.sum("aliases") / F.sum("entities"), 2).alias("mean_aliases"), F.round((F.sum("aliases") - F.sum("entities")) / F.sum("aliases") * 100, 1).alias("dedup_rate"), listed.alias("by_kind"))


def spellings(spark, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}]{4,}"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), F.explode(words).alias("name")).withColumn("canonical", F.lower("name"))


@query("entity_mappings", "WITH m AS (SELECT DISTINCT lang AS kind, unnest(regexp_extract_all(text, '[\\p{L}]{4,}')) AS name FROM documents) SELECT kind, lower(name) AS canonical, list_sort(list(name)) AS aliases FROM m GROUP BY ALL HAVING count(*) > 1")
def entity_mappings(spark, sf_dir):
    """Canonical names with all their spellings, if they have several."""
    m = spellings(spark, sf_dir).select("kind", "canonical", "name").distinct()
    return m.groupBy("kind", "canonical").agg(F.array_sort(F.collect_list("name")).alias("aliases")).where(F.size("aliases") > 1)


@query("entities_by_mentions", "SELECT lower(w) AS name, count(*) AS mentions FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS w FROM documents) GROUP BY 1 ORDER BY mentions DESC, name LIMIT 50")
def entities_by_mentions(spark, sf_dir):
    """The most mentioned names."""
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("w")).groupBy(F.lower("w").alias("name")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "name").limit(50)


def gated(metrics: DataFrame) -> DataFrame:
    """(gate, value, least, passed) of a one-row table of metrics."""
    rows = F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.lit(v).alias("least"), (F.col(k) >= v).alias("passed")) for k, v in GATES.items()))
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


@query("gold_gates", """WITH q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, q.label AS wanted, e.label, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank FROM q JOIN embeddings e ON e.vec_id <> q.query_id QUALIFY rank <= 10),
t AS (SELECT query_id, (SELECT count(*) FROM embeddings e WHERE e.label = q.label) - 1 AS expected FROM q), m AS (SELECT query_id, sum((wanted = label AND rank <= 5)::INT) / 5.0 AS p5, sum((wanted = label)::INT) AS h10, min(CASE WHEN wanted = label THEN rank END) AS first FROM s GROUP BY query_id),
a AS (SELECT round(avg(round(p5, 6)), 6) AS p_5, round(avg(round(h10 / expected, 6)), 6) AS r_10, round(avg(round(coalesce(1.0 / first, 0), 6)), 6) AS mrr, round(avg((h10 > 0)::INT), 6) AS any_hit FROM t JOIN m USING (query_id) WHERE expected > 0)
SELECT unnest(['p_5', 'r_10', 'mrr', 'any_hit']) AS gate, unnest([p_5, r_10, mrr, any_hit]) AS value, unnest([0.5, 0.6, 0.4, 0.7])::DOUBLE AS least, unnest([p_5 >= 0.5, r_10 >= 0.6, mrr >= 0.4, any_hit >= 0.7]) AS passed FROM a""")
def gold_gates(spark, sf_dir):
    """Whether the vector search of every twentieth vector is good enough."""
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return gated(_evaluation(spark, sf_dir).agg(mean("p_5", "p_5"), mean("r_10", "r_10"), mean("rr", "mrr"), mean((F.col("p_10") > 0).cast("int"), "any_hit")))


def enrichment_quality(confidence: Column, completeness: Column) -> Column:
    """Of what is read and how much of it is there, in whole thousandths, halves up; 0.8 and 1 where unknown. Counted in decimals of six places, so that a tie is one."""
    exact = lambda c, other: F.coalesce(c.cast("decimal(12,6)"), F.lit(str(other)).cast("decimal(12,6)"))
    weight = lambda x: F.lit(str(x)).cast("decimal(2,1)")
    return F.round(weight(READ_WEIGHT) * exact(confidence, READ_ELSE) + weight(COMPLETE_WEIGHT) * exact(completeness, 1), 3).cast("double")


@query("enrichment_quality", "SELECT event_id, round(0.6::DECIMAL(2, 1) * coalesce(CASE WHEN event_type <> 'view' THEN value::DECIMAL(9, 2) * 0.01::DECIMAL(3, 2) END, 0.8::DECIMAL(12, 4)) + 0.4::DECIMAL(2, 1) * coalesce(CASE WHEN user_id % 3 > 0 THEN (user_id % 10)::DECIMAL(9, 1) * 0.1::DECIMAL(2, 1) END, 1::DECIMAL(12, 2)), 3)::DOUBLE AS quality FROM events")
def enrichment_quality_query(spark, sf_dir):
    """Amounts and users stand for what was read with which confidence and how complete it is."""
    read = F.when(F.col("event_type") != "view", F.col("value").cast("decimal(9,2)") * F.lit("0.01").cast("decimal(3,2)"))
    whole = F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 10).cast("decimal(9,1)") * F.lit("0.1").cast("decimal(2,1)"))
    return table(spark, sf_dir, "events").select("event_id", enrichment_quality(read, whole).alias("quality"))


@query("vision_costs", typed("SELECT source, count(*) AS documents, sum(least(10, greatest(1, n_chars // 2000))) AS pages, round(sum(least(10, greatest(1, n_chars // 2000))) * 0.0025, 6) AS cost FROM documents GROUP BY source", pages="BIGINT", cost="DOUBLE"))
def vision_costs(spark, sf_dir):
    """What a vision model costs for at most ten pages of each document."""
    pages = F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 2000)))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(pages).alias("pages"), F.round(F.sum(pages) * PAGE_PRICE, 6).alias("cost"))


def flat_vocabulary(entries: DataFrame) -> DataFrame:
    """(category, term) of (category, terms), without the category meta."""
    return entries.where("category <> 'meta'").select("category", F.explode("terms").alias("term"))


@query("vocabulary_flat", "SELECT category, term, (SELECT count(DISTINCT lang) FROM documents d WHERE d.source = term) AS languages FROM (SELECT CASE WHEN user_id % 4 = 0 THEN 'meta' ELSE 'c' || (user_id % 4) END AS category, 'src' || (user_id % 20) AS term FROM events) WHERE category <> 'meta' GROUP BY ALL")
def vocabulary_flat(spark, sf_dir):
    """A vocabulary of categories laid flat, with the languages that documents of each term have."""
    category = F.when(F.col("user_id") % 4 == 0, "meta").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")))
    entries = table(spark, sf_dir, "events").groupBy(category.alias("category")).agg(F.collect_set(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"))).alias("terms"))  # twenty at most
    known = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("term")).agg(F.countDistinct("lang").alias("languages"))
    return flat_vocabulary(entries).join(known, "term", "left").select("category", "term", F.coalesce("languages", F.lit(0)).alias("languages"))


@query("daily_summaries", "SELECT d.doc_id, p.url AS exported, substr(p.html, 1, 20) AS summary FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id")
def daily_summaries(spark, sf_dir):
    """A day's documents with the summaries of their exported files, where there are such."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("exported"), F.substring("html", 1, 20).alias("summary"))
    return table(spark, sf_dir, "documents").select("doc_id").join(files, "doc_id", "left")


# Tags that are always offered.
WORKFLOW_TAGS = {"Input": "cont/in/read, cont/in/extract, cont/in/add", "Process": "cont/zk/connect, cont/zk/proceed", "Output": "output/idea, output/develop", "Types": "literature, permanent, fleeting, hub, hub/moc", "Projects": "project/active, project/idle, project/finished"}


def tag_prompt(frequency: DataFrame, most: int = 20) -> DataFrame:
    """One row: the commonest tags of (tag, n), then the workflow tags, as a model is told them."""
    top = frequency.orderBy(F.desc("n"), "tag").limit(most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag"))), lambda x: x["tag"]), ", ")
    base = "\n".join(f"- {k}: {v}" for k, v in WORKFLOW_TAGS.items())
    return top.agg(F.concat(F.when(F.count("*") > 0, F.concat(F.lit("Existing tags: "), listed, F.lit("\n"))).otherwise(""), F.lit(base)).alias("prompt"))


_BASE_TAGS = "\n".join(f"- {k}: {v}" for k, v in WORKFLOW_TAGS.items())


@query("tag_prompt", f"SELECT 'Existing tags: ' || string_agg(tag, ', ' ORDER BY n DESC, tag) || chr(10) || '{_BASE_TAGS}' AS prompt FROM (SELECT lang || '/' || source AS tag, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, tag LIMIT 20)")
def tag_prompt_query(spark, sf_dir):
    return tag_prompt(table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("tag")).agg(F.count("*").alias("n")))


@query("weekly_summaries", "SELECT date_trunc('week', ts)::DATE AS week, 'Summary of week ' || date_trunc('week', ts)::DATE AS answer, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL")
def weekly_summaries(spark, sf_dir):
    """A summary of each week by the offline generator, from a line for each kind of event."""
    kinds = table(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.concat("event_type", F.lit(": "), F.col("n").cast("string"))))  # a line for each kind
    return kinds.groupBy("week").agg(lines.alias("lines")).select("week", models.template_answer(models.weekly_prompt(F.col("week"), F.col("lines"))).alias("answer"), F.size("lines").cast("long").alias("kinds"))


_DELTAS = ("p_5", "p_10", "r_5", "r_10", "rr", "any_hit")


def run_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: by how much each mean of an evaluation's metrics (a row for each query) has changed from one run to the other."""
    means = lambda run, name: run.withColumn("any_hit", (F.col("p_10") > 0).cast("int")).agg(*(F.avg(c).alias(f"{name}_{c}") for c in _DELTAS))
    both = means(before, "a").crossJoin(means(after, "b"))  # one row each
    return both.select(*(F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), 6).alias(c) for c in _DELTAS))


@query("run_deltas", _EVAL + "x AS (SELECT query_id % 40 = 0 AS old, round(p5, 6) AS p_5, round(p10, 6) AS p_10, round(h5 / expected, 6) AS r_5, round(h10 / expected, 6) AS r_10, round(coalesce(1.0 / first, 0), 6) AS rr, (p10 > 0)::INT AS any_hit FROM t JOIN m USING (query_id) WHERE expected > 0) SELECT ".replace("x AS", ", x AS", 1) + ", ".join(f"round(avg({c}) FILTER (NOT old) - avg({c}) FILTER (old), 6) AS {c}" for c in _DELTAS) + " FROM x")
def run_deltas_query(spark, sf_dir):
    """Two halves of the vector queries as two runs."""
    runs = shared.written(_evaluation(spark, sf_dir), "evaluation")
    return run_deltas(runs.where("query_id % 40 = 0"), runs.where("query_id % 40 <> 0"))
