"""Aggregates, windows and rankings over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text
from textloom.registry import query, table, typed

#: Thresholds of the drift alerts.
SIGNAL_DROP, QUALITY_DROP, DUPLICATE_RISE, INGEST_SPIKE, TOPIC_SHIFT = 0.15, 0.15, 0.10, 3.0, 0.25
#: The moment that stands for now in every query, so that results don't depend on the clock.
AS_OF = "2024-01-31 00:00:00"


@query("collection_stats", "SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round(sum(length(text)) / 1048576.0, 2) AS mb FROM documents")
def collection_stats(spark, sf_dir):
    """Documents, chunks and size."""
    return table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.round(F.sum(F.length("text")) / 1048576.0, 2).alias("mb"))


@query("document_listing", "SELECT conv_id, count(*) AS chunks, arg_min(role, turn) AS first_role, arg_min(text, turn) AS first_text FROM conversations GROUP BY conv_id")
def document_listing(spark, sf_dir):
    """Rows of each document with its first one."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("chunks"), F.min_by("role", "turn").alias("first_role"), F.min_by("text", "turn").alias("first_text"))


@query("duplicate_groups", "SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    """Texts that occur more than once; summed by hash, so that no text moves."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept")).where("copies > 1")


@query("exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def exact_dedup(spark, sf_dir):
    """The first document of each text."""
    return table(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("prefix_duplicates", "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(substr(text, 1, 1000))) AS first FROM documents) WHERE doc_id <> first")
def prefix_duplicates(spark, sf_dir):
    """Documents whose first 1000 characters an earlier one has, with that one: sums by hash and a join, no window over a group of copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.substring("text", 1, 1000).cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return docs.join(first, "h").where("doc_id <> first").select("doc_id", "first")


@query("speaker_shares", "SELECT role, count(*) AS messages, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS share, round(avg(length(text)), 2) AS mean_length FROM conversations GROUP BY role")
def speaker_shares(spark, sf_dir):
    """Messages, share and mean length of each speaker."""
    out = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.round(F.avg(F.length("text")), 2).alias("mean_length"))
    return out.withColumn("share", F.round(100.0 * F.col("messages") / F.sum("messages").over(Window.partitionBy()), 2))


@query("conversation_summary", typed("SELECT conv_id, count(*) AS messages, sum((role = 'user')::INT) AS user_turns, sum((role = 'assistant')::INT) AS assistant_turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id", user_turns="BIGINT", assistant_turns="BIGINT", chars="BIGINT"))
def conversation_summary(spark, sf_dir):
    of = lambda r: F.sum((F.col("role") == r).cast("int"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), of("user").alias("user_turns"), of("assistant").alias("assistant_turns"), F.sum(F.length("text")).alias("chars"))


@query("turn_pairs", """SELECT conv_id, turn, text AS question, answer FROM (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def turn_pairs(spark, sf_dir):
    """Each question with the answer that follows it; of two questions in a row the first is lost."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("counters", "SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL")
def counters(spark, sf_dir):
    """Counter and gauge of each name and label: sum and last value."""
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def percentiles(values: DataFrame, by: str, value: str, shares: tuple[float, ...]) -> DataFrame:
    """The sorted values' elements at floor(n * share) of each group.

    Counts of distinct values are summed first, so that a group's window holds distinct values, not rows.
    """
    counts = values.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w)).join(counts.groupBy(by).agg(F.sum("c").alias("n")), by)
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value)))
    return run.groupBy(by).agg(*(at(q).alias(f"p{round(q * 100)}") for q in shares))


@query("histogram_stats", """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, list_sort(list(value))[floor(count(*) * 0.5)::INT + 1] AS p50,
list_sort(list(value))[floor(count(*) * 0.95)::INT + 1] AS p95, list_sort(list(value))[floor(count(*) * 0.99)::INT + 1] AS p99 FROM events GROUP BY event_type""")
def histogram_stats(spark, sf_dir):
    """Count, sum, mean, extremes and percentiles by index of each histogram."""
    events = table(spark, sf_dir, "events")
    plain = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return plain.join(percentiles(events, "event_type", "value", (0.5, 0.95, 0.99)), "event_type")


@query("sessions", typed("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM s GROUP BY ALL""", session="BIGINT"))
def sessions(spark, sf_dir):
    """Threads of a user: a gap of over four hours starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts")
    gap = F.col("ts") - F.lag("ts").over(w)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.when(gap <= F.expr("interval 4 hours"), 0).otherwise(1).alias("fresh"))
    rows = rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("daily_rollup", typed("SELECT ts::DATE AS day, count(*) AS n, sum((event_type = 'click')::INT) AS clicks, sum((event_type = 'view')::INT) AS views, sum((event_type NOT IN ('click', 'view'))::INT) AS other FROM events GROUP BY 1", clicks="BIGINT", views="BIGINT", other="BIGINT"))
def daily_rollup(spark, sf_dir):
    of = lambda c: F.sum(c.cast("int"))
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), of(kind == "click").alias("clicks"), of(kind == "view").alias("views"), of(~kind.isin("click", "view")).alias("other"))


@query("weekly_rollup", "SELECT isoyear(ts) AS year, weekofyear(ts) AS week, date_trunc('week', ts)::DATE AS monday, count(DISTINCT ts::DATE) AS days, count(*) AS n FROM events GROUP BY ALL")
def weekly_rollup(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").groupBy(F.expr("extract(YEAROFWEEK from ts)").alias("year"), F.weekofyear(ts).alias("week"), F.to_date(F.date_trunc("week", ts)).alias("monday")).agg(F.countDistinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"))


@query("monthly_rollup", "SELECT strftime(ts, '%Y-%m') AS month, count(DISTINCT weekofyear(ts)) AS weeks, count(*) AS n FROM events GROUP BY 1")
def monthly_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.countDistinct(F.weekofyear("ts")).alias("weeks"), F.count("*").alias("n"))


@query("recent_counts", typed(f"SELECT sum((ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY)::INT) AS day, sum((ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)::INT) AS week, sum((ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY)::INT) AS month FROM events", day="BIGINT", week="BIGINT", month="BIGINT"))
def recent_counts(spark, sf_dir):
    since = lambda days: F.sum((F.col("ts") >= F.expr(f"timestamp_ntz'{AS_OF}' - interval {days} days")).cast("int"))
    return table(spark, sf_dir, "events").agg(since(1).alias("day"), since(7).alias("week"), since(30).alias("month"))


@query("cost_stats", """WITH p(event_type, p_in, p_out) AS (VALUES ('view', 0.05, 0.08), ('click', 0.59, 0.79), ('purchase', 3.0, 15.0)), c AS (SELECT e.event_type, ts, event_id, coalesce(value * 1000 / 1e6 * p_in + value * 100 / 1e6 * p_out, 0.0) AS cost FROM events e LEFT JOIN p USING (event_type))
SELECT event_type, count(*) AS operations, round(sum(cost), 6) AS total, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' THEN cost ELSE 0 END), 6) AS today, arg_max(event_id, (round(cost, 9), event_id)) AS dearest FROM c GROUP BY event_type""")
def cost_stats(spark, sf_dir):
    """Costs by kind of operation from a table of prices; an unknown kind costs nothing."""
    prices = spark.createDataFrame([("view", 0.05, 0.08), ("click", 0.59, 0.79), ("purchase", 3.0, 15.0)], "event_type string, p_in double, p_out double")
    cost = F.coalesce(F.col("value") * 1000 / 1e6 * F.col("p_in") + F.col("value") * 100 / 1e6 * F.col("p_out"), F.lit(0.0))
    rows = table(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left").withColumn("cost", cost)  # three rows
    today = F.to_date("ts") == F.lit("2024-01-15").cast("date")
    return rows.groupBy("event_type").agg(F.count("*").alias("operations"), F.round(F.sum("cost"), 6).alias("total"), F.round(F.sum(F.when(today, F.col("cost")).otherwise(0.0)), 6).alias("today"), F.max_by("event_id", F.struct(F.round("cost", 9), "event_id")).alias("dearest"))


def snapshot(docs: DataFrame) -> DataFrame:
    """One row: documents, duplicates and their rate, means over positive scores, size."""
    hashed = docs.groupBy(text.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return hashed.agg(F.sum("n").alias("documents"), F.sum(F.col("n") - 1).alias("duplicates"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("duplicate_rate"), F.sum("chars").alias("chars"))


@query("drift_snapshot", typed("SELECT sum(n) AS documents, sum(n - 1) AS duplicates, round(sum(n - 1) / sum(n), 6) AS duplicate_rate, sum(chars) AS chars FROM (SELECT count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY sha256(text))", documents="BIGINT", duplicates="BIGINT", chars="BIGINT"))
def drift_snapshot(spark, sf_dir):
    return snapshot(table(spark, sf_dir, "documents"))


def alerts(now: DataFrame, base: DataFrame) -> DataFrame:
    """(rule, fired) of two one-row snapshots with signal, quality, duplicate_rate, ingested and topics."""
    one = now.select(*(F.col(c).alias(f"n_{c}") for c in now.columns)).crossJoin(base.select(*(F.col(c).alias(f"b_{c}") for c in base.columns)))
    change = lambda c: (F.col(f"n_{c}") - F.col(f"b_{c}")) / F.col(f"b_{c}")
    fresh = F.size(F.array_except("n_topics", "b_topics"))
    rules = {
        "signal": F.abs(change("signal")) > SIGNAL_DROP, "quality": F.abs(change("quality")) > QUALITY_DROP, "duplicates": F.col("n_duplicate_rate") - F.col("b_duplicate_rate") > DUPLICATE_RISE,
        "ingestion": F.col("n_ingested") > INGEST_SPIKE * F.col("b_ingested"), "topics": fresh > TOPIC_SHIFT * F.size("b_topics"),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("fired")) for k, v in rules.items()))).alias("x")).select("x.*")


@query("drift_alerts", """WITH s AS (SELECT source IN ('src1', 'src2') AS now, count(*) AS ingested, avg(n_chars) / 10000 AS signal, avg(least(n_chars, 2000)) / 2000 AS quality, 1 - count(DISTINCT sha256(text)) / count(*) AS dup, list(DISTINCT lang) AS topics FROM documents WHERE source IN ('src1', 'src2', 'src3', 'src4') GROUP BY 1),
n AS (SELECT * FROM s WHERE now), b AS (SELECT * FROM s WHERE NOT now)
SELECT unnest(['signal', 'quality', 'duplicates', 'ingestion', 'topics']) AS rule, unnest([abs(n.signal / b.signal - 1) > 0.15, abs(n.quality / b.quality - 1) > 0.15, n.dup - b.dup > 0.1, n.ingested > 3 * b.ingested, len(list_filter(n.topics, lambda x: NOT list_contains(b.topics, x))) > 0.25 * len(b.topics)]) AS fired FROM n, b""")
def drift_alerts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    of = lambda names: docs.where(F.col("source").isin(*names)).agg(F.count("*").alias("ingested"), (F.avg("n_chars") / 10000).alias("signal"), (F.avg(F.least("n_chars", F.lit(2000))) / 2000).alias("quality"), (1 - F.countDistinct(text.content_hash(F.col("text"))) / F.count("*")).alias("duplicate_rate"), F.collect_set("lang").alias("topics"))
    return alerts(of(("src1", "src2")), of(("src3", "src4")))


@query("baseline_snapshot", "WITH s AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT coalesce(max(CASE WHEN day <= DATE '2024-01-24' THEN day END), min(day)) AS day, coalesce(arg_max(n, day) FILTER (day <= DATE '2024-01-24'), arg_min(n, day)) AS n FROM s")
def baseline_snapshot(spark, sf_dir):
    """As of a day: the newest snapshot up to then, else the oldest."""
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = F.when(F.col("day") <= F.lit("2024-01-24").cast("date"), F.col("day"))
    return days.agg(F.coalesce(F.max(before), F.min("day")).alias("day"), F.coalesce(F.max_by("n", before), F.min_by("n", "day")).alias("n"))


@query("health_rollup", "WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id) SELECT max(CASE last WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END) AS severity, count(*) AS components FROM s")
def health_rollup(spark, sf_dir):
    """The worst of the components' last states."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.agg(F.max(F.when(F.col("last") == "error", 2).when(F.col("last") == "purchase", 1).otherwise(0)).alias("severity"), F.count("*").alias("components"))


@query("tag_frequency", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 10")
def tag_frequency(spark, sf_dir):
    """The ten commonest pairs of tags."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(10)


@query("tag_cooccurrence", """WITH t AS (SELECT DISTINCT user_id, event_type AS tag FROM events) SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM t a JOIN t b USING (user_id) WHERE a.tag <> b.tag GROUP BY ALL""")
def tag_cooccurrence(spark, sf_dir):
    """How often two tags meet, in both directions; pairs are made within a row's few distinct tags."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    pairs = rows.select("tags", F.explode("tags").alias("tag_a")).select("tag_a", F.explode("tags").alias("tag_b"))
    return pairs.where("tag_a <> tag_b").groupBy("tag_a", "tag_b").agg(F.count("*").alias("n"))


@query("suggestions", "SELECT user_id, count(*) AS n, count(*) >= 5 AS promoted FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) >= 3")
def suggestions(spark, sf_dir):
    """Suggestions that came three times, and whether they are promoted (five)."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 3").withColumn("promoted", F.col("n") >= 5)


@query("cache_stats", typed("SELECT count(*) AS requests, sum((event_type <> 'error')::INT) AS hits, round(avg((event_type <> 'error')::INT), 6) AS hit_rate FROM events", hits="BIGINT"))
def cache_stats(spark, sf_dir):
    hit = (F.col("event_type") != "error").cast("int")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("requests"), F.sum(hit).alias("hits"), F.round(F.avg(hit), 6).alias("hit_rate"))


@query("pagination", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def pagination(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(40).limit(20)


@query("queue_head", "SELECT event_id, value FROM events WHERE event_type = 'view' AND value < 50 ORDER BY value, event_id LIMIT 25")
def queue_head(spark, sf_dir):
    """The work queue's next items, least confident first."""
    return table(spark, sf_dir, "events").where("event_type = 'view' and value < 50").select("event_id", "value").orderBy("value", "event_id").limit(25)


@query("queue_stats", "SELECT event_type AS status, count(*) AS n, round(avg(CASE WHEN value > 50 THEN value END), 6) AS improvement, round(avg((value > 50)::INT), 6) AS success FROM events GROUP BY 1")
def queue_stats(spark, sf_dir):
    high = F.col("value") > 50
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(high, F.col("value"))), 6).alias("improvement"), F.round(F.avg(high.cast("int")), 6).alias("success"))


@query("queue_states", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, least(count(*) FILTER (event_type = 'error'), 3) AS attempts FROM events GROUP BY user_id")
def queue_states(spark, sf_dir):
    """Each item's last state and its attempts, at most three."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.least(F.count_if(F.col("event_type") == "error"), F.lit(3)).alias("attempts"))


@query("metric_keys", "SELECT event_type || '|k=' || json_extract_string(props, '$.k') AS key, count(*) AS n FROM events GROUP BY 1")
def metric_keys(spark, sf_dir):
    """Metrics by name and sorted labels."""
    labels = F.array_join(F.array_sort(F.transform(F.map_entries(F.from_json("props", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return table(spark, sf_dir, "events").groupBy(F.concat("event_type", F.lit("|"), labels).alias("key")).agg(F.count("*").alias("n"))


@query("uptime", "SELECT round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds FROM events")
def uptime(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return table(spark, sf_dir, "events").agg(F.round((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6, 3).alias("seconds"))
