"""Checks of records: names that are software, required fields, vocabularies, corpus views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.registry import query, table

#: Parts of names that are software's, and marks of products and versions.
SOFTWARE = (
    "code", "studio", "visual", "machine", "virtual", "notebook", "calendar", "install", "native", "browser", "app", "application", "software", "tool", "platform", "system", "service", "program", "docker", "python", "java", "linux",
    "windows", "mac", "ios", "android", "chrome", "firefox", "safari", "edge", "server", "database", "api", "sdk", "ide", "email", "chat", "messenger", "storage", "drive", "cloud", "backup", "sync", "dropbox", "google", "microsoft",
    "apple", "amazon", "meta", "facebook", "twitter", "instagram", "whatsapp", "telegram", "slack", "zoom", "teams", "meet", "skype", "discord",
)
PRODUCT = ("v1", "v2", "v3", "2.0", "3.0", "pro", "plus", "premium", "enterprise")


def software_name(c: Column, strict: bool = False) -> Column:
    """Whether a name holds a part of a software's or product's name; ``strict`` asks for whole words."""
    words = [w.replace(".", r"\.") for w in (*SOFTWARE, *PRODUCT)]
    return F.lower(c).rlike("|".join(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])" if strict else w for w in words))


_PARTS = "|".join(w.replace(".", "\\.") for w in (*SOFTWARE, *PRODUCT))


@query("software_names", f"SELECT doc_id, regexp_matches(lower(text), '{_PARTS}') AS software FROM documents")
def software_names(spark, sf_dir):
    """Texts that hold a part of such a name."""
    return table(spark, sf_dir, "documents").select("doc_id", software_name(F.col("text")).alias("software"))


def record_errors(record: Column, kind: str, required: tuple[str, ...]) -> Column:
    """What is wrong with a JSON record: array<string>, empty if nothing."""
    parsed = F.from_json(record, f"{kind}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    missing = [F.when(parsed[k].isNull(), F.lit(f"{k} is missing")) for k in required]
    return F.array_compact(F.array(F.when(record.isNull() | parsed["_bad"].isNotNull(), F.lit("no valid JSON")), *missing))


@query("record_validation", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ['value is missing'] WHEN event_id % 3 = 1 THEN [] ELSE ['no valid JSON', 'event_type is missing', 'value is missing'] END AS errors FROM events")
def record_validation(spark, sf_dir):
    good = F.to_json(F.struct("event_type", "value"))
    record = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct("event_type"))).when(F.col("event_id") % 3 == 1, good).otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", record_errors(record, "event_type string, value double", ("event_type", "value")).alias("errors"))


@query("vocabulary_stats", "SELECT lang AS category, count(DISTINCT source) AS terms, count(*) AS uses FROM documents GROUP BY lang")
def vocabulary_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("category")).agg(F.countDistinct("source").alias("terms"), F.count("*").alias("uses"))


def entity_kind(label: Column, concepts: DataFrame | None = None) -> Column:
    """Software, company or place by a label's end."""
    low = F.lower(label)
    return F.when(low.rlike(r"\.(js|py|app)$|os$| ide$| editor$"), "Software").when(low.rlike(r" (inc|ltd|gmbh|ag|corp)\.?$"), "Company").when(low.rlike(r"(stadt|burg|ville)$"), "Place")


@query("entity_kinds", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Software' WHEN 1 THEN 'Company' WHEN 2 THEN 'Place' END AS kind FROM documents")
def entity_kinds(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, ("main.py", "Weber GmbH", "Neustadt", "Weber"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", entity_kind(label).alias("kind"))


@query("ordered_distinct", "SELECT doc_id, [lang, source] AS topics FROM documents")
def ordered_distinct(spark, sf_dir):
    """Topics without repeats and blanks, in order."""
    return table(spark, sf_dir, "documents").select("doc_id", F.filter(F.array_distinct(F.array("lang", F.lit(""), "source", "lang")), lambda x: x != "").alias("topics"))


@query("slugs", "SELECT doc_id, 'zu-' || lower(source) || '-uber-cafe' AS slug FROM documents")
def slugs(spark, sf_dir):
    """Names for files: accents folded, dashes between words, forty characters at most."""
    name = F.concat(F.lit("Zu "), "source", F.lit(" / Über: Café!"))
    folded = F.translate(F.lower(name), "äöüßáéíóúàèçñ", "aousaeiouaecn")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40).alias("slug"))


@query("file_names", "SELECT event_id, strftime(ts, '%Y%m%d') || '_' || event_type || '_' || substr(sha256(event_id::VARCHAR), 1, 4) || '.md' AS name FROM events")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyyMMdd"), F.lit("_"), "event_type", F.lit("_"), F.substring(F.sha2(F.col("event_id").cast("string").cast("binary"), 256), 1, 4), F.lit(".md")).alias("name"))
