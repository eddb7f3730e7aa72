"""Readers of chat exports, e-mail, tables and folders of files."""

from __future__ import annotations

import datetime
import email
import email.policy
import email.utils

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.registry import query, table, typed

#: Fixed patterns of chat lines and how their times read; the first that a text has anywhere is used for all of it.
CHAT_LINES = (
    (r"(\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}(?::\d{2})?\s?(?:[AP]M)?) - ([^:]+): (.*)", ("M/d/yy, h:mm a", "M/d/yy, H:mm")),
    (r"(\d{1,2}\.\d{1,2}\.\d{2,4}, \d{1,2}:\d{2}(?::\d{2})?) - ([^:]+): (.*)", ("d.M.yy, H:mm",)),
    (r"(\d{4}-\d{2}-\d{2} \d{1,2}:\d{2}(?::\d{2})?) - ([^:]+): (.*)", ("yyyy-MM-dd H:mm",)),
    (r"\[(\d{1,2}/\d{1,2}/\d{2,4}, \d{1,2}:\d{2}(?::\d{2})?\s?(?:[AP]M)?)\] ([^:]+): (.*)", ("M/d/yy, h:mm a", "M/d/yy, H:mm")),
)
MAIL = "message_id string, subject string, sender string, recipients array<string>, sent timestamp_ntz, in_reply_to string, references array<string>, body string, attachments array<string>"

_MAIL_ARROW = pa.schema(
    [(k, pa.string()) for k in ("path", "message_id", "subject", "sender")] + [("recipients", pa.list_(pa.string())), ("sent", pa.timestamp("us")), ("in_reply_to", pa.string()), ("references", pa.list_(pa.string())), ("body", pa.string()), ("attachments", pa.list_(pa.string()))]
)


def is_chat(c: Column) -> Column:
    out = F.lit(False)
    for pattern, _ in CHAT_LINES:
        out = out | c.rlike(pattern)
    return out


def chat_messages(docs: DataFrame, doc_id: str = "doc_id", body: str = "text") -> DataFrame:
    """(doc_id, position, sent, sender, message): one row for each line of a chat export."""
    which = F.lit(None).cast("int")
    for k in range(len(CHAT_LINES) - 1, -1, -1):
        which = F.when(F.col(body).rlike(CHAT_LINES[k][0]), k).otherwise(which)
    lines = docs.select(F.col(doc_id).alias("doc_id"), which.alias("which"), F.posexplode(F.split(body, "\n")).alias("position", "line")).where("which is not null")
    part = lambda g: F.coalesce(*(F.when((F.col("which") == k) & F.col("line").rlike(p), F.regexp_extract("line", p, g)) for k, (p, _) in enumerate(CHAT_LINES)))
    out = lines.select("doc_id", "position", "which", part(1).alias("at"), part(2).alias("sender"), part(3).alias("message")).where("at is not null")
    sent = F.coalesce(*(F.when(F.col("which") == k, F.try_to_timestamp("at", F.lit(f))) for k, (_, forms) in enumerate(CHAT_LINES) for f in forms))
    return out.select("doc_id", "position", sent.cast("timestamp_ntz").alias("sent"), "sender", "message")


def table_rows(c: Column) -> Column:
    """Cells of a table's text: by tabs, else bars, else two blanks; empty rows are dropped."""
    cells = lambda r: F.transform(F.when(r.contains("\t"), F.split(r, "\t")).when(r.contains("|"), F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|")).otherwise(F.split(r, r" {2,}")), lambda x: F.trim(x))
    return F.filter(F.transform(F.split(c, "\n"), lambda r: cells(F.trim(r))), lambda r: F.exists(r, lambda x: x != ""))


def llm_export(c: Column) -> Column:
    """The kind of an assistant's export, or null."""
    marks = lambda who: F.size(F.regexp_extract_all(c, F.lit(rf"(?im)^\s*\**({who})\**:"), F.lit(1)))
    has = lambda key: F.get_json_object(c, f"$.{key}").isNotNull()
    return F.when(has("mapping") | has("conversations"), "chatgpt").when(has("chat_messages"), "claude").when((marks("user|human|you") >= 2) & (marks("assistant|ai|chatgpt|claude") >= 2), "markdown")


def chatgpt_messages(c: Column) -> Column:
    """Messages (at, role, text) of a JSON export with a mapping of nodes, in order of time; blank ones are dropped."""
    kind = "title string, mapping map<string, struct<message: struct<author: struct<role: string>, create_time: double, content: struct<parts: array<string>>>>>"
    nodes = F.map_values(F.from_json(c, kind)["mapping"])
    rows = F.transform(nodes, lambda n: F.struct(n["message"]["create_time"].alias("at"), n["message"]["author"]["role"].alias("role"), F.array_join(n["message"]["content"]["parts"], "\n").alias("text")))
    return F.array_sort(F.filter(rows, lambda r: F.trim(r["text"]) != ""))


def claude_messages(c: Column) -> Column:
    rows = F.from_json(c, "chat_messages array<struct<text: string, sender: string, created_at: string>>")["chat_messages"]
    return F.array_sort(F.transform(rows, lambda r: F.struct(r["created_at"].alias("at"), F.when(r["sender"] == "assistant", "assistant").otherwise("user").alias("role"), r["text"].alias("text"))))


def _message(raw: bytes | None) -> dict | None:
    if raw is None:
        return None
    m = email.message_from_bytes(raw, policy=email.policy.default)
    flat = lambda k: " ".join(str(m[k]).split()) if m[k] else None
    try:
        sent = email.utils.parsedate_to_datetime(m["date"]) if m["date"] else None
    except (TypeError, ValueError):
        sent = None
    body = "\n".join(p.get_content() for p in m.walk() if p.get_content_type() == "text/plain" and not p.get_filename())
    if not body.strip():
        body = "\n".join(p.get_content() for p in m.walk() if p.get_content_type() == "text/html" and not p.get_filename())
    return {
        "message_id": flat("message-id"), "subject": flat("subject"), "sender": flat("from"), "recipients": [a for _, a in email.utils.getaddresses([str(m[k]) for k in ("to", "cc") if m[k]])],
        "sent": sent.astimezone(datetime.timezone.utc).replace(tzinfo=None) if sent and sent.tzinfo else sent, "in_reply_to": flat("in-reply-to"), "references": (flat("references") or "").split(), "body": body,
        "attachments": [p.get_filename() for p in m.walk() if p.get_filename()],
    }


def messages(files: DataFrame, content: str = "content") -> DataFrame:
    """E-mail files (path, content) with their parsed fields."""

    def parse(batches):
        for b in batches:
            rows = [{"path": p, **(_message(raw) or {})} for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, _MAIL_ARROW)

    parsed = files.select("path", F.col(content).alias("content")).mapInArrow(parse, f"path string, {MAIL}")
    return parsed.withColumn("thread_id", text.thread_id(F.coalesce("subject", F.lit(""))))


def read_folder(spark, path: str, pattern: str = "*") -> DataFrame:
    """All files below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def threads(mail: DataFrame) -> DataFrame:
    """Messages grouped by normal subject: id, participants, first and last date, number."""
    who = F.array_distinct(F.flatten(F.array(F.collect_set("sender"), F.flatten(F.collect_list("recipients")))))
    ident = F.substring_index(F.regexp_replace(F.min_by("message_id", F.struct("sent", "message_id")), "[<>]", ""), "@", 1)
    return mail.groupBy(text.normal_subject(F.coalesce("subject", F.lit(""))).alias("subject")).agg(ident.alias("thread"), F.array_sort(who).alias("participants"), F.min("sent").alias("started"), F.max("sent").alias("ended"), F.count("*").alias("messages"))


_EXPORT = "SELECT conv_id AS doc_id, string_agg('2024-01-' || lpad((turn % 28 + 1)::VARCHAR, 2, '0') || ' 10:' || lpad((conv_id % 60)::VARCHAR, 2, '0') || ' - ' || role || ': ' || replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id"


def _exports(spark, sf_dir):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    line = F.concat(F.lit("2024-01-"), two(F.col("turn") % 28 + 1), F.lit(" 10:"), two(F.col("conv_id") % 60), F.lit(" - "), "role", F.lit(": "), F.regexp_replace("text", "\n", " "))
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("m"))
    return rows.select("doc_id", F.array_join(F.transform("m", lambda x: x["line"]), "\n").alias("text"))


@query("chat_export", f"WITH e AS ({_EXPORT}), l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM e) SELECT doc_id, strptime(regexp_extract(line, '^([-0-9 :]+) - ', 1), '%Y-%m-%d %H:%M') AS sent, regexp_extract(line, ' - ([^:]+): ', 1) AS sender, regexp_extract(line, ' - [^:]+: (.*)$', 1) AS message FROM l")
def chat_export(spark, sf_dir):
    """A messenger's export, read back line by line."""
    return chat_messages(_exports(spark, sf_dir)).select("doc_id", "sent", "sender", "message")


@query("table_parse", "SELECT doc_id, [doc_id::VARCHAR, source, lang] AS first_row, 2 AS n_rows FROM documents")
def table_parse(spark, sf_dir):
    cells = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "source", F.lit("\t "), "lang", F.lit("\n\n| a | b |\n"))
    rows = table_rows(cells)
    return table(spark, sf_dir, "documents").select("doc_id", F.get(rows, F.lit(0)).alias("first_row"), F.size(rows).alias("n_rows"))


@query("export_detection", "SELECT conv_id, CASE WHEN sum((role = 'user')::INT) >= 2 AND sum((role = 'assistant')::INT) >= 2 THEN 'markdown' END AS kind FROM conversations GROUP BY conv_id")
def export_detection(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.regexp_replace("text", r"(?m)^", " - ")).alias("line")))).alias("m"))
    return rows.select("conv_id", llm_export(F.array_join(F.transform("m", lambda x: x["line"]), "\n")).alias("kind"))


@query("json_export", typed("SELECT conv_id, count(*) AS n, sum((role = 'assistant')::INT) AS answers, sum(length(text)) AS chars FROM conversations GROUP BY conv_id", answers="BIGINT", chars="BIGINT"))
def json_export(spark, sf_dir):
    """Conversations written as a JSON export and parsed again."""
    m = F.struct(F.col("text"), F.when(F.col("role") == "assistant", "assistant").otherwise("human").alias("sender"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(m).alias("chat_messages"))).alias("j"))
    return rows.select("conv_id", F.explode(claude_messages(F.col("j"))).alias("m")).groupBy("conv_id").agg(F.count("*").alias("n"), F.sum((F.col("m.role") == "assistant").cast("int")).alias("answers"), F.sum(F.length("m.text")).alias("chars"))
