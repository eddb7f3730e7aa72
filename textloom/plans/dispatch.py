"""Each document through the branch of its kind: a registry of columns, split once and joined once by one ``when``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import chats, cleanup, rules
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, table

Change = Callable[[Column], Column]


@dataclass(frozen=True)
class Handler:
    """What a kind of document gets: its text changed, and fields of the original text as a struct. A change that keeps less than ``least`` of a text is taken back."""

    name: str
    change: Change
    fields: Change | None = None
    least: float = 0.0


class Registry:
    """Handlers by kind. Documents of other kinds stay as they are."""

    def __init__(self, handlers: dict[str, Handler] | None = None):
        self.handlers = dict(handlers or {})

    def register(self, kind: str, handler: Handler) -> Registry:
        self.handlers[kind] = handler
        return self

    def __call__(self, docs: DataFrame, kind: str = "kind", body: str = "text") -> DataFrame:
        """``docs`` with the changed text, handler_applied (null if none), original_length, retained (the share kept) and details (the fields as JSON).

        All branches are columns of one pass: a row is read once, and only its own branch is computed. A null kind or text
        has no handler.
        """
        own = F.when(F.lit(False), F.lit(None).cast("string"))
        name, details = own, own
        for k, h in self.handlers.items():
            mine = (F.col(kind) == k) & F.col(body).isNotNull()
            changed = h.change(F.when(mine, F.col(body)))  # others' texts don't reach a Python function
            own = own.when(mine, F.when(rules.kept_enough(F.col(body), changed, h.least), changed).otherwise(F.col(body)) if h.least else changed)
            name = name.when(mine, F.lit(h.name))
            if h.fields:
                details = details.when(mine, F.to_json(h.fields(F.col(body))))
        out = docs.withColumns({"_changed": F.coalesce(own, F.col(body)), "handler_applied": name, "original_length": F.length(body), "details": details})
        return out.withColumn(body, F.col("_changed")).withColumn("retained", F.round(F.length(body) / F.nullif(F.col("original_length"), F.lit(0)), 6)).drop("_changed")


def default_registry() -> Registry:
    """Mails, chats, invoices and manuals by the library's own rules."""
    return Registry({
        "email": Handler("email", rules.mail_body, least=0.3),
        "llm_chat": Handler("chat_log", cleanup.as_column(cleanup.chat_clean), lambda c: chats.chat_fields(c)),
        "invoice": Handler("invoice", rules.invoice_body, rules.invoice),
        "manual": Handler("manual", cleanup.as_column(cleanup.manual_clean), rules.manual),
    })


_KIND = Varied(("email", "report", "note", "email", "image"), 3)
_TEXT = Joined((Varied(("Hello,\n> quoted\n", "", "On Monday Ann wrote:\n> old\nmine  \n", "\n"), 5), "text", Varied(("\n\n\n\nend  \nline", "\n--\nAnn", "\nKind regards,\nBo", " \n\n\n"), 7)))
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12)"


@query("handled_documents", f"""WITH d AS (SELECT doc_id, {_KIND.sql} AS kind, {_TEXT.sql} AS b FROM documents), m AS (SELECT *, trim({rules._MAIL_CLEAN}, {_BLANKS}) AS mail,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(b, chr(0), ''), '(?m)[ \\t]+$', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '\\s+$', '') AS tidy FROM d),
x AS (SELECT *, CASE WHEN kind = 'email' AND length(mail) >= 0.3 * length(b) THEN mail WHEN kind = 'note' THEN tidy ELSE b END AS out FROM m)
SELECT doc_id, kind, sha256(out) AS body, CASE WHEN kind = 'email' THEN 'email' WHEN kind = 'note' THEN 'tidy' END AS handler_applied, length(b)::INT AS original_length, round(length(out)::DOUBLE / length(b), 6) AS retained FROM x""")
def handled_documents(spark, sf_dir):
    """All texts as documents of several kinds, each through its kind's handler."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _KIND.column.alias("kind"), _TEXT.column.alias("text"))
    handlers = Registry({"email": Handler("email", rules.mail_body, least=0.3)}).register("note", Handler("tidy", chats.tidy))
    return handlers(docs).select("doc_id", "kind", F.sha2(F.col("text").cast("binary"), 256).alias("body"), "handler_applied", "original_length", "retained")
