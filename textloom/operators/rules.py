"""Ordered rules over texts: titles, types, fields of invoices and manuals, mail bodies, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text
from textloom.operators.varied import Joined, Varied
from textloom.registry import query, table, typed


def _found(body: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's first match; null without one."""
    return F.when(body.rlike(pattern), F.regexp_extract(body, pattern, group))


def _sql_found(body: str, pattern: str, group: int = 1) -> str:
    p = pattern.replace("'", "''")
    return f"CASE WHEN regexp_matches({body}, '{p}') THEN regexp_extract({body}, '{p}', {group}) END"


def _all(body: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(body, F.lit(pattern), F.lit(group))


def _sql_all(body: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({body}, '{pattern}', {group})"


# The patterns of an invoice's amounts, dates, number, terms, vendor, items and tax, and currencies, in order.
AMOUNTS = (r"(?i)(?:EUR|€|CHF)\s*(\d{1,3}(?:\.\d{3})*,\d{2})", r"(?i)(?:USD|\$|GBP|£)\s*(\d{1,3}(?:,\d{3})*\.\d{2})", r"(?i)(\d{1,3}(?:[.,]\d{3})*[.,]\d{2})\s*(?:EUR|€|USD|\$|CHF|GBP|£)")
INVOICE_DATES = (r"\b(\d{2}[./]\d{2}[./]\d{4})\b", r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[A-Za-z0-9_]*\s+\d{4})\b")
INVOICE_NUMBERS = (r"(?i)(?:Invoice|Rechnung|Facture)\s*(?:No\.|Nr\.|#|Number)?:?\s*([A-Z0-9\-]+)", r"(?i)(?:Receipt|Quittung|Beleg)\s*(?:No\.|Nr\.|#)?:?\s*([A-Z0-9\-]+)")
TERMS = (r"(?i)(?:due|fällig|payable)\s+(?:on|am|by|bis)?\s*(\d{1,2}[./]\d{1,2}[./]\d{4})", r"(?i)(?:payment|zahlung).*?(\d+)\s*(?:days|tage|jours)", r"(?i)(?:net|netto)\s*(\d+)")
VENDORS = (r"(?m)(?:From|Von|De):?\s*([A-Z][A-Za-z\s&\.]+(?:GmbH|LLC|Ltd|Inc|AG|SA)?)", r"(?m)^([A-Z][A-Za-z\s&\.]+(?:GmbH|LLC|Ltd|Inc|AG|SA))")
ITEM = r".+\s+\d+[.,]\d{2}"
#: The same matches: none can begin within a line but where one has ended, since what matches from there matches from the line's start; no other start is tried.
_ITEM_STARTS = r"(?m)(?:^|\G)" + ITEM
TAXES = (r"(?i)(?:VAT|MwSt|Tax|Steuer).*?(\d+[.,]\d{2})", r"(?i)(\d+)%\s*(?:VAT|MwSt)")
CURRENCIES = (("EUR", "EUR|€"), ("USD", r"USD|\$"), ("GBP", "GBP|£"), ("CHF", "CHF"))


def invoice(body: Column) -> Column:
    """struct of total, currency, number, invoice_date, due_date, terms, vendor, items, tax.

    Amounts are read with a comma for the cents, points dropped, so that the cents of one with a point count as whole units;
    the total is the largest. A currency needs an amount. A date is due if there are two or more: first and last in order of patterns.
    """
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"\.", ""), ",", ".").try_cast("double")
    amounts = F.array_compact(F.transform(F.concat(*(_all(body, p, 1) for p in AMOUNTS)), plain))
    when = F.concat(*(_all(body, p, 1) for p in INVOICE_DATES))
    vendor = [F.btrim(_found(body, p), F.lit(" \t\n\r\f")) for p in VENDORS]
    currency = reduce(lambda c, kv: F.when(body.rlike(kv[1]), kv[0]).otherwise(c), reversed(CURRENCIES), F.lit("UNKNOWN"))
    return F.struct(
        F.array_max(amounts).alias("total"), F.when(F.size(amounts) > 0, currency).alias("currency"), F.coalesce(*(_found(body, p) for p in INVOICE_NUMBERS)).alias("number"), F.get(when, F.lit(0)).alias("invoice_date"),
        F.when(F.size(when) > 1, F.element_at(when, -1)).alias("due_date"), F.coalesce(*(_found(body, p, 0) for p in TERMS)).alias("terms"), F.coalesce(*(F.when(F.length(v).between(4, 99), v) for v in vendor)).alias("vendor"),
        F.size(_all(body, _ITEM_STARTS)).alias("items"), F.coalesce(*(_found(body, p, 0) for p in TAXES)).alias("tax"),
    )


_BILL = (
    Varied(("Acme Tools GmbH\n", "From: Blue Sea Ltd\n", "Von Bert\n", "x\n", "De: A\nBay Inc\n"), 3), Varied(("Invoice No. A-", "Rechnung Nr. ", "Facture: ", "Receipt #", "note "), 5), "doc_id",
    Varied(("\nBolt  12,50\nNut  3.75\n", "\nnothing\n", "\nLabel 7,00\n"), 7), Varied(("Total EUR 1.234,56", "Total $1,234.50 USD 2.00", "Sum 99,90 CHF", "£500.25 and 7,5", "no sum", "€ 12,00 12.345,67 EUR"), 11),
    Varied((" on 01.02.2024, 2024-03-04", "", " dated 5 March 2024", " 12/11/2023"), 13), Varied((" payable by 31.12.2024", " payment within 30 days", " net 60", "", " fällig am 1.5.2024"), 17), Varied((" VAT 19,00", " 7% MwSt", "", " Tax: 3 of 4.50"), 19), Varied(("\n",), 23), "text",
)
_BILL_TEXT = Joined(_BILL)
_PLAIN_AMOUNTS = "list_filter(list_transform(list_concat(" + ", ".join(_sql_all("b", p, 1) for p in AMOUNTS) + "), lambda x: TRY_CAST(replace(replace(x, '.', ''), ',', '.') AS DOUBLE)), lambda x: x IS NOT NULL)"


def _coalesced(body: str, patterns: tuple[str, ...], group: int) -> str:
    return "coalesce(" + ", ".join(_sql_found(body, p, group) for p in patterns) + ")"


@query("invoice_fields", f"""WITH d AS (SELECT doc_id, {_BILL_TEXT.sql} AS b FROM documents), x AS (SELECT *, {_PLAIN_AMOUNTS} AS a, list_concat({", ".join(_sql_all("b", p, 1) for p in INVOICE_DATES)}) AS w, {", ".join(f"trim({_sql_found('b', p)}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS v{k}" for k, p in enumerate(VENDORS))} FROM d)
SELECT doc_id, list_max(a) AS total, CASE WHEN len(a) > 0 THEN CASE {" ".join(f"WHEN regexp_matches(b, '{p}') THEN '{c}'" for c, p in CURRENCIES)} ELSE 'UNKNOWN' END END AS currency, {_coalesced("b", INVOICE_NUMBERS, 1)} AS number, w[1] AS invoice_date, CASE WHEN len(w) > 1 THEN w[-1] END AS due_date,
{_coalesced("b", TERMS, 0)} AS terms, CASE WHEN length(v0) BETWEEN 4 AND 99 THEN v0 WHEN length(v1) BETWEEN 4 AND 99 THEN v1 END AS vendor, len({_sql_all("b", ITEM)})::INT AS items, {_coalesced("b", TAXES, 0)} AS tax FROM x""")
def invoice_fields(spark, sf_dir):
    """The fields of invoices, in heads of many forms before the texts."""
    return table(spark, sf_dir, "documents").select("doc_id", _BILL_TEXT.column.alias("b")).select("doc_id", invoice(F.col("b")).alias("x")).select("doc_id", "x.*")


# The patterns of a manual's version, headings and steps, and the words of its level.
VERSIONS = (r"(?m)[Vv]ersion\s*:?\s*(\d+\.\d+(?:\.\d+)?)", r"(?m)[Rr]elease\s*:?\s*(\d+\.\d+(?:\.\d+)?)", r"(?m)[Dd]ate\s*:?\s*(\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})")
HEADINGS = (r"(?m)^#{1,6}\s+.+$", r"(?m)^[A-Z][A-Za-z\s]+\n[=\-]+$", r"(?m)^\d+\.\s+[A-Z].+$", r"(?m)^\d+\.\d+\s+.+$")
STEPS = (r"(?m)(?:Step|Schritt)\s+\d+:", r"(?m)^\d+\)\s+", r"(?m)^\d+\.\s+(?:[A-Z]|To\s)")
FENCED, FENCE_NAME = r"```[\s\S]*?```", r"^```([A-Za-z0-9_]+)"
BEGINNER, ADVANCED = ("introduction", "getting started", "basics", "tutorial", "beginner"), ("architecture", "internals", "optimization", "advanced", "performance")
FIRST_HEADING, NO_PRODUCT = r"(?m)^#{1,2}\s+(.+)$", r"(?i)^(?:User\s+)?(?:Manual|Guide|Documentation|Reference)\s*:?\s*"
CROSS_REFERENCE = r"(?i)(?:see|refer to|described in)\s+(?:section|chapter)\s+\d+"


def manual(body: Column) -> Column:
    """struct of version, document_date, sections, steps, code_blocks, languages, level, product, cross_references.

    Without a version or release a date stands for the version; with one it is the document's. Versions are looked for in the
    first 2,000 characters, level words in the first 5,000, as the rule has it.
    """
    head, low = F.substring(body, 1, 2000), F.lower(F.substring(body, 1, 5000))
    named, date = F.coalesce(_found(head, VERSIONS[0]), _found(head, VERSIONS[1])), _found(head, VERSIONS[2])
    count = lambda patterns: reduce(lambda a, b: a + b, (F.size(_all(body, p)) for p in patterns))
    score = lambda words: reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words))
    blocks = _all(body, FENCED)
    product = F.regexp_replace(F.btrim(_found(body, FIRST_HEADING), F.lit(" \t\r\f")), NO_PRODUCT, "")
    return F.struct(
        F.coalesce(named, date).alias("version"), F.when(named.isNotNull(), date).alias("document_date"), count(HEADINGS).alias("sections"), count(STEPS).alias("steps"), F.size(blocks).alias("code_blocks"),
        F.array_sort(F.array_distinct(F.filter(F.transform(blocks, lambda x: F.regexp_extract(x, FENCE_NAME, 1)), lambda x: x != ""))).alias("languages"),
        F.when(score(BEGINNER) > score(ADVANCED), "beginner").when(score(ADVANCED) > score(BEGINNER), "advanced").otherwise("intermediate").alias("level"),
        F.when(F.length(product).between(4, 99), product).alias("product"), F.size(_all(body, CROSS_REFERENCE)).alias("cross_references"),
    )


_MANUAL = (
    Varied(("# User Guide: Pump X", "# Manual\n", "Setup Notes\n====", "## Engine", "plain"), 3), Varied(("\nVersion: 1.", "\nRelease 2.", "\nDate: 2024-01-1", "\nno "), 5), Varied(("0", "3.7", "5"), 7), Varied(("\n1. Open it\n2. To close\n", "\nStep 1: go\nSchritt 2: halt\n", "\n1) one\n", "\n"), 11),
    Varied(("```python\nx\n```\n```\ny\n```\n", "", "```sh\nz\n```\n"), 13), Varied(("Introduction for the beginner\n", "Internals and performance\n", "A tutorial on architecture\n", "\n"), 17), Varied(("see section 4, refer to chapter 2", "", "Date: 01.02.2023 described in section 12"), 19), Varied(("\n",), 23), "text",
)
_MANUAL_TEXT = Joined(_MANUAL)
_SUM = lambda patterns: " + ".join(f"len({_sql_all('b', p)})" for p in patterns)
_LEVEL = lambda words: " + ".join(f"contains(low, '{w}')::INT" for w in words)


@query("manual_fields", f"""WITH d AS (SELECT doc_id, {_MANUAL_TEXT.sql} AS b FROM documents), h AS (SELECT *, substr(b, 1, 2000) AS head, lower(substr(b, 1, 5000)) AS low, {_sql_all("b", FENCED)} AS blocks FROM d),
x AS (SELECT *, coalesce({_sql_found("head", VERSIONS[0])}, {_sql_found("head", VERSIONS[1])}) AS named, {_sql_found("head", VERSIONS[2])} AS dated, regexp_replace(trim({_sql_found("b", FIRST_HEADING)}, chr(32) || chr(9) || chr(13) || chr(12)), '{NO_PRODUCT}', '') AS p, {_LEVEL(BEGINNER)} AS easy, {_LEVEL(ADVANCED)} AS hard FROM h)
SELECT doc_id, coalesce(named, dated) AS version, CASE WHEN named IS NOT NULL THEN dated END AS document_date, ({_SUM(HEADINGS)})::INT AS sections, ({_SUM(STEPS)})::INT AS steps, len(blocks)::INT AS code_blocks, list_sort(list_distinct(list_filter(list_transform(blocks, lambda x: regexp_extract(x, '{FENCE_NAME}', 1)), lambda x: x <> ''))) AS languages,
CASE WHEN easy > hard THEN 'beginner' WHEN hard > easy THEN 'advanced' ELSE 'intermediate' END AS level, CASE WHEN length(p) BETWEEN 4 AND 99 THEN p END AS product, len({_sql_all("b", CROSS_REFERENCE)})::INT AS cross_references FROM x""")
def manual_fields(spark, sf_dir):
    """The fields of manuals, in heads of many forms before the texts."""
    return table(spark, sf_dir, "documents").select("doc_id", _MANUAL_TEXT.column.alias("b")).select("doc_id", manual(F.col("b")).alias("x")).select("doc_id", "x.*")


# The patterns of replies, forwards, signatures and footers.
REPLIES = r"(?im)^(?:>|On .+ wrote:|Am .+ schrieb:|Le .+ a écrit :|El .+ escribió:).*(?:\n[ \t]*>.*)*\n?"
FORWARDS = tuple(rf"(?ims)^{p}.*?(?:\n.*?){{0,5}}\n" for p in ("-+\\s*Forwarded message\\s*-+", "-+\\s*Original message\\s*-+", "-+\\s*Weitergeleitete Nachricht\\s*-+", "Begin forwarded message:", "From:[^\\n]*\\nSent:[^\\n]*\\nTo:[^\\n]*\\nSubject:"))
SIGNATURES = r"(?ims)^(?:--[ \t]*$|___+$|Sent from my (?:iPhone|iPad|Android)|Get Outlook for (?:iOS|Android)|(?:Best regards|Kind regards|Cheers|Thanks),?[ \t]*$).*"
FOOTERS = (r"(?is)This email.*confidential.*", r"(?is)CONFIDENTIALITY NOTICE.*", r"(?is)This message.*intended recipient.*", r"(?is)If you.*received.*in error.*")


def mail_body(c: Column) -> Column:
    """A mail without replies and their quotes, forward heads with up to five lines, what follows a signature mark, and legal footers; no blanks at ends of lines, at most one empty line in a row."""
    c = F.regexp_replace(c, REPLIES, "")
    for p in FORWARDS:
        c = F.regexp_replace(c, p, "\n")
    for p in (SIGNATURES, *FOOTERS):
        c = F.regexp_replace(c, p, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t\r\f]+(?=\n|$)", ""), F.lit(" \t\n\r\f"))


_MAIL = (
    Varied(("Hello,\n", "> old text\n>> older\nOn Monday Ann wrote:\n> quoted\n  > more\nmine\n", "Am Montag schrieb Bo:\n> alt\nAm Mo. 3 Uhr schrieb: Bo\n", "\n"), 3),
    Varied(("", "--- Forwarded message ---\nFrom: a\nTo: b\nDate: c\nSubject: d\n\nbody\n", "From: a\nSent: b\nTo: c\nSubject: d\nx\ny\nz\nw\nv\n"), 5), "text",
    Varied(("\n\n\n\nend  \nline", "\n--\nAnn\n> more", "\nKind regards,\nBo", "\nThanks for all\nSent from my iPhone\nx", "\nThis email is strictly\nconfidential, and so on", "\nIf you have received this in error, go", "\nbest regards\nC"), 7),
)
_MAIL_TEXT = Joined(_MAIL)


def _sql_replaced(body: str, patterns: list[tuple[str, str]]) -> str:
    for p, by in patterns:
        body = f"regexp_replace({body}, '{p}', {by}, 'g')"
    return body


_MAIL_CLEAN = _sql_replaced("b", [(REPLIES, "''"), *((p, "chr(10)") for p in FORWARDS), *((p, "''") for p in (SIGNATURES, *FOOTERS)), (r"\n{3,}", "chr(10) || chr(10)"), (r"(?m)[ \t\r\f]+$", "''")])


@query("mail_clean", f"SELECT doc_id, trim({_MAIL_CLEAN}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12)) AS body FROM (SELECT doc_id, {_MAIL_TEXT.sql} AS b FROM documents)")
def mail_clean(spark, sf_dir):
    """Texts as mails with replies, forwards, signatures and footers around them, cleaned."""
    return table(spark, sf_dir, "documents").select("doc_id", mail_body(_MAIL_TEXT.column).alias("body"))


def kept_enough(original: Column, processed: Column, least: float = 0.3) -> Column:
    """Whether a clean-up has left 30 % of the characters or more."""
    return F.length(processed) >= F.length(original) * least


@query("retention_check", f"SELECT doc_id, length(trim({_MAIL_CLEAN}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))) >= 0.3 * length(b) AS valid FROM (SELECT doc_id, {_MAIL_TEXT.sql} AS b FROM documents)")
def retention_check(spark, sf_dir):
    """Mails of which too much went in the clean-up."""
    return table(spark, sf_dir, "documents").select("doc_id", kept_enough(_MAIL_TEXT.column, mail_body(_MAIL_TEXT.column)).alias("valid"))


# Titles that make a name specific, words that are roles and no names, and titles that are no part of a name.
SPECIFIC_TITLES = ("dr.", "dr", "prof.", "prof", "dipl.-ing.", "ing.", "mag.", "msc.", "ba.", "ma.", "phd", "jr.", "sr.")
ROLE_WORDS = (
    "richterin richter staatsanwalt staatsanwältin rechtsanwalt rechtsanwältin anwalt anwältin verfahrensbeistand verfahrensbevollmächtigter sachverständiger sachverständige notar notarin prozessbevollmächtigter kläger klägerin beklagter beklagte "
    "angeklagter angeklagte zeuge zeugin geschädigter geschädigte lehrer lehrerin lehrkraft schulleiter schulleiterin erzieher erzieherin direktor direktorin klassenlehrer klassenlehrerin rektor rektorin arzt ärztin doktor doktorin therapeut therapeutin "
    "facharzt fachärztin kinderarzt kinderärztin geschäftsführer geschäftsführerin vorstand vorständin manager managerin mitarbeiter mitarbeiterin kollege kollegin beamter beamtin sachbearbeiter sachbearbeiterin referent referentin minister ministerin "
    "herr frau person antragsteller antragstellerin judge lawyer attorney counsel prosecutor teacher principal doctor director employee colleague representative guardian witness defendant plaintiff clerk"
).split()
NAME_TITLES = (
    "dr. dr prof. prof dipl.-ing. dipl.ing ing. mag. msc. ba. ma. phd rechtsanwalt rechtsanwältin ra ra. richterin richter verfahrensbeistand verfahrensbevollmächtigter staatsanwalt staatsanwältin mr. mr mrs. mrs ms. ms miss attorney atty jr. jr sr. sr ii iii iv"
).split()


def specific_person(name: Column) -> Column:
    """Whether a name is a person's: with a title anywhere; else one capitalised word that is no role; else several words of which not the first two are roles."""
    low = F.lower(F.btrim(name))
    parts = F.filter(F.split(low, r"\s+"), lambda x: x != "")
    role = lambda k: F.coalesce(F.get(parts, F.lit(k)).isin(*ROLE_WORDS), F.lit(False))
    one = ~role(0) & F.btrim(name).rlike(r"^\p{Lu}") & (F.upper(name) != name)
    return F.when(F.size(parts) == 0, False).when(reduce(lambda a, b: a | b, (low.contains(t) for t in SPECIFIC_TITLES)), True).when(F.size(parts) == 1, one).otherwise(~(role(0) & role(1)))


_NAME = (
    Varied(("", "Dr. ", "PROF. ", "Judge ", "teacher ", "Richterin ", " ", "Frau "), 3), Varied(("Weber", "WEBER", "weber", "Kläger", "Manager", "andreas", "", "Lee  Ann", "kind jr."), 5), Varied((" ", " Notar", "", " Teacher", " Holm"), 7),
)
_NAME_TEXT = Joined(_NAME)
_ROLES = "[" + ", ".join(f"'{w}'" for w in ROLE_WORDS) + "]"


@query("specific_people", f"""WITH d AS (SELECT doc_id, {_NAME_TEXT.sql} AS name FROM documents), p AS (SELECT doc_id, trim(name) AS name, lower(name) AS low, list_filter(string_split_regex(lower(name), '\\s+'), lambda x: x <> '') AS w FROM d)
SELECT doc_id, CASE WHEN len(w) = 0 THEN false WHEN len(list_filter([{", ".join(f"'{t}'" for t in SPECIFIC_TITLES)}], lambda t: contains(low, t))) > 0 THEN true
WHEN len(w) = 1 THEN NOT list_contains({_ROLES}, w[1]) AND name[1] <> lower(name[1]) AND upper(name) <> name ELSE NOT (list_contains({_ROLES}, w[1]) AND list_contains({_ROLES}, w[2])) END AS specific FROM p""")
def specific_people(spark, sf_dir):
    """Names of people, roles and titles in many combinations."""
    return table(spark, sf_dir, "documents").select("doc_id", specific_person(_NAME_TEXT.column).alias("specific"))


def normal_name(name: Column) -> Column:
    """Lower case, without titles that are whole words (the longest first), points, commas and colons; single blanks."""
    titles = "|".join(t.replace(".", r"\.") for t in sorted(NAME_TITLES, key=lambda t: (-len(t), t)))
    c = F.regexp_replace(F.lower(name), rf"(?<![\p{{L}}\p{{N}}_])(?:{titles})(?![\p{{L}}\p{{N}}_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[,.;:]", ""), r"\s+", " "))


_FULL = (
    Varied(("Prof. Dr. ", "dr.", "Frau ", "MS ", "Richter ", "Mr. Dr ", "Drake ", "ra. "), 3), Varied(("Anna", "Bo-Lee", "Drew", "Édith", "Ivan"), 5), Varied((" Weber", ", Maria", "  Ingmar;", " Prada: K."), 7), Varied(("", " Jr.", " III", " iv,", " phd"), 11),
)
_FULL_TEXT = Joined(_FULL)


@query("normal_names", f"""WITH d AS (SELECT doc_id, lower({_FULL_TEXT.sql}) AS name FROM documents), t AS (SELECT doc_id, regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*') AS w FROM d)
SELECT doc_id, array_to_string(list_filter(w, lambda x: NOT list_contains([{", ".join(f"'{t.rstrip('.')}'" for t in NAME_TITLES)}], x)), ' ') AS normal FROM t""")
def normal_names(spark, sf_dir):
    """Full names with titles before and after them. The SQL drops the titles word by word."""
    return table(spark, sf_dir, "documents").select("doc_id", normal_name(_FULL_TEXT.column).alias("normal"))


def clean_title(c: Column) -> Column:
    """Single blanks, brackets opened, without characters that file names can't have and dashes or colons at the ends, at most 100 long; Document if nothing is left."""
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"[\[(]([^\])]+)[\])]", "$1")
    c = F.trim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*]', ""), r"\s+", " "))
    return F.coalesce(F.nullif(F.rtrim(F.substring(F.regexp_replace(c, r"^[-:\s]+|[-:\s]+$", ""), 1, 100)), F.lit("")), F.lit("Document"))


def _sql_clean_title(c: str) -> str:
    c = f"regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '[\\[(]([^\\])]+)[\\])]', '\\1', 'g')"
    c = f"trim(regexp_replace(regexp_replace({c}, '[<>:\"/\\\\|?*]', '', 'g'), '\\s+', ' ', 'g'))"
    return f"coalesce(nullif(rtrim(substr(regexp_replace({c}, '^[-:\\s]+|[-:\\s]+$', '', 'g'), 1, 100)), ''), 'Document')"


# The patterns that a title is looked for by, in order.
COURT, CASE_NUMBER = r"(Amtsgericht|Landgericht|Oberlandesgericht)\s+([A-ZÄÖÜ][a-zäöüß]+)", r"(\d{1,4}\s*[A-Z]?\s*\d{1,4}/\d{2,4})"
INVOICE_TITLE, CLIENT = r"(?i)Invoice\s*#?\s*(\d{4}-\d+|\d+)", r"(?:Client|Customer|For):\s*([A-Z][a-zA-Z\s&]+)"
SCHOOL = ((r"(?i)Einschulung\s+(\d{4}[/-]\d{2,4})", "Einschulung", 1), (r"(?i)Schuleingangsuntersuchung", "Schuleingangsuntersuchung", 0), (r"(?i)OGS[-\s]+(Anmeldung|Vertrag|Betreuung)", "OGS", 1))
SUBJECT, SUBJECT_PREFIX = r"(?im)^Subject:[ \t]*(.+)$", r"(?i)^(?:Re:|Fwd:|Fw:)\s*"
HEADING, INNER_HEADING, TITLE_LINE = r"(?m)^#\s+([^\n#]+)", r"#\s+([^#]+?)(?:\s*#{2,}|$)", r"(?im)^Title:[ \t]*(.+)$"


def title(body: Column, name: Column) -> Column:
    """The first of: court and case number, invoice and client, school form, subject of 3 to 20 words, heading of 3 to 20 words, heading within a line, title line, the first sentence of 7 to 15 words, the file's name."""
    head, top = F.substring(body, 1, 500), F.substring(body, 1, 1000)
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\f"))
    between = lambda c, a, b: F.when(words(c).between(a, b), c)
    court = F.concat(_found(top, COURT, 1), F.lit(" "), _found(top, COURT, 2), F.lit(" - "), strip(_found(top, CASE_NUMBER)))
    bill = F.concat(F.lit("Invoice "), _found(head, INVOICE_TITLE), F.coalesce(F.concat(F.lit(" - "), F.substring(strip(_found(head, CLIENT)), 1, 30)), F.lit("")))
    school = [F.when(head.rlike(p), F.concat_ws(" ", F.lit(prefix), *([F.regexp_extract(head, p, 1)] if g else []))) for p, prefix, g in SCHOOL]
    subject = strip(F.regexp_replace(strip(_found(head, SUBJECT)), SUBJECT_PREFIX, ""))
    inner = strip(_found(body, INNER_HEADING))
    inner = F.when(words(inner).between(3, 19), F.array_join(F.slice(F.filter(F.split(inner, r"\s+"), lambda x: x != ""), 1, 15), " "))
    sentence = F.get(F.filter(F.transform(F.split(head, r"[.!?]\s+", -1), strip), lambda x: words(x).between(7, 15)), F.lit(0))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    for p in (r"(?i)upload_[a-f0-9-]{30,}", r"(?i)^(?:document|file|untitled|scan)[-_\s]*", r"-\d{4,5}$", r"^\d{8}-"):
        stem = F.regexp_replace(stem, p, "")
    stem = F.trim(F.regexp_replace(F.translate(stem, "_-", "  "), r"\s+", " "))
    return clean_title(F.coalesce(court, bill, *school, between(subject, 3, 20), between(strip(_found(body, HEADING)), 3, 20), inner, between(strip(_found(body, TITLE_LINE)), 3, 20), sentence, stem))


_HEAD = (
    Varied(("Amtsgericht Köln, 12 F 34/21\n", "", "INVOICE # 2024-17 For: Bay & Sons\n", "", "Einschulung 2024/25\n", "Subject: Re: about the big plan\n", "Subject: two words\n", "# Head of three: words (now)\n", "x # Inner one of four ## y\n", "Title: a title of its own\n", "", "OGS-Vertrag\n"), 3),
    Varied(("A first sentence has more than seven words. ", "Short. ", ""), 5), "text",
)
_FILE = (Varied(("scan_", "20240101-", "upload_0123456789abcdef0123456789abcdef ", "my-"), 7), "source", Varied(("-72851", "_x", ""), 11), Varied((".pdf", ".tar.gz", ""), 13))
_HEAD_TEXT = Joined(_HEAD)
_FILE_TEXT = Joined(_FILE)
_WS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(12)"
_N = lambda c: f"len(list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> ''))"


@query("titles", f"""WITH d AS (SELECT doc_id, {_HEAD_TEXT.sql} AS b, {_FILE_TEXT.sql} AS name FROM documents), h AS (SELECT *, substr(b, 1, 500) AS head, substr(b, 1, 1000) AS top FROM d),
x AS (SELECT *, {_sql_found("top", COURT, 1)} || ' ' || {_sql_found("top", COURT, 2)} || ' - ' || trim({_sql_found("top", CASE_NUMBER)}, {_WS}) AS court,
'Invoice ' || {_sql_found("head", INVOICE_TITLE)} || coalesce(' - ' || substr(trim({_sql_found("head", CLIENT)}, {_WS}), 1, 30), '') AS bill, {", ".join(f"CASE WHEN regexp_matches(head, '{p}') THEN '{n}' {f'''|| ' ' || regexp_extract(head, '{p}', 1)''' if g else ''} END AS s{k}" for k, (p, n, g) in enumerate(SCHOOL))},
trim(regexp_replace(trim({_sql_found("head", SUBJECT)}, {_WS}), '{SUBJECT_PREFIX}', ''), {_WS}) AS subject, trim({_sql_found("b", HEADING)}, {_WS}) AS heading, trim({_sql_found("b", INNER_HEADING)}, {_WS}) AS inside, trim({_sql_found("b", TITLE_LINE)}, {_WS}) AS line,
list_filter(list_transform(string_split_regex(head, '[.!?]\\s+'), lambda s: trim(s, {_WS})), lambda s: {_N("s")} BETWEEN 7 AND 15)[1] AS sentence,
trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '(?i)upload_[a-f0-9-]{{30,}}', '', 'g'), '(?i)^(?:document|file|untitled|scan)[-_\\s]*', ''), '-\\d{{4,5}}$', ''), '^\\d{{8}}-', ''), '_-', '  '), '\\s+', ' ', 'g')) AS stem FROM h),
t AS (SELECT doc_id, coalesce(court, bill, s0, s1, s2, CASE WHEN {_N("subject")} BETWEEN 3 AND 20 THEN subject END, CASE WHEN {_N("heading")} BETWEEN 3 AND 20 THEN heading END, CASE WHEN {_N("inside")} BETWEEN 3 AND 19 THEN array_to_string(list_filter(string_split_regex(inside, '\\s+'), lambda x: x <> '')[1:15], ' ') END,
CASE WHEN {_N("line")} BETWEEN 3 AND 20 THEN line END, sentence, stem) AS t FROM x) SELECT doc_id, {_sql_clean_title("t")} AS title FROM t""")
def titles(spark, sf_dir):
    """Titles of texts under heads of many forms, and of their files."""
    return table(spark, sf_dir, "documents").select("doc_id", _HEAD_TEXT.column.alias("b"), _FILE_TEXT.column.alias("name")).select("doc_id", title(F.col("b"), F.col("name")).alias("title"))


# A type, the words in the first 2,000 characters (lower case) that make it, and those in the file's name; the first that holds.
KIND_RULES = (
    ("legal/court-decision", ("urteil", "beschluss"), ()), ("legal/law", ("schulgesetz", "bass", "§", "artikel", "gesetz"), ()), ("legal/contract", ("vertrag&vereinbarung",), ()), ("form/questionnaire", ("questionnaire",), ("fragebogen",)),
    ("form/checklist", ("checklist",), ("checkliste", "zeitstrahl")), ("form/application", ("application",), ("anmeldung",)), ("education/transcript", (), ("transcript",)), ("education/course-material", ("course", "lecture", "lesson", "curriculum"), ()),
    ("reference/brochure", ("brochure",), ("broschüre",)), ("reference/faq", (), ("faq",)), ("reference/guide", (), ("leitfaden", "guide", "handbuch")), ("reference/directory", (), ("verzeichnis", "standorte", "liste", "directory")),
    ("reference/report", ("bericht", "report", "empfehlungen", "expertenbeirat"), ()), ("communication/meeting-notes", ("meeting notes", "besprechung", "protokoll"), ()), ("financial/invoice", ("rechnung", "invoice"), ()),
    ("financial/receipt", ("quittung", "receipt", "beleg"), ()), ("government/regulation", ("verordnung", "erlass", "regulation"), ()), ("government/policy", ("policy", "richtlinie"), ()),
)
UNKNOWN_KIND = "unknown/uncategorized"


def semantic_kind(body: Column, name: Column) -> Column:
    """The first type with a word in the text's first 2,000 characters or in the file's name; words joined by & must both be there."""
    low, file = F.lower(F.substring(body, 1, 2000)), F.lower(name)
    every = lambda c, w: reduce(lambda a, b: a & b, (c.contains(x) for x in w.split("&")))
    out = F.when(F.lit(False), "")
    for kind, words, names in KIND_RULES:
        out = out.when(reduce(lambda a, b: a | b, [*(every(low, w) for w in words), *(every(file, w) for w in names)]), kind)
    return out.otherwise(UNKNOWN_KIND)


_TOPIC = Varied(("", "Urteil ", "Das Gesetz ", "Vertrag und Vereinbarung ", "Vertrag ", "Questionnaire ", "application ", "a lecture ", "Bericht ", "Protokoll ", "Invoice ", "receipt ", "Erlass ", "policy ", "brochure "), 3)
_NAMED = Varied(("a.txt", "Fragebogen.pdf", "zeitstrahl", "b.md", "transcript.doc", "FAQ.md", "user-guide", "Liste 3", "c", "d", "e", "Anmeldung"), 5)
_KIND_SQL = " ".join("WHEN " + " OR ".join([*(" AND ".join(f"contains(low, '{x}')" for x in w.split("&")) for w in words), *(f"contains(file, '{w}')" for w in names)]) + f" THEN '{kind}'" for kind, words, names in KIND_RULES)


@query("semantic_kinds", f"SELECT doc_id, CASE {_KIND_SQL} ELSE '{UNKNOWN_KIND}' END AS kind FROM (SELECT doc_id, lower(substr({_TOPIC.sql} || text, 1, 2000)) AS low, lower({_NAMED.sql}) AS file FROM documents)")
def semantic_kinds(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", semantic_kind(F.concat(_TOPIC.column, "text"), _NAMED.column).alias("kind"))


_BAD = Varied(("", "\0", "", "�", "\x07\x08" * 40, "", "\t\r\n" * 40), 3)


def corrupt(body: Column) -> Column:
    """Over 100 characters, and a NUL, a replacement character, or more than a tenth control characters."""
    control = F.length(F.regexp_replace(body, r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return F.coalesce((F.length(body) > 100) & (body.contains("\0") | body.contains("�") | (control > F.length(body) * 0.1)), F.lit(False))


@query("valid_content", f"SELECT doc_id, length(trim(text)) >= 10 AS valid, coalesce(length(b) > 100 AND (contains(b, chr(0)) OR contains(b, chr(65533)) OR length(regexp_replace(b, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g')) * 10 > length(b)), false) AS corrupt FROM (SELECT doc_id, text, {_BAD.sql} || text AS b FROM documents)")
def valid_content(spark, sf_dir):
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim(body)) >= 10).alias("valid"), corrupt(F.concat(_BAD.column, body)).alias("corrupt"))


@query("recency", typed("SELECT o_orderkey, round(greatest(0.05, least(1.0, exp(-0.003 * date_diff('day', o_orderdate::DATE, DATE '1998-12-31')))), 6) AS recency FROM orders", recency="DOUBLE"))
def recency(spark, sf_dir):
    """Recency of orders as of a day."""
    from textloom.functions import dates

    age = F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(dates.recency(age), 6).alias("recency"))


# The heads of long legal sections and of bank details, and from how many characters on they go.
SECTIONS = (r"(?is)(?:Terms?\s+(?:and|&)\s+Conditions?|Allgemeine\s+Geschäftsbedingungen|AGB).*", r"(?is)(?:Legal\s+Notice|Rechtliche\s+Hinweise).*", r"(?is)(?:Privacy\s+Policy|Datenschutz).*")
BANK, SECTION_CHARS, BANK_CHARS = r"(?is)(?:Bank\s+Details?|Bankverbindung).*?(?:IBAN|BIC|Swift).*?(?:\n\n|\z)", 500, 300


def invoice_body(c: Column) -> Column:
    """An invoice without a long legal section (from its head to the end) and long bank details; blanks single but in aligned lines, at most one empty line in a row."""
    once = lambda c, f: F.transform(F.array(c), f)[0]  # noqa: E731  each step's text is made once, however often it is named
    for p in SECTIONS:
        c = once(c, lambda x: F.when(F.length(F.regexp_extract(x, p, 0)) > SECTION_CHARS, F.regexp_replace(x, p, "")).otherwise(x))  # noqa: B023
    c = once(c, lambda x: once(F.regexp_extract(x, BANK, 0), lambda bank: F.when(F.length(bank) > BANK_CHARS, F.replace(x, bank, F.lit(""))).otherwise(x)))
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    lines = F.transform(F.split(c, "\n"), lambda x: once(words(x), lambda ws: F.when((F.size(ws) >= 2) & x.rlike(r"\s{3,}"), x).otherwise(F.array_join(ws, " "))))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \t\n\r\f"))


_LONG_BILL = Joined((Varied(("Bolt     12,50\n", "a  b\n\n\n\nc\n", "x\n"), 3), Varied(("Bank details: IBAN 1\n\n", "Bankverbindung\nBIC ", "", "Bank Detail Swift "), 5), "text", Varied(("\n\n", " "), 7), Varied(("Terms & Conditions\n", "Legal notice ", "", "AGB und Datenschutz "), 11), "text"))


@query("invoice_clean", f"""WITH d AS (SELECT doc_id, {_LONG_BILL.sql} AS b FROM documents), s AS (SELECT doc_id, CASE WHEN length(regexp_extract(b, '{SECTIONS[0]}')) > {SECTION_CHARS} THEN regexp_replace(b, '{SECTIONS[0]}', '') ELSE b END AS b FROM d),
t AS (SELECT doc_id, CASE WHEN length(regexp_extract(b, '{SECTIONS[1]}')) > {SECTION_CHARS} THEN regexp_replace(b, '{SECTIONS[1]}', '') ELSE b END AS b FROM s), u AS (SELECT doc_id, CASE WHEN length(regexp_extract(b, '{SECTIONS[2]}')) > {SECTION_CHARS} THEN regexp_replace(b, '{SECTIONS[2]}', '') ELSE b END AS b FROM t),
k AS (SELECT doc_id, CASE WHEN length(regexp_extract(b, '{BANK}')) > {BANK_CHARS} THEN replace(b, regexp_extract(b, '{BANK}'), '') ELSE b END AS b FROM u)
SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split(b, chr(10)), lambda x: CASE WHEN regexp_matches(x, '\\s{{3,}}') AND {_N("x").replace("lambda x:", "lambda w:").replace("x <> ''", "w <> ''")} >= 2 THEN x ELSE array_to_string(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''), ' ') END), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}) AS body FROM k""")
def invoice_clean(spark, sf_dir):
    """Texts as invoices with legal sections, bank details and aligned lines, cleaned."""
    return table(spark, sf_dir, "documents").select("doc_id", _LONG_BILL.column.alias("b")).select("doc_id", invoice_body(F.col("b")).alias("body"))
