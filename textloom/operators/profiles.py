"""What all documents say about a person, an organisation or a place: roles, addresses, and whom it occurs with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.operators.entities import NAME
from textloom.registry import query, table

#: Documents listed for a name, and names listed with it.
LISTED, LINKED = 10, 20
LINKS = ("roles", "organisations", "people", "locations", "emails")
RECORD = "doc_id long, at date, sender string, people array<string>, roles array<struct<name: string, role: string>>, organisations array<string>, locations array<string>"


def _first(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each key. The bound on the rank lets each task keep no more of a key before they meet, so that a key of many rows isn't one task's."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def occurrences(records: DataFrame) -> DataFrame:
    """(kind, name, doc_id, at): each name of two letters or more once for each document."""
    of = {"person": "people", "organisation": "organisations", "place": "locations"}
    rows = [records.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.transform(c, lambda x: F.trim(x)))).alias("name"), "doc_id", "at") for kind, c in of.items()]
    return reduce(DataFrame.unionByName, rows).where(F.length("name") >= 2)


def links(records: DataFrame) -> DataFrame:
    """(kind, name, link, other, n): in how many documents a name and another stand together; a person's roles, and the addresses of senders whose line has the person's name.

    Pairs are summed before they are dealt; each is counted once and read from both ends.
    """
    names = lambda c: F.filter(F.array_distinct(F.transform(c, lambda x: F.trim(x))), lambda x: F.length(x) >= 2)
    rows = records.select("doc_id", "sender", "roles", names("people").alias("person"), names("organisations").alias("organisation"), names("locations").alias("place"))

    def together(a: str, b: str) -> DataFrame:
        return rows.select(F.explode(a).alias("a"), b).select("a", F.explode(b).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))

    def read(pairs: DataFrame, kind: str, name: str, link: str, other: str) -> DataFrame:
        return pairs.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.lit(link).alias("link"), F.col(other).alias("other"), "n")

    people, where, at = together("person", "organisation"), together("organisation", "place"), together("person", "place")
    role = rows.select("person", F.explode(F.array_distinct("roles")).alias("r")).where("r.role <> ''").where(F.array_contains("person", F.trim("r.name")))
    role = role.groupBy(F.trim("r.name").alias("a"), F.trim("r.role").alias("b")).agg(F.count("*").alias("n"))
    address = F.nullif(F.regexp_extract("sender", r"[\w.+-]+@[\w-]+\.[\w.-]+", 0), F.lit(""))
    mail = rows.select("sender", address.alias("b"), F.explode("person").alias("a")).where(F.col("b").isNotNull() & F.contains(F.lower("sender"), F.lower("a"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    out = [read(people, "person", "a", "organisations", "b"), read(people, "organisation", "b", "people", "a"), read(where, "organisation", "a", "locations", "b"), read(where, "place", "b", "organisations", "a"), read(at, "place", "b", "people", "a"), read(role, "person", "a", "roles", "b"), read(mail, "person", "a", "emails", "b")]
    return reduce(DataFrame.unionByName, out)


def profiles(records: DataFrame, listed: int = LISTED, linked: int = LINKED) -> DataFrame:
    """A row for each (kind, name): documents, first_seen, last_seen, sample (the first documents by date), and under each of LINKS the ``linked`` names it stands together with most, by letters where equal.

    Names keep their case and are trimmed; null or empty lists name nothing, a null date is none and comes last.
    """
    tables = shared.Tables(records.sparkSession, "profiles")
    key = ["kind", "name"]
    found = tables.write(occurrences(records), "occurrences")
    plain = found.groupBy(*key).agg(F.count("*").alias("documents"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))
    sample = _first(found, key, [F.asc_nulls_last("at"), "doc_id"], listed).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("at").isNull(), "at", "doc_id"))).alias("s"))
    best = _first(links(records), [*key, "link"], [F.desc("n"), "other"], linked)
    of = lambda link: F.transform(F.array_sort(F.collect_list(F.when(F.col("link") == link, F.struct((-F.col("n")).alias("m"), "other")))), lambda x: x["other"]).alias(link)
    together = best.groupBy(*key).agg(*map(of, LINKS))
    empty = F.array().cast("array<string>")
    out = plain.join(sample, key).join(together, key, "left").select(*key, "documents", "first_seen", "last_seen", F.transform("s", lambda x: x["doc_id"]).alias("sample"), *(F.coalesce(x, empty).alias(x) for x in LINKS))
    return tables.keep(out)


ROLES = ("lead", "editor", "guest")


def records_of(spark, sf_dir: str) -> DataFrame:
    """Records of all texts: runs of capitalised words are people, the first three of which have roles; the source is an organisation, the language a place; the last person sends the document."""
    people = F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", people.alias("people"))
    sender = F.when(F.size("people") > 0, F.concat(F.element_at("people", -1), F.lit(" <"), F.lower(F.regexp_replace(F.element_at("people", -1), r"[^A-Za-z]", "x")), F.lit("@"), "source", F.lit(".org>")))
    roles = F.transform(F.slice("people", 1, 3), lambda x, k: F.struct(x.alias("name"), F.element_at(F.array(*map(F.lit, ROLES)), k + 1).alias("role")))
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 37 % 365).cast("int"))
    return rows.select("doc_id", at.alias("at"), sender.alias("sender"), "people", roles.alias("roles"), F.array("source").alias("organisations"), F.array("lang").alias("locations"))


@query("entity_aggregates", rf"""WITH d AS (SELECT doc_id, lang, source, DATE '2024-01-01' + (doc_id * 37 % 365)::INT AS seen, list_distinct(regexp_extract_all(text, '{NAME}')) AS raw, regexp_extract_all(text, '{NAME}') AS every FROM documents),
o AS (SELECT *, list_filter(every, lambda x, k: list_position(every, x) = k) AS people FROM d),
s AS (SELECT *, CASE WHEN len(people) > 0 THEN people[-1] || ' <' || lower(regexp_replace(people[-1], '[^A-Za-z]', 'x', 'g')) || '@' || source || '.org>' END AS sender FROM o),
x AS (SELECT doc_id, seen, 'person' AS kind, unnest(people) AS name FROM s UNION ALL SELECT doc_id, seen, 'organisation', source FROM s UNION ALL SELECT doc_id, seen, 'place', lang FROM s),
p AS (SELECT doc_id, source, lang, sender, unnest(people) AS name, unnest(range(1, len(people) + 1)) AS k FROM s),
l AS (SELECT 'person' AS kind, name, 'organisations' AS link, source AS other FROM p UNION ALL SELECT 'organisation', source, 'people', name FROM p UNION ALL SELECT 'organisation', source, 'locations', lang FROM s UNION ALL SELECT 'place', lang, 'organisations', source FROM s
    UNION ALL SELECT 'place', lang, 'people', name FROM p UNION ALL SELECT 'person', name, 'roles', ['lead', 'editor', 'guest'][k] FROM p WHERE k <= 3 UNION ALL SELECT 'person', name, 'emails', regexp_extract(sender, '[\w.+-]+@[\w-]+\.[\w.-]+') FROM p WHERE contains(lower(sender), lower(name))),
n AS (SELECT kind, name, link, other, count(*) AS n, row_number() OVER (PARTITION BY kind, name, link ORDER BY count(*) DESC, other) AS r FROM l GROUP BY kind, name, link, other),
t AS (SELECT kind, name, {", ".join(f"list(other ORDER BY r) FILTER (link = '{k}') AS {k}" for k in LINKS)} FROM n WHERE r <= {LINKED} GROUP BY kind, name),
c AS (SELECT kind, name, count(*) AS documents, min(seen) AS first_seen, max(seen) AS last_seen, list(doc_id ORDER BY seen, doc_id)[1:{LISTED}] AS sample FROM x GROUP BY kind, name)
SELECT kind, name, documents, first_seen::DATE AS first_seen, last_seen::DATE AS last_seen, sample, {", ".join(f"coalesce({k}, []) AS {k}" for k in LINKS)} FROM c LEFT JOIN t USING (kind, name)""")
def entity_aggregates(spark, sf_dir):
    """The profiles of all people, organisations and places of all documents."""
    return profiles(records_of(spark, sf_dir))
