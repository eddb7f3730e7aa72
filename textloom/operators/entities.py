"""Names: normal forms, similarity, clusters, concepts, aggregates and pages."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.operators import similar
from textloom.operators.checks import entity_kind
from textloom.operators.rules import normal_name
from textloom.registry import query, table

SAME, CAP = 0.85, 20


def similarity(a: str, b: str) -> float:
    """1 if equal; 0.85 and up if one holds the other; by shared words; else by matching blocks."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return 0.85 + 0.1 * min(len(a), len(b)) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    j = len(x & y) / len(x | y)
    return 0.7 + 0.3 * j if j > 0.5 else difflib.SequenceMatcher(None, a, b).ratio()


def alike(names: DataFrame, tables: shared.Tables, same: float = SAME) -> DataFrame:
    """(kind, name, other, similarity, other_first): all pairs of names of a kind that are alike enough, the later one of (first, name) as ``name``.

    Each branch of the similarity has candidates that lose no pair: names that hold another, names that share over half of
    their words, and, since matching blocks are a common subsequence, names whose indel ratio can be ``same``.
    """
    strings = names.select("kind", F.col("name").alias("t"))
    pairs = similar.holding(strings, tables).unionByName(similar.sharing_words(strings, tables)).unionByName(similar.near_pairs(strings, same, tables))
    pairs = tables.write(pairs.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    of = lambda x: names.select("kind", F.col("name").alias(x), F.col("first").alias(f"first_{x}"))
    both = pairs.join(of("a"), ["kind", "a"]).join(of("b"), ["kind", "b"])
    later = F.expr("first_a > first_b or first_a = first_b and a > b")
    both = both.select("kind", F.when(later, F.col("a")).otherwise(F.col("b")).alias("name"), F.when(later, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(later, F.col("first_b")).otherwise(F.col("first_a")).alias("other_first"))

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return both.withColumn("similarity", score("name", "other")).where(F.col("similarity") >= same)


def first_come(edges: DataFrame, tables: shared.Tables) -> tuple[DataFrame, int]:
    """(v, chosen) of all v of edges (v, u): chosen if no chosen u comes before it, as if taken one after another; and the rounds that took.

    A round settles those next to a chosen one and those that only settled ones come before. Those with a single open u
    before them are its opposite: they point to it, and pointers to pointers are followed by doubling, so that a chain of
    any length is settled within a round. On names in random order the rounds grow as the logarithm of their number.
    """
    settled = tables.write(edges.select(F.col("u").alias("v")).distinct().join(edges.select("v").distinct(), "v", "left_anti").withColumn("chosen", F.lit(True)), "settled")
    every, todo, fresh, rounds = settled, tables.write(edges.select("v", "u").distinct(), "todo"), settled, 0
    while not todo.isEmpty():
        rounds += 1
        known = todo.join(fresh.select(F.col("v").alias("u"), "chosen"), "u", "left")
        by = tables.write(known.groupBy("v").agg(F.bool_or(F.coalesce("chosen", F.lit(False))).alias("covered"), F.count_if(F.col("chosen").isNull()).alias("n"), F.min(F.when(F.col("chosen").isNull(), F.col("u"))).alias("up")), "by")
        now = by.where("covered or n = 0").select("v", (~F.col("covered")).alias("chosen"))
        left = tables.write(known.where("chosen is null").select("v", "u").join(by.where("not covered"), "v", "left_semi"), "left")
        now = tables.write(now, "now")
        chain = tables.write(by.where("not covered and n = 1").select("v", "up", F.lit(True).alias("odd")), "chain")
        while True:
            ahead = chain.select(F.col("v").alias("up"), F.col("up").alias("up2"), F.col("odd").alias("odd2"))
            longer = tables.write(chain.join(ahead, "up", "left").select("v", F.coalesce("up2", "up").alias("up"), (F.col("odd") != F.coalesce("odd2", F.lit(False))).alias("odd"), F.col("up2").isNotNull().alias("moved")), "chain")
            tables.drop(chain)
            chain = longer
            if chain.where("moved").isEmpty():
                break
        ends = now.select(F.col("v").alias("up"), "chosen")
        follow = chain.join(ends, "up").select("v", (F.col("chosen") != F.col("odd")).alias("chosen"))
        new = tables.write(now.unionByName(follow), "fresh")
        rest = tables.write(left.join(new, "v", "left_anti"), "todo")
        more = tables.write(every.unionByName(new), "settled")
        tables.drop(todo, by, left, now, chain, every, *([fresh] if fresh is not every else []))
        every, todo, fresh = more, rest, new
    return every, rounds


def clusters(mentions: DataFrame, same: float = SAME) -> DataFrame:
    """(kind, name, canonical) of mentions (kind, name, first), as if taken in order of first: a name joins the best canonical name before it at ``same`` or more, else it becomes one.

    A name is canonical if no alike canonical name is before it. Mentions without a name don't count, a null kind is an
    empty one; an empty table gives an empty one.
    """
    tables, key = shared.Tables(mentions.sparkSession, "clusters"), ["kind", "name"]
    names = tables.write(mentions.groupBy(F.coalesce("kind", F.lit("")).alias("kind"), normal_name(F.col("name")).alias("name")).agg(F.min("first").alias("first")).where("name <> ''"), "names")
    edges = tables.write(alike(names, tables, same), "alike")
    node = lambda name: F.concat_ws("\0", "kind", name)
    chosen, _ = first_come(edges.select(node("name").alias("v"), node("other").alias("u")), tables)
    canonical = chosen.where("chosen").select(F.col("v").alias("u"))
    best = edges.withColumn("u", node("other")).join(canonical, "u", "left_semi").join(canonical.withColumnRenamed("u", "v"), node("name") == F.col("v"), "left_anti")
    best = best.groupBy(*key).agg(F.min(F.struct((-F.round("similarity", 12)).alias("s"), "other_first", "other"))["other"].alias("other"))
    return tables.keep(names.join(best, key, "left").select("kind", "name", F.coalesce("other", "name").alias("canonical")))


NAME = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"


def mentions(spark, sf_dir: str) -> DataFrame:
    """(doc_id, source, kind, name): runs of capitalised words of all texts stand for names; their ends tell software, companies and places, all others are persons."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(NAME), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(words).alias("name")).withColumn("kind", F.coalesce(entity_kind(F.col("name")), F.lit("Person")))


_KIND = "CASE WHEN regexp_matches(lower(name), '\\.(js|py|app)$|os$| ide$| editor$') THEN 'Software' WHEN regexp_matches(lower(name), ' (inc|ltd|gmbh|ag|corp)\\.?$') THEN 'Company' WHEN regexp_matches(lower(name), '(stadt|burg|ville)$') THEN 'Place' ELSE 'Person' END"
_MENTIONS = f"SELECT *, {_KIND} AS kind FROM (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '{NAME}'))) AS name FROM documents)"


@query("entity_clusters")
def entity_clusters(spark, sf_dir):
    """Clusters of all names of all documents."""
    return clusters(mentions(spark, sf_dir).groupBy("kind", "name").agg(F.min("doc_id").alias("first")))


def timeline(records: DataFrame, part: str) -> DataFrame:
    """(name, doc_id, at, position) of records (doc_id, at, names) with a name that holds ``part``, whatever the case: of a doc_id's rows the last by date, the newest first; a null date comes last."""
    m = records.select("doc_id", "at", F.explode("names").alias("name")).where(F.contains(F.lower("name"), F.lit(part.lower()))).select(F.lower("name").alias("name"), "doc_id", "at")
    one = m.groupBy("name", "doc_id").agg(F.max("at").alias("at"))
    return one.withColumn("position", F.row_number().over(Window.partitionBy("name").orderBy(F.desc_nulls_last("at"), "doc_id")))


@query("entity_timeline", f"SELECT name, doc_id, at_ AS \"at\", row_number() OVER (PARTITION BY name ORDER BY at_ DESC, doc_id) AS position FROM (SELECT DISTINCT doc_id, (DATE '2024-01-01' + (doc_id * 37 % 365)::INT)::DATE AS at_, lower(name) AS name FROM ({_MENTIONS}) WHERE lower(name) LIKE '%there%')")
def entity_timeline(spark, sf_dir):
    """Documents that name something, the newest first."""
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 37 % 365).cast("int"))
    return timeline(mentions(spark, sf_dir).select("doc_id", at.alias("at"), F.array("name").alias("names")), "there")


@query("entity_links", f"SELECT source, kind, name, count(*) AS n FROM ({_MENTIONS}) GROUP BY ALL")
def entity_links(spark, sf_dir):
    """Names with the sources they come from."""
    return mentions(spark, sf_dir).groupBy("source", "kind", "name").agg(F.count("*").alias("n"))


def link_concepts(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """(label, concept, category) of labels that a concept's name or other names equal, ignoring case; the first category wins; others are null."""
    names = concepts.select("concept", "category", F.explode(F.array_union(F.array("name"), "other")).alias("n")).select("concept", "category", F.lower("n").alias("key"))
    one = names.groupBy("key").agg(F.min(F.struct("category", "concept")).alias("c"))
    return labels.withColumn("key", F.lower("label")).join(one, "key", "left").select("label", F.col("c.concept").alias("concept"), F.col("c.category").alias("category"))


_CONCEPTS = (("c1", "reading", "The", ("AND", "of")), ("c2", "trade", "der", ("die", "La")), ("c3", "alpha", "the", ("order", "Le")), ("c4", "trade", "that", ()))
_NAMES = ", ".join(f"('{c}', '{k}', '{n.lower()}')" for c, k, name, other in _CONCEPTS for n in (name, *other))


@query("concept_links", f"WITH n(concept, category, key) AS (VALUES {_NAMES}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY category, concept) AS r FROM n), l AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}]+')) AS label FROM documents) SELECT label, concept, category FROM l LEFT JOIN o ON key = lower(label) AND r = 1")
def concept_links(spark, sf_dir):
    """Every word of every text, with the concept that it names."""
    concepts = spark.createDataFrame([(c, k, n, list(o)) for c, k, n, o in _CONCEPTS], "concept string, category string, name string, other array<string>")
    return link_concepts(table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("label")).distinct(), concepts)


def resolved(names: DataFrame, known: DataFrame) -> DataFrame:
    """(original, name, resolved, kb_entry) of distinct names (name), by known people (place, canonical, aliases): the first, by place, whose name or alias it is, as written; other names stay.

    Null names and aliases are none. Aliases are rows of a table, so that a knowledge base of any size is a join.
    """
    forms = known.select("place", "canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).where("form is not null")
    first = forms.groupBy("form").agg(F.min(F.struct("place", "canonical"))["canonical"].alias("canonical"))
    one = names.where("name is not null").select(F.col("name").alias("original")).distinct().join(first, F.col("original") == F.col("form"), "left")
    entry = known.select(F.col("canonical").alias("name"), F.lit(True).alias("kb_entry")).distinct()
    out = one.select("original", F.coalesce("canonical", "original").alias("name")).join(entry, "name", "left")
    return out.select("original", "name", (F.col("name") != F.col("original")).alias("resolved"), F.coalesce("kb_entry", F.lit(False)).alias("kb_entry"))


@query("alias_resolution", f"""WITH m AS (SELECT name, count(*) AS n FROM ({_MENTIONS}) GROUP BY name), k AS (SELECT min(name) AS canonical, list(name) AS aliases FROM m GROUP BY lower(substr(name, 1, 6)) HAVING count(*) > 1),
f AS (SELECT canonical, unnest(list_append(aliases, canonical)) AS form FROM k), o AS (SELECT form, min(canonical) AS canonical FROM f GROUP BY form)
SELECT m.name AS original, coalesce(canonical, m.name) AS name, coalesce(canonical <> m.name, false) AS resolved, coalesce(canonical, m.name) IN (SELECT canonical FROM k) AS kb_entry FROM m LEFT JOIN o ON form = m.name""")
def alias_resolution(spark, sf_dir):
    """All names of all texts, resolved by a knowledge base in which names of the same first six letters are aliases of the first of them by letters."""
    names = mentions(spark, sf_dir).select("name").distinct()
    known = names.groupBy(F.lower(F.substring("name", 1, 6)).alias("k")).agg(F.min("name").alias("canonical"), F.collect_list("name").alias("aliases"), F.count("*").alias("n")).where("n > 1")
    return resolved(names, known.select(F.col("canonical").alias("place"), "canonical", "aliases"))


@query("project_matches", "WITH p(project, topic, s, e) AS (VALUES ('a', 'view', DATE '2024-01-05', DATE '2024-01-10'), ('b', 'click', DATE '2024-01-01', DATE '2024-01-03'), ('c', 'view', DATE '2024-01-09', DATE '2024-01-20')) SELECT project, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN p ON event_type = topic AND ts::DATE BETWEEN s AND e GROUP BY project")
def project_matches(spark, sf_dir):
    """A range join: topics that a project watches, on days when it is active."""
    projects = spark.createDataFrame([("a", "view", "2024-01-05", "2024-01-10"), ("b", "click", "2024-01-01", "2024-01-03"), ("c", "view", "2024-01-09", "2024-01-20")], "project string, topic string, s string, e string")
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    hit = events.join(projects, (F.col("event_type") == F.col("topic")) & F.col("day").between(F.to_date("s"), F.to_date("e")))
    return hit.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("vocabulary_split", "WITH v AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS tags FROM events GROUP BY user_id) SELECT user_id, list_sort(list_filter(tags, lambda x: x IN ('view', 'click'))) AS valid, list_sort(list_filter(tags, lambda x: x NOT IN ('view', 'click'))) AS invalid FROM v")
def vocabulary_split(spark, sf_dir):
    known = F.array(F.lit("view"), F.lit("click"))
    tags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return tags.select("user_id", F.array_sort(F.array_intersect("tags", known)).alias("valid"), F.array_sort(F.array_except("tags", known)).alias("invalid"))


@query("people_caps", "SELECT user_id, list_slice(list_sort(list(DISTINCT event_id)), 1, 20) AS listed FROM events GROUP BY user_id")
def people_caps(spark, sf_dir):
    """Lists cut to their first twenty."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= CAP).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("listed"))
