"""How filters interact: what each of them removes, alone and in every order, from counts of joint failures."""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.scratch import Scratch

#: Filters at most: there are 2 ** n intersections and n! orders.
MOST_FILTERS = 6


def _masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str, text: str, outcomes: dict[str, Column]) -> DataFrame:
    """(doc_id, part, key, f0, f1, ..., o0, o1, ...): a narrow row for each document, 1 for a failed filter and for an outcome."""
    x = docs.withColumn(text, F.coalesce(text, F.lit("")))
    key = F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("key")
    flags = [F.coalesce(c.cast("int"), F.lit(0)).cast("long").alias(f"f{k}") for k, c in enumerate(filters.values())]
    rows = x.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), key, *flags)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*(F.max(F.coalesce(c.cast("int"), F.lit(0))).cast("long").alias(f"o{k}") for k, c in enumerate(outcomes.values())))
    return rows.join(marks, "doc_id", "left").fillna(0, [f"o{k}" for k in range(len(outcomes))])


def joint_failures(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], outcomes: dict[str, Column], scratch: Scratch, *, copies: str | None, part: str = "lang", text: str = "text") -> DataFrame:
    """(part, j0, j1, ...): for each set S of filters, as bits of an index, how many documents fail all of S; j0 of all documents, j1 of those with the first outcome, and so on.

    Each is a sum of products of flags. ``copies`` names one more filter, which every document but the first of an identical
    text fails: its flag is 1 in all rows, and the first rows of their texts, found by a map-side minimum, are taken off
    again, so that no row is joined with its group.
    """
    names = [*filters, *([copies] if copies else [])]
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    base = scratch.write(_masks(docs, labels, filters, part, text, outcomes), "flags")
    sign = F.lit(1).cast("long").alias("sign")
    rows = base.select("*", sign, F.lit(1).cast("long").alias("every"))
    if copies:
        values = [c for c in base.columns if c not in ("key", "doc_id")]
        first = base.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *values)).alias("x")).select("key", "x.doc_id", *(f"x.{c}" for c in values))
        rows = rows.unionByName(first.select("*", (-sign).alias("sign"), F.lit(0).cast("long").alias("every")))

    def product(s: int, outcome: int | None) -> Column:
        """Rows taken off count only where the filter of copies is in S."""
        out = F.col("sign") if copies and s >> len(filters) & 1 else F.col("every")
        for k in range(len(filters)):
            if s >> k & 1:
                out = out * F.col(f"f{k}")
        return out if outcome is None else out * F.col(f"o{outcome}")

    sets, kinds = range(1 << len(names)), [None, *range(len(outcomes))]
    summed = rows.groupBy("part").agg(*(F.sum(product(s, o)).alias(f"s{i}_{s}") for i, o in enumerate(kinds) for s in sets))
    return scratch.write(summed.select("part", *(F.array(*(f"s{i}_{s}" for s in sets)).alias(f"j{i}") for i in range(len(kinds)))), "joint")


def _signed(j: str, n: int, of: str, sign: str) -> Column:
    """The sum of j[s] over the sets s with ``of``, each with ``sign`` times (-1) ** |s|."""
    return F.expr(f"aggregate(sequence(0, {(1 << n) - 1}), 0L, (a, s) -> a + if({of}, {sign} * if(bit_count(s) % 2 = 0, 1, -1) * {j}[s], 0L))")


def interactions(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], *, copies: str | None = None, part: str = "lang", text: str = "text", outcomes: dict[str, Column] | None = None) -> DataFrame:
    """A row for each part, each order of the filters and each step: kept, removed, redundant, unique_fails, an <outcome>_lost for each outcome, and shapley.

    Everything follows from the joint failures J by inclusion and exclusion: the survivors of a set P of filters are the sum
    of (-1)^|S| J(S) over its subsets S; those that fail f alone the sum of (-1)^(|S|-1) J(S) over the sets with f; and since
    (-1)^(|S|-1) J(S) is the Harsanyi dividend of S in the game "how many P removes", f's removals summed over all n! orders
    are the sum of n!/|S| dividends of the sets with f.

    A null text is empty, a null part an empty string, a null condition no failure. Of rows with the same smallest doc_id and
    text one passes the filter of copies; a null doc_id comes after all others. Documents without labels have no outcome; of
    a doc_id's labels the largest holds. An empty table gives no rows, a filter that nothing fails gives zeros. Other columns
    are not read.
    """
    outcomes = outcomes or {}
    names = [*filters, *([copies] if copies else [])]
    n, scratch = len(names), Scratch(docs.sparkSession, "audit")
    joint = joint_failures(docs, labels, filters, outcomes, scratch, copies=copies, part=part, text=text)
    orders = F.from_json(F.lit(json.dumps(list(permutations(range(n))))), "array<array<int>>")
    rows = joint.withColumn("ord", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    rows = rows.withColumn("f", F.element_at("ord", F.col("step"))).withColumn("before", F.expr("aggregate(slice(ord, 1, step - 1), 0, (a, x) -> a | shiftleft(1, x))")).withColumn("after", F.expr("before | shiftleft(1, f)"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, f)"))
    survivors = lambda j, p: _signed(j, n, f"s & ~{p} = 0", "1")
    lost = lambda j: survivors(j, "before") - survivors(j, "after")
    rows = rows.withColumn("kept", survivors("j0", "after")).withColumn("removed", lost("j0"))
    of_f = "s & bit <> 0"
    name = F.array_join(F.transform("ord", lambda k: F.element_at(F.array(*map(F.lit, names)), k + 1)), "")
    out = rows.select(
        "part", name.alias("filter_order"), "step", "kept", "removed", (F.expr("j0[bit]") - F.col("removed")).alias("redundant"), _signed("j0", n, of_f, "-1").alias("unique_fails"),
        *(lost(f"j{i + 1}").alias(f"{o}_lost") for i, o in enumerate(outcomes)), _signed("j0", n, of_f, f"-(({factorial(n)}L) div greatest(1, bit_count(s)))").alias("shapley"),
    )
    return scratch.keep(out)


def text_filters(text: str = "text") -> dict[str, Column]:
    """Too few words, too few distinct words, too many capitals, a sign of markup."""
    x = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(x) - F.length(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), "C": 100 * capitals > 10 * F.length(x), "D": x.rlike("[#$%&*|]")}


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return interactions(docs, labels, text_filters(), copies="E", outcomes={"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


ORACLE = r"""
WITH x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM x),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS f,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN lab USING (doc_id)),
p AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, k AS step, o[k] AS me, o[1:k - 1] AS prior FROM o, l),
h AS (SELECT part, o, step, me, n, good, toxic, f[me] AS fails, len(list_filter(prior, lambda q: f[q])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS fails_n FROM p, s),
r AS (SELECT part, o, step, me, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (fails AND fails_n = 1) AS unique_fails,
    sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost FROM h GROUP BY part, o, step, me)
SELECT part, array_to_string(list_transform(o, lambda q: chr((64 + q)::INT)), '') AS filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
    coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, me))::BIGINT AS shapley FROM r
"""
