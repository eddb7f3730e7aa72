"""What depends on order, without a task that sees all rows: running sums, a budget that runs out, a cache of the latest keys."""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom import shared
from textloom.registry import query, table

#: Rows of a block, which one task puts in order.
BLOCK_ROWS = 100_000


def ordered_blocks(df: DataFrame, order: list[str], tables: shared.Tables, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` written with a number ``block``: each block's rows stand before those of the next in ``order``. Ranges split any key, also one of most rows, if ``order`` ends in a column that differs from row to row."""
    n = max(1, -(-df.count() // rows))
    return tables.write(df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()), "blocks")


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], tables: shared.Tables, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with a running sum for each of ``sums``, over the rows of equal ``by`` up to and with the row in ``order``.

    Blocks are summed, the sums of earlier blocks are carried, and each block runs on from there: a window holds a block's
    rows, or as many rows as there are blocks. A null counts as 0.
    """
    values = {name: f"_{name}" for name in sums}
    blocks = ordered_blocks(df.withColumns({v: F.coalesce(sums[n], F.lit(0)) for n, v in values.items()}), [*by, *order], tables, rows)
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.groupBy(*by, "block").agg(*(F.sum(v).alias(v) for v in values.values()))
    carried = carried.select(*by, "block", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_before") for v in values.values()))
    within = Window.partitionBy("block", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks.withColumns({f"{v}_within": F.sum(v).over(within) for v in values.values()})
    joined = out.alias("x").join(carried.alias("c"), [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "block"]])
    return joined.select(*(F.col(f"x.{c}") for c in df.columns), *((F.col(f"c.{v}_before") + F.col(f"x.{v}_within")).alias(n) for n, v in values.items()))


def within_budget(requests: DataFrame, day: str, order: list[str], cost: Column, budget: Column | float, tables: shared.Tables, rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with ``spent`` (what the day's answered requests before it cost) and ``admitted``: whether that is under ``budget``.

    A request moves the sum from s to s + cost if s is under the budget, else it leaves it. One after another such moves
    add costs until the budget is reached and none after; as costs aren't negative, a request is admitted if and only if all
    costs before it, of admitted requests or not, are under the budget. So the order-dependent sum is a running sum, cut at
    its first value that reaches the budget.
    """
    run = running_sums(requests.withColumn("_cost", F.greatest(cost, F.lit(0))), [day], order, {"_all": F.col("_cost")}, tables, rows)
    before = F.col("_all") - F.col("_cost")
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    stop = run.where(before < limit).groupBy(F.col(day).alias("_day")).agg(F.max("_all").alias("_stop"))
    out = run.join(stop, F.col(day).eqNullSafe(F.col("_day")), "left")
    return out.select(*requests.columns, F.when(before < limit, before).otherwise(F.coalesce("_stop", F.lit(0))).alias("spent"), (before < limit).alias("admitted"))


def chain_of_providers(requests: DataFrame, providers: list[tuple[str, Column, Column]], day: str, order: list[str], budget: float, tables: shared.Tables, rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with provider, spent and admitted: an admitted request is answered by the first provider (name, whether it answers, its cost) that does; all failing costs nothing."""
    answer = F.coalesce(*(F.when(F.coalesce(can, F.lit(False)), F.struct(F.lit(name).alias("name"), cost.alias("cost"))) for name, can, cost in providers))
    out = within_budget(requests.withColumn("_by", answer), day, order, F.coalesce(F.col("_by.cost"), F.lit(0).cast("decimal(18,6)")), F.lit(budget).cast("decimal(18,6)"), tables, rows)
    return out.select(*requests.columns, F.when(F.col("admitted"), F.col("_by.name")).alias("provider"), "spent", "admitted")


def recently_used(requests: DataFrame, key: str, order: list[str], most: int, tables: shared.Tables, rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with ``position`` (1, 2, ... in order) and ``present``: whether its key is among the ``most`` distinct keys used last before it.

    A block's last keys are found by a sum; those before a block by doubling: the last ``most`` keys of two runs of blocks
    together are the last of the later and then of the earlier. A block starts with them and is replayed by itself.
    """
    one = running_sums(requests, [], order, {"position": F.lit(1).cast("long")}, tables, rows)
    one = tables.write(one.withColumn("block", ((F.col("position") - 1) / rows).cast("int")), "positions")
    latest = lambda df: df.groupBy("block", "_key").agg(F.max("position").alias("position")).withColumn("_r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc("position")))).where(F.col("_r") <= most).drop("_r")
    state, step, n = tables.write(latest(one.select("block", F.col(key).alias("_key"), "position")), "latest"), 1, (one.agg(F.max("block")).first()[0] or 0) + 1
    while step < n:
        more = tables.write(latest(state.unionByName(state.withColumn("block", F.col("block") + step).where(F.col("block") < n))), "latest")
        tables.drop(state)
        state, step = more, 2 * step
    start = state.select((F.col("block") + 1).alias("block"), F.col("_key").cast("string").alias("_key"), "position", F.lit(False).alias("real")).where(F.col("block") < n)
    rows_ = one.select("block", F.col(key).cast("string").alias("_key"), "position", F.lit(True).alias("real")).unionByName(start)

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, held, out = pdf.sort_values("position"), OrderedDict(), []
        for k, real in zip(pdf["_key"], pdf["real"], strict=True):
            present = k in held
            held[k] = None
            held.move_to_end(k)
            if len(held) > most:
                held.popitem(last=False)
            if real:
                out.append(present)
        return pd.DataFrame({"position": pdf.loc[pdf["real"], "position"].to_numpy(), "present": out})

    flags = rows_.groupBy("block").applyInPandas(replay, "position long, present boolean")
    return one.drop("block").join(flags, "position")


def cached(requests: DataFrame, key: str, at: str, order: list[str], tables: shared.Tables, most: int = 500, seconds: int = 300, rows: int = BLOCK_ROWS) -> DataFrame:
    """``requests`` with ``hit``: whether a cache of the ``most`` keys used last has its key, stored under ``seconds`` ago.

    A miss stores the key anew, a hit only makes it the latest, so an entry's age runs from its last miss. Requests that
    miss whatever came before (the key is no longer held, or not used for ``seconds``) start chains; from a miss, the next
    is the key's first request ``seconds`` later, which lies in the next span of that length or is the first of the one
    after. Which requests the chains reach is found by doubling: no task replays a key. ``order`` must begin with ``at``.
    """
    found = recently_used(requests, key, order, most, tables, rows)
    width, t = seconds * 1_000_000, F.unix_micros(F.col(at).cast("timestamp"))
    of_key = Window.partitionBy("_k", "_span").orderBy("position")
    rows_ = tables.write(found.select("position", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), "present", t.alias("_t"), F.floor(t / width).alias("_span")), "flags")
    spans = rows_.groupBy("_k", "_span").agg(F.min("position").alias("first"), F.max("_t").alias("last_t"), F.min("_t").alias("first_t"))
    spans = tables.write(spans.withColumns({"before_t": F.lag("last_t").over(Window.partitionBy("_k").orderBy("_span")), "next_first": F.lead("first").over(Window.partitionBy("_k").orderBy("_span"))}), "spans")
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(of_key), F.col("before_t"))
    marked = rows_.join(spans.select("_k", "_span", "before_t"), ["_k", "_span"]).withColumn("sure", ~F.col("present") | F.coalesce(gap >= width, F.lit(True)))
    marked = running_sums(marked.select("position", "_k", "_span", "_t", "sure"), ["_k"], ["position"], {"_chain": F.col("sure").cast("long")}, tables, rows)
    marked = tables.write(marked, "marked")
    # A row's next miss, if it is one: the first row of its key at or after _t + width.
    probes = marked.select(F.col("position").alias("probe"), "_k", (F.col("_span") + 1).alias("_span"), (F.col("_t") + width).alias("_t"), F.lit(None).cast("long").alias("position"))
    both = marked.select(F.lit(None).cast("long").alias("probe"), "_k", "_span", "_t", "position").unionByName(probes)
    ahead = Window.partitionBy("_k", "_span").orderBy(F.desc("_t"), F.col("position").isNull(), F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    reached = both.withColumn("found", F.last("position", True).over(ahead)).where("probe is not null").select("probe", "_k", "_span", "found")
    later = spans.select("_k", (F.col("_span") - 1).alias("_span"), F.col("first").alias("after"))
    jumps = reached.join(later, ["_k", "_span"], "left").select(F.col("probe").alias("position"), F.coalesce("found", "after").alias("next"))
    sure, chain = marked.where("sure").select("position"), marked.select("position", "_chain")
    jumps = jumps.where("next is not null").join(chain, "position").join(chain.select(F.col("position").alias("next"), F.col("_chain").alias("of")), "next")
    jump = tables.write(jumps.where("of = _chain").select("position", "next"), "jump")  # a sure miss before it would start its own chain
    missed = tables.write(sure, "missed")
    while not jump.isEmpty():
        more = missed.join(jump, "position").select(F.col("next").alias("position"))
        grown = tables.write(missed.unionByName(more).distinct(), "missed")
        twice = tables.write(jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.position")).select("a.position", "b.next"), "jump")
        tables.drop(missed, jump)
        missed, jump = grown, twice
    out = found.join(missed.withColumn("_miss", F.lit(True)), "position", "left")
    return out.select(*requests.columns, F.col("_miss").isNull().alias("hit"))


_LRU = """WITH RECURSIVE e AS (SELECT event_id, ts, user_id || '/' || event_type AS k, row_number() OVER (ORDER BY ts, event_id) AS p FROM events),
q AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY p) AS before, row_number() OVER (PARTITION BY k ORDER BY p) AS n FROM e),
d AS (SELECT a.event_id, a.k, a.n, a.ts, a.before IS NOT NULL AND count(b.p) < {most} AS present FROM q a LEFT JOIN q b ON b.p > a.before AND b.p < a.p AND coalesce(b.before, 0) <= a.before GROUP BY a.event_id, a.k, a.n, a.ts, a.before),
r AS (SELECT event_id, k, n, ts AS stored, false AS hit FROM d WHERE n = 1 UNION ALL
    SELECT d.event_id, d.k, d.n, CASE WHEN d.present AND d.ts - r.stored < INTERVAL {seconds} SECOND THEN r.stored ELSE d.ts END, d.present AND d.ts - r.stored < INTERVAL {seconds} SECOND FROM r JOIN d ON d.k = r.k AND d.n = r.n + 1)
SELECT event_id, hit FROM r"""


def _events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("k"))


@query("cache_hits", _LRU.format(most=500, seconds=300))
def cache_hits(spark, sf_dir):
    """Whether a request finds an answer in a cache of 500, at most five minutes old."""
    return cached(_events(spark, sf_dir), "k", "ts", ["ts", "event_id"], shared.Tables(spark, "cache")).select("event_id", "hit")


@query("long_cache_hits", _LRU.format(most=300, seconds=4 * 86_400))
def long_cache_hits(spark, sf_dir):
    """The same with a smaller cache whose entries live four days, so that both bounds tell."""
    return cached(_events(spark, sf_dir), "k", "ts", ["ts", "event_id"], shared.Tables(spark, "cache"), 300, 4 * 86_400).select("event_id", "hit")


@query("budget_running", "SELECT event_id, ts::DATE AS day, round(sum(value) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id), 4) AS spent FROM events")
def budget_running(spark, sf_dir):
    """The day's running total at each operation."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value", F.to_date("ts").alias("day"))
    return running_sums(rows, ["day"], ["ts", "event_id"], {"spent": F.col("value")}, shared.Tables(spark, "budget")).select("event_id", "day", F.round("spent", 4).alias("spent"))


@query("provider_fallback", """WITH RECURSIVE e AS (SELECT event_id, ts::DATE AS day, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n,
    CASE WHEN event_type NOT IN ('error', 'view') THEN 'first' WHEN event_type <> 'error' AND value < 80 THEN 'second' WHEN value < 90 THEN 'third' END AS p FROM events),
c AS (SELECT *, CASE p WHEN 'first' THEN 0.03 WHEN 'second' THEN 0.01 WHEN 'third' THEN 0.002 ELSE 0 END::DECIMAL(18, 6) AS cost FROM e),
r AS (SELECT event_id, day, n, 0::DECIMAL(18, 6) AS spent, 3.0 > 0 AS admitted, p, cost FROM c WHERE n = 1 UNION ALL
    SELECT c.event_id, c.day, c.n, (r.spent + CASE WHEN r.admitted THEN r.cost ELSE 0 END)::DECIMAL(18, 6), r.spent + CASE WHEN r.admitted THEN r.cost ELSE 0 END < 3.0, c.p, c.cost FROM r JOIN c ON c.day = r.day AND c.n = r.n + 1)
SELECT event_id, CASE WHEN admitted THEN p END AS provider, spent::DOUBLE AS spent, admitted FROM r""")
def provider_fallback(spark, sf_dir):
    """Requests answered by the first provider that can, until the day's answers have cost its budget."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.to_date("ts").alias("day"))
    price = lambda x: F.lit(x).cast("decimal(18,6)")
    providers = [("first", ~F.col("event_type").isin("error", "view"), price("0.03")), ("second", F.expr("event_type <> 'error' and value < 80"), price("0.01")), ("third", F.col("value") < 90, price("0.002"))]
    return chain_of_providers(rows, providers, "day", ["ts", "event_id"], 3.0, shared.Tables(spark, "providers")).select("event_id", "provider", F.col("spent").cast("double").alias("spent"), "admitted")
