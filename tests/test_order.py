"""What depends on order, against versions that take one row after another."""

import random
import time
from collections import OrderedDict, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.operators import linking, scans
from textloom.shared import Tables
from textloom.streaming import limits


def cache_of(requests, most, seconds):
    held, out = OrderedDict(), []
    for _, t, k in requests:
        hit = k in held and t - held[k] < seconds
        if hit:
            held.move_to_end(k)
        else:
            held.pop(k, None)
            if len(held) >= most:
                held.popitem(last=False)
            held[k] = t
        out.append(hit)
    return out


@pytest.mark.parametrize(("keys", "most", "seconds", "rows"), [(5, 3, 40, 1000), (40, 12, 300, 37), (3, 500, 17, 50), (60, 1, 1000, 64)])
def test_cache_against_an_ordered_dictionary(spark, keys, most, seconds, rows):
    """Hot keys, several requests at one time, gaps, blocks of few rows."""
    draw, t, requests = random.Random(keys), 0, []
    for k in range(600):
        t += draw.choice([0, 1, 2, 5, 9, 200 if k % 97 == 0 else 3])
        requests.append((k, t, "hot" if draw.random() < 0.33 else f"k{draw.randrange(keys)}"))
    df = spark.createDataFrame(draw.sample(requests, 600), "id long, t long, k string").withColumn("at", F.timestamp_seconds("t"))
    got = {r.id: r.hit for r in scans.cached(df, "k", "at", ["at", "id"], Tables(spark, "test"), most, seconds, rows).collect()}
    want = cache_of(requests, most, seconds)
    assert [got[k] for k in range(600)] == want and (any(want) or most == 1)


def test_cache_of_nothing(spark):
    df = spark.createDataFrame([], "id long, k string, at timestamp")
    assert scans.cached(df, "k", "at", ["at", "id"], Tables(spark, "test")).count() == 0
    one = spark.createDataFrame([(1, None), (2, None)], "id long, k string").withColumn("at", F.timestamp_seconds("id"))
    assert {r.id: r.hit for r in scans.cached(one, "k", "at", ["at", "id"], Tables(spark, "test")).collect()} == {1: False, 2: True}


def test_running_sums_over_blocks(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "a", "a", "b", None]), k, draw.choice([None, 1, 2, 5])) for k in range(500)]
    df = spark.createDataFrame(rows, "day string, id long, v long").repartition(3)
    got = {r.id: (r.total, r.n) for r in scans.running_sums(df, ["day"], ["id"], {"total": F.col("v"), "n": F.lit(1)}, Tables(spark, "test"), rows=40).collect()}
    sums, want = defaultdict(lambda: [0, 0]), {}
    for d, k, v in rows:
        sums[d][0] += v or 0
        sums[d][1] += 1
        want[k] = tuple(sums[d])
    assert got == want
    assert scans.running_sums(df.where("false"), ["day"], ["id"], {"n": F.lit(1)}, Tables(spark, "test")).count() == 0


def test_budget_against_one_after_another(spark):
    draw = random.Random(7)
    rows = [(k % 3, k, draw.choice(["first", "second", "third", "none"]), draw.choice([0.25, 0.5, 2.0])) for k in range(400)] + [(None, 400, "first", 0.25)]
    df = spark.createDataFrame(rows, "day long, id long, who string, c double")
    order, can = ["first", "second", "third"], lambda w: order[min(order.index(w), 2) :] if w in order else []
    providers = [(p, F.col("who").isin(*order[: k + 1]), F.col("c").cast("decimal(18,6)") / (k + 1)) for k, p in enumerate(order)]
    got = {r.id: (r.provider, round(float(r.spent), 4), r.admitted) for r in scans.chain_of_providers(df, providers, "day", ["id"], 20.0, Tables(spark, "test"), rows=30).collect()}
    spent, want = defaultdict(float), {}
    for d, k, who, c in rows:
        by = can(who)[0] if can(who) else None
        if spent[d] >= 20:
            want[k] = (None, round(spent[d], 4), False)
            continue
        want[k] = (by, round(spent[d], 4), True)
        spent[d] += c / (order.index(by) + 1) if by else 0
    assert {k: (p, pytest.approx(s, abs=0.01), a) for k, (p, s, a) in want.items()} == got and sum(not a for _, _, a in want.values()) > 50


def limited_one_by_one(rows, lim):
    out, short, long = {}, {}, {}
    for u, i, t in sorted(rows, key=lambda x: (x[2], x[1])):
        short[u], long[u], by, wait = lim.ask(short.get(u), long.get(u), float(t))
        out[i] = (by, round(wait, 6))
    return out


def test_limits_of_one_key():
    lim = limits.Limits(limits.Bucket(2, 1.0), limits.Bucket(3, 0.1))
    asked = limited_one_by_one([(1, k, t) for k, t in enumerate([0, 0, 0, 1, 1.5, 3, 40])], lim)
    assert [asked[k][0] for k in range(7)] == ["", "", "short", "", "short", "long", ""]
    assert asked[2][1] == 1.0 and asked[5][1] == pytest.approx((1 - 0.3) / 0.1)  # the long bucket has regained 0.3
    assert lim.idle == 30 and limits.Limits.per() == limits.Limits(limits.Bucket(10, 1.0), limits.Bucket(1000, 1000 / 3600))


def test_stream_limits_and_their_state(spark, tmp_path):
    """As one by one over several batches, and keys that are quiet for long are forgotten."""
    draw, t, rows = random.Random(9), 1_700_000_000, []
    for k in range(400):
        t += draw.choice([0, 1, 2, 30])
        rows.append((draw.randrange(6) if k < 300 else 99, k, t))
    for b in range(4):
        spark.createDataFrame(rows[100 * b : 100 * b + 100], "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # the order of files is that of their times
    lim = limits.Limits(limits.Bucket(2, 0.2), limits.Bucket(5, 0.05))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    got = {r.event_id: (r.refused_by, round(r.retry_after, 6)) for r in limits.run_limited(stream, lim).collect()}
    assert got == limited_one_by_one(rows, lim) and {"", "short", "long"} == {by for by, _ in got.values()}
    with limits.with_conf(spark, **{limits._PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        q = limits.limited(stream, lim).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        rows_held = q.recentProgress[-1].stateOperators[0].numRowsTotal
    assert rows_held <= 8, "two variables and timers of the one key that still asks"


def test_first_arrivals_with_bounded_state(spark, tmp_path):
    """A key that comes again long after the watermark is still known, by the stored keys; the stream's state forgets it."""
    for b in range(5):
        rows = [(k, 1_700_000_000 + 86_400 * b + k, b) for k in range(50 * b // 2, 50 * b // 2 + 50)] + [(7, 1_700_000_000 + 86_400 * b, b), (None, 1_700_000_000 + 86_400 * b, b)]
        spark.createDataFrame(rows, "k long, t long, b int").select("k", "b", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("k long, b int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    limits.first_arrivals(stream, ["k"], str(tmp_path / "out"), buckets=4)
    got = [(r.k, r.b) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()]
    want = {}
    for b in range(5):
        for k in [*range(50 * b // 2, 50 * b // 2 + 50), 7, None]:
            want.setdefault(k, b)
    assert sorted(got, key=str) == sorted(want.items(), key=str)


def test_links_against_a_pattern_for_each_name():
    import re

    def plain(body, names):
        left, out, code, front = sorted(dict(names).items(), key=lambda x: (-len(x[0]), x[0])), [], False, False
        for line in body.split("\n"):
            mark = line.strip()
            if mark.startswith("```") or mark == "---":
                code, front = code ^ mark.startswith("```"), front ^ (mark == "---")
            elif not code and not front and "[[" not in line:
                taken = []
                for name, target in list(left):
                    free = (m for m in re.finditer(rf"\b{re.escape(name)}\b", line, re.IGNORECASE) if not any(s < m.end() and m.start() < e for s, e, _ in taken))
                    if m := next(free, None):
                        taken.append((m.start(), m.end(), f"[[{target}|{name}]]"))
                        left.remove((name, target))
                for s, e, link in sorted(taken, reverse=True):
                    line = line[:s] + link + line[e:]
            out.append(line)
        return "\n".join(out)

    draw = random.Random(11)
    parts = ["anna", "Anna Weber", "weber", "C++", "c", "ÄPFEL", "äpfel", "x_y", "y", "(a)", "ab ab", "---", "```", "[[z]]", "-", ",", "Weber-Anna"]
    for _ in range(300):
        body = "\n".join(" ".join(draw.choices(parts, k=draw.randint(0, 8))) for _ in range(draw.randint(1, 6)))
        names = [(n, f"r/{k}") for k, n in enumerate(draw.sample([*parts[:11], "ab", "a", "b ab"], draw.randint(0, 9)))]
        assert linking.linked(body, names) == plain(body, names)


def test_links_are_fast():
    names = [(f"Name{k} Of{k}", f"r/{k}") for k in range(2000)]
    body = " and ".join(n for n, _ in names)
    began = time.time()
    assert linking.linked(body, names).count("[[") == 2000 and time.time() - began < 1.0


def test_links_to_shared_names(spark):
    """Names in several blocks give what one list gives."""
    draw = random.Random(12)
    names = [(f"{a}{b}", f"r/{a}{b}") for a in ("Ann", "Bo ", "Carla-", "Ö") for b in ("Weber", "weber", "X", "Meyer Holm")] + [("Weber", "w"), ("Weber", "v"), ("", "e"), (None, "n")]
    docs = [(k, "\n".join(" ".join(draw.choice([n or "and" for n, _ in names] + ["und", "---"]) for _ in range(6)) for _ in range(3))) for k in range(40)] + [(50, None), (51, ""), (52, "nothing here")] + [(60, "Weber Weber"), (61, "Weber Weber")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("k"))
    least = {}
    for n, t in names:
        if n:
            least[n] = min(t, least.get(n, t))
    want = {i: None if x is None else linking.linked(x, list(least.items())) for i, x in docs}
    for letters in (30, 1 << 20):
        out = linking.linked_by(df, spark.createDataFrame(names, "name string, target string"), letters=letters)
        assert {r.doc_id: r.linked for r in out.collect()} == want and out.columns == ["doc_id", "text", "key", "linked"]
    assert linking.linked_by(df, spark.createDataFrame([], "name string, target string")).where("not (text <=> linked)").count() == 0


def test_links_of_many_names_take_one_pass(spark):
    """names of any number are joined to the texts' runs, so that no pass over the texts is added for each million letters of names."""
    names = spark.range(400).selectExpr("concat('Name', id, repeat('x', 200)) AS name", "concat('r/', id) AS target")
    docs = spark.range(50).selectExpr("id AS doc_id", "concat('see Name', id, repeat('x', 200), ' and, Name', id + 1, repeat('x', 200)) AS text")
    tracker = spark.sparkContext.statusTracker()

    def stages(letters):
        spark.sparkContext.setJobGroup(f"links{letters}", "")
        out = linking.linked_by(docs, names, letters=letters)
        spark.sparkContext.setJobGroup("none", "")
        assert {(r.doc_id, r.linked.count("[[r/")) for r in out.collect()} == {(k, 2) for k in range(50)}
        return len(tracker.getJobIdsForGroup(f"links{letters}"))

    assert stages(2_000) <= stages(1 << 20) + 1
    assert [x for _, _, x in linking.whole_runs("(Anna, Bo)", [1, 3])] == ["anna", ", ", "bo", "anna, bo"]
