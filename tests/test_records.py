"""Profiles, duplicates, vocabularies and handlers against plain versions."""

import datetime
import difflib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from textloom.operators import cascade, documents, profiles, similar, vocabulary
from textloom.plans import dispatch
from textloom.shared import Tables


def test_profiles_against_loops(spark):
    draw = random.Random(5)
    people, firms, places = [f"P{k}" for k in range(40)], [f"Firm {k}" for k in range(30)], ["Ulm", "Bonn"]
    rows = []
    for k in range(300):
        some = ["Hub", *draw.sample(people, draw.randint(0, 5))] if draw.random() < 0.8 else draw.sample(people, 2)
        sender = draw.choice([None, f"{some[0]} <{some[0].lower()}@x.org>", "no address P1", "p2 and hub: a.b@c.de"])
        roles = [(draw.choice([*some, "Other"]), draw.choice(["lead", "", "editor"]))]
        rows.append((k, None if k % 50 == 0 else datetime.date(2024, 1, 1) + datetime.timedelta(draw.randrange(300)), sender, [*some, " ", "x", None, some[0] + " "], roles, draw.sample(firms, draw.randint(0, 3)), draw.sample(places, draw.randint(0, 2))))
    rows.append((300, None, None, None, None, None, None))
    df = spark.createDataFrame(rows, profiles.RECORD)
    got = {(r.kind, r.name): r for r in profiles.profiles(df, listed=4, linked=6).collect()}
    docs, links = defaultdict(list), defaultdict(Counter)
    for i, at, sender, p, roles, o, w in rows:
        p, o, w = ({x.strip() for x in y or [] if x and len(x.strip()) >= 2} for y in (p, o, w))
        for kind, names in (("person", p), ("organisation", o), ("place", w)):
            for n in names:
                docs[kind, n].append((at is None, at or datetime.date.min, i, at))
        for a in p:
            links["person", a, "organisations"].update(o)
            for n, r in set(roles or []):
                if n == a and r:
                    links["person", a, "roles"][r] += 1
            mail = re.search(r"[\w.+-]+@[\w-]+\.[\w.-]+", sender or "")
            if mail and a.lower() in sender.lower():
                links["person", a, "emails"][mail[0]] += 1
        for a in o:
            links["organisation", a, "people"].update(p)
            links["organisation", a, "locations"].update(w)
        for a in w:
            links["place", a, "people"].update(p)
            links["place", a, "organisations"].update(o)
    assert set(got) == set(docs)
    for key, seen in docs.items():
        r, dates = got[key], [x[3] for x in seen if x[3]]
        assert (r.documents, r.first_seen, r.last_seen) == (len(seen), min(dates, default=None), max(dates, default=None)) and list(r["sample"]) == [x[2] for x in sorted(seen)[:4]]
        for link in profiles.LINKS:
            assert list(r[link]) == [n for n, _ in sorted(links[*key, link].items(), key=lambda x: (-x[1], x[0]))[:6]]
    assert profiles.profiles(df.where("false")).count() == 0


def test_cascade_against_one_after_another(spark):
    draw, words = random.Random(6), [f"w{k}" for k in range(50)]
    texts = [" ".join(draw.choices(words, k=30)) for _ in range(20)]
    rows = []
    for k in range(120):
        body = draw.choice([*texts, texts[k % 20] + " ", " ".join(draw.choices(words, k=25))])
        name = draw.choice(["Report of the year 2024", "Rep0rt of the year 2024", "Annual budget plan", "Annual budget plans!", f"Thing number {k} here", "short", None])
        rows.append((k, body, name, "d", None, ["n"]))
    rows += [(200, "long " * 1500, "A", "d", None, None), (201, "long " * 1550, "B", "d", None, None), (202, "long " * 1700, "C", "d", None, None), (203, None, "same title here", None, None, None), (204, "", "other title there", None, None, None), (None, "x", "same title here", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, domain string, created_at date, names array<string>")
    prints = cascade.fingerprints(df)
    p = {r.doc_id: r for r in prints.where("doc_id is not null").collect()}
    got = {r.doc_id: (r.duplicate_of, r.score and round(r.score, 6), r.reason) for r in cascade.duplicates(prints).collect()}
    want, left = {None: (None, None, None)}, []
    for i in sorted(p):
        same = min(j for j in p if p[j].content_hash == p[i].content_hash)
        if same < i:
            want[i] = (same, 1.0, "exact_content_hash")
        else:
            left.append(i)
    after = []
    for i in left:
        near = min(j for j in left if p[j].fuzzy_hash == p[i].fuzzy_hash and abs(p[j].word_count - p[i].word_count) < 100)
        if near < i:
            want[i] = (near, 0.9, "fuzzy_hash_match")
        else:
            after.append(i)
    least = {}
    for i in after:
        least[p[i].title_normalized] = min(i, least.get(p[i].title_normalized, i))
    for i in after:
        t = p[i].title_normalized
        best = sorted((-round(r, 9), j) for u, j in least.items() if len(t) > 5 and len(u) > 5 and j < i and (r := similar.indel_ratio(t, u)) >= 0.85)
        want[i] = (best[0][1], round(-best[0][0], 6), "title_similarity") if best else (None, None, None)
    assert got == want and {r for _, _, r in want.values()} == {None, "exact_content_hash", "fuzzy_hash_match", "title_similarity"}
    assert want[201][2] == "fuzzy_hash_match" and want[202][2] is None, "more than 100 words apart"
    assert documents.WORDS_APART == cascade.WORDS and len(prints.columns) == 8


def test_nearest_terms_against_all_terms(spark):
    draw = random.Random(7)
    terms = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 10))) for _ in range(60)]
    values = [t[:k] + draw.choice("xyz") + t[k + draw.randint(0, 1) :] for t in terms for k in [draw.randrange(len(t) + 1)]] + ["zzzz", "q", "äöü"]
    got = {r.value: (r.term, round(r.similarity, 9)) for r in vocabulary.nearest(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(t,) for t in terms], "term string"), Tables(spark, "test"), block=7).collect()}
    want = {}
    for v in set(values):
        some = [(round(difflib.SequenceMatcher(None, t, v).ratio(), 9), t) for t in set(terms) if t != v]
        best = max((x for x in some if x[0] >= 0.6), default=None)
        if best:
            want[v] = best[::-1]
    assert got == want and len(want) > 40


def test_near_terms_are_looked_for_closest_first(spark, monkeypatch):
    """Words with a very near term don't meet the many terms that are less near; the results are those of all terms."""
    calls, whole = [], similar.near_pairs
    monkeypatch.setattr(similar, "near_pairs", lambda values, least, *more: calls.append((least, {r.t for r in values.collect()})) or whole(values, least, *more))
    draw = random.Random(9)
    terms = ["".join(draw.choice("aeinrst") for _ in range(12)) for _ in range(40)] + ["ab" * 40, "äöü" * 30, "e" * 300]
    near, far = [t[:5] + "x" + t[6:] for t in terms], [t[:3] + "xyz" + t[6:] for t in terms[:40]] + ["q" * 12, "e" * 299]
    got = {r.value: (r.term, round(r.similarity, 9)) for r in vocabulary.nearest(spark.createDataFrame([(v,) for v in near + far], "value string"), spark.createDataFrame([(t,) for t in terms], "term string"), Tables(spark, "test"), block=16).collect()}
    want = {v: max((round(difflib.SequenceMatcher(None, t, v).ratio(), 9), t) for t in terms)[::-1] for v in {*near, *far}}
    assert got == {v: x for v, x in want.items() if x[1] >= 0.6}
    assert [c for c, _ in calls] == sorted({c for c, _ in calls}, reverse=True) and len(calls) > 1
    assert set(near) <= calls[0][1] and not set(near[:-1]) & calls[-1][1] and {"q" * 12, far[0]} <= calls[-1][1]


def test_values_are_sorted_out(spark):
    df = spark.createDataFrame([(1, ["View ", "clik", "zzz", None, "", "CLIK"]), (2, None), (3, []), (4, ["order"])], "doc_id long, values array<string>")
    out = {r.doc_id: (r.valid, [tuple(x) for x in r.replaced], r.suggested) for r in vocabulary.sorted_out(df, spark.createDataFrame([("view",), ("Click",), (None,), ("order",)], "term string")).collect()}
    assert out == {1: (["view"], [("clik", "click")], ["zzz"]), 2: ([], [], []), 3: ([], [], []), 4: (["order"], [], [])}


def test_dispatch_by_kind(spark):
    rows = [(1, "email", "Hello\n\n\n\nend  \n--\nAnn"), (2, "llm_chat", "User: hi?\nAssistant: use Python\n\n\n\nI hope this helps!"), (3, "invoice", "Invoice No. A-17\nTotal EUR 12,50"), (4, "manual", "Table of Contents\nOne ........ 1\n\nText"), (5, "note", "as  it is"), (6, None, "x"), (7, "email", None), (8, "email", "--\nall of it is a signature, and more of it")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, text string")
    got = {r.doc_id: r for r in dispatch.default_registry()(df).collect()}
    assert got[1].text == "Hello\n\nend" and got[1].handler_applied == "email" and got[1].retained < 1
    assert got[2].handler_applied == "chat_log" and "hope" not in got[2].text and '"questions":true' in got[2].details
    assert got[3].handler_applied == "invoice" and '"total":12.5' in got[3].details and got[4].text == "Text"
    assert [(got[k].text, got[k].handler_applied) for k in (5, 6, 7)] == [("as  it is", None), ("x", None), (None, None)]
    assert got[8].text == rows[7][2] and got[8].handler_applied == "email", "too little was left, so that the text stays"
    shout = dispatch.Registry().register("note", dispatch.Handler("shout", F.upper, lambda c: F.struct(F.length(c).alias("n"))))
    assert [(r.text, r.details) for r in shout(df).where("doc_id = 5").collect()] == [("AS  IT IS", '{"n":9}')]


def test_names_are_resolved(spark):
    from textloom.operators import entities

    known = spark.createDataFrame([(1, "Anna Weber", ["Anna", "A. Weber"]), (2, "Anna Meyer", ["Anna", None]), (3, "Bo", None)], "place int, canonical string, aliases array<string>")
    names = spark.createDataFrame([("Anna",), ("A. Weber",), ("Anna Meyer",), ("Bo",), ("bo",), (None,), ("Anna",)], "name string")
    got = {r.original: (r.name, r.resolved, r.kb_entry) for r in entities.resolved(names, known).collect()}
    assert got == {"Anna": ("Anna Weber", True, True), "A. Weber": ("Anna Weber", True, True), "Anna Meyer": ("Anna Meyer", False, True), "Bo": ("Bo", False, True), "bo": ("bo", False, False)}


def test_scan_quality_and_critic(spark):
    from textloom.operators import handlers

    df = spark.createDataFrame([(1, "good plain words here"), (2, "a b c d"), (3, ""), (4, "~~ ok"), (5, "abcdefghijklmnopqrstu word || _____"), (6, "wort_mit_über_zwanzig_zeichen ok ok ok")], "doc_id long, text string")
    got = {r.doc_id: round(r.q, 6) for r in df.select("doc_id", handlers.scan_quality(F.col("text")).alias("q")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.75}
    none = F.lit(None).cast("string")
    empty = {"title": none, "summary": none, "topics": F.array().cast("array<string>"), "names": F.array().cast("array<string>"), "dates": F.array().cast("array<string>")}
    whole = {"title": F.lit("A title"), "summary": F.lit("short"), "topics": F.array(F.lit("words"), F.lit("none")), "names": F.array(F.lit("Ann")), "dates": F.array(F.lit("2024-01-01"))}
    body = F.lit("some words of 2024-01-01\n\nand more of them in a longer text")
    scores = lambda record: [float(x) for x in spark.range(1).select(F.array(*documents.rubric_scores(body, record)).alias("s")).first().s]
    assert scores(empty) == [0, 0, 0, 0, 1, 5, 2] and scores(whole) == [5, 5, 2, 5, 5, 5, 2]
