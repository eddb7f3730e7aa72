"""Names, tags, rough duplicates and vectors against plain versions."""

import hashlib
import random
from collections import Counter

import pytest

from textloom.operators import documents, entities, handlers, mutations, retrieval


def one_after_another(mentions):
    want = {}
    for kind in {k for k, _, _ in mentions}:
        seen: dict = {}
        for k, n, f in mentions:
            if k == kind and n:
                seen[n] = min(f, seen.get(n, f))
        known = []
        for n in sorted(seen, key=lambda n: (seen[n], n)):
            best = max(((round(entities.similarity(n, k), 12), -i, k) for i, k in enumerate(known)), default=(0.0, 0, n))
            if best[0] < entities.SAME:
                known.append(n)
            want[kind or "", n] = best[2] if best[0] >= entities.SAME else n
    return want


def clustered(spark, mentions):
    return {(r.kind, r.name): r.canonical for r in entities.clusters(spark.createDataFrame(mentions, "kind string, name string, first long")).collect()}


def test_clusters_against_one_after_another(spark):
    draw = random.Random(4)
    first, last = ["anna", "bo", "carla", "dieter", "eva"], ["weber", "webber", "meyer", "meier", "schmidt", "schmid", "holm"]
    names = [" ".join(filter(None, [draw.choice([*first, ""]), draw.choice(last)])) for _ in range(120)] + ["anna maria weber", "weber anna", "x", "anna", "johannasen", "joh", "an"]
    mentions = [(None if k % 10 == 0 else "person" if k % 4 else "place", n, k // 2) for k, n in enumerate(names)] + [("person", None, 1), ("person", "", 2)]
    got, want = clustered(spark, mentions), one_after_another(mentions)
    assert got == want and len(set(got.values())) < len(want) - 10


def test_clusters_of_a_chain(spark):
    """Each name is alike to the one before and after it only: every other one becomes canonical, in few rounds."""
    base = "abcdefghijklmnopqrst"
    names = [base[k % 20 :] + base[: k % 20] + "uvwxyz"[k // 20] for k in range(100)]
    assert clustered(spark, [("p", n, k) for k, n in enumerate(names)]) == one_after_another([("p", n, k) for k, n in enumerate(names)])
    chain = spark.createDataFrame([(f"{k + 1:04}", f"{k:04}") for k in range(400)], "v string, u string")
    state, rounds = entities.first_come(chain, entities.shared.Tables(spark, "test"))
    assert {(int(r.v), r.chosen) for r in state.collect()} == {(k, k % 2 == 0) for k in range(401)} and rounds <= 2


def test_first_come_on_random_edges(spark):
    draw = random.Random(3)
    edges = {(max(a, b), min(a, b)) for a, b in ((draw.randrange(300), draw.randrange(300)) for _ in range(500)) if a != b}
    want: dict = {}
    for v in range(300):
        want[v] = not any(want[u] for x, u in edges if x == v)
    state, rounds = entities.first_come(spark.createDataFrame([(f"{v:03}", f"{u:03}") for v, u in edges], "v string, u string"), entities.shared.Tables(spark, "test"))
    got = {int(r.v): r.chosen for r in state.collect()}
    assert got == {v: c for v, c in want.items() if v in got} and {x for e in edges for x in e} == set(got) and rounds < 12
    assert entities.first_come(spark.createDataFrame([], "v string, u string"), entities.shared.Tables(spark, "test"))[0].count() == 0


def test_alike_names_against_all_pairs(spark):
    """Names of 1 to 30 letters and of several words, with errors at every place, and in kinds."""
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(1, 12))) for _ in range(60)] + ["straße übel", "änne", "wörter und namen", "a", "anna", "johannasen"]
    base += [" ".join(draw.sample(base[:20], draw.randint(2, 5))) for _ in range(30)]
    names = list(dict.fromkeys(base + [b[:k] + draw.choice(["x", "", "yz"]) + b[k + 1 :] for b in base for k in [draw.randrange(len(b)), draw.randrange(len(b))]]))
    names = [n for n in names if n.strip()]
    df = spark.createDataFrame([("person", n, k) for k, n in enumerate(names)] + [("place", n, k) for k, n in enumerate(names[:9])], "kind string, name string, first long")
    for same in (0.85, 0.93):
        got = {(r.name, r.other): r.similarity for r in entities.alike(df, entities.shared.Tables(spark, "test"), same).where("kind = 'person'").collect()}
        every = {(a, b): s for i, a in enumerate(names) for b in names[:i] if (s := entities.similarity(a, b)) >= same}
        assert got == every and len(got) > 40


def test_tags_against_all_pairs(spark):
    draw = random.Random(2)
    tags = list({"/".join(draw.choice(["ai", "AI", "tech", "ml", "ml-ops", "a", "bio_tech", "project", "active"]) for _ in range(draw.randint(1, 4))) for _ in range(80)})
    low = lambda t: t.lower().replace("-", " ").replace("_", " ")

    def similar(a, b):
        a, b = low(a), low(b)
        p, q = set(a.split("/")), set(b.split("/"))
        share = len(p & q) / max(len(p), len(q))
        return 1.0 if a == b else 0.9 if a in b or b in a else round(share, 6) if round(share, 9) >= 0.7 else None

    want = set()
    for a in tags:
        some = sorted((-s, b) for b in tags if b != a and (s := similar(a, b)))
        want |= {(a, b, -s) for s, b in some[:5]}
    assert {tuple(r) for r in handlers.similar_tags(spark.createDataFrame([(t,) for t in tags], "tag string")).select("tag", "other", "similarity").collect()} == want


def test_rough_duplicates_against_all_pairs(spark):
    texts = {k: " ".join(["alpha beta gamma"] * (1 + k // 3) + ["tail"] * (k % 3)) for k in range(30)} | {100: "alpha beta gamma tail", 101: None, 102: "", 103: "a b " * 600, 104: "a b " * 630 + "a b", 105: "a b " * 700, 106: "a b " * 760}
    words = {i: len((t or "").split()) for i, t in texts.items()}
    h = {i: hashlib.md5(",".join(f"{w}:{n}" for w, n in Counter((t or "").lower().split()[:1000]).most_common(50)).encode()).hexdigest() for i, t in texts.items()}
    near = {i: {j for j in texts if j != i and h[i] == h[j] and abs(words[i] - words[j]) < 100} for i in texts}
    comp = {}
    for i in texts:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        comp[i] = min(seen)
    got = {r.doc_id: (r.fuzzy_hash, r.n_links, r.component_id) for r in documents.rough_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: (h[i], len(near[i]), comp[i]) for i in texts if near[i]}


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = retrieval.search_all(df, df.withColumnRenamed("vec_id", "query_id"), k=2, block=2).collect()
    assert {r.query_id for r in got} == {1, 4, 7} == {r.vec_id for r in got} and {(r.query_id, r.vec_id) for r in got if r["rank"] == 1} == {(1, 4), (4, 1), (7, 4)}
    assert retrieval.search_all(df, df.where("false").withColumnRenamed("vec_id", "query_id")).count() == 0


def test_an_index_is_cleared(spark, sf_dir):
    retrieval.index_of(spark, sf_dir)
    assert retrieval.clear_indexes() >= 1 and retrieval.clear_indexes() == 0
    assert retrieval.index_of(spark, sf_dir).documents == pytest.approx(200)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("least", [0.85, 0.75, 0.95])
def test_similar_titles_against_all_pairs(spark, least):
    """Titles of 3 to 60 letters with errors at every place, of few letters and of one letter: exactly the alike pairs."""
    draw = random.Random(13)
    word = lambda n: "".join(draw.choice("abcdefghijkl") for _ in range(n))
    titles = [word(draw.randint(3, 60)) for _ in range(60)] + ["ab" * k for k in range(3, 12)] + ["a" * k for k in range(5, 20)] + ["quarterlyrevenueplanoverview", "qvarterlyrevenueplanovervirw"]
    for t in titles[:60]:
        for every in (4, 7, 12):  # an error at each such place
            titles.append("".join(draw.choice(["", "z", c + "y"]) if k % every == every - 1 else c for k, c in enumerate(t)))
    titles += [titles[0].upper() + "!", "abc", None, "", "x y z!"]
    got = {(r.title_a, r.title_b): r.ratio for r in mutations.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string"), least).collect()}
    plain = sorted({"".join(c for c in (t or "").lower() if c.isalnum()) for t in titles})
    plain = [t for t in plain if len(t) > 5]
    want = {(a, b): 2 * lcs(a, b) / (len(a) + len(b)) for i, a in enumerate(plain) for b in plain[i + 1 :]}
    want = {p: r for p, r in want.items() if r >= least}
    assert got == pytest.approx(want) and len(want) > 15
    if least == 0.85:
        assert ("quarterlyrevenueplanoverview", "qvarterlyrevenueplanovervirw") in got


def test_hot_parts_are_split(spark, monkeypatch):
    """A part that most titles have goes to several blocks, and no pair is lost or found twice."""
    from textloom.operators import similar

    monkeypatch.setattr(similar, "BLOCK", 7)
    titles = [f"invoice2024{a}{b}{c}" for a in "abcdef" for b in "ghij" for c in "klmn"]
    got = [(r.title_a, r.title_b) for r in mutations.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string"), 0.92).collect()]
    want = [(a, b) for a in sorted(titles) for b in sorted(titles) if a < b and 2 * lcs(a, b) / (len(a) + len(b)) >= 0.92]
    assert sorted(got) == want and len(want) > 500


def test_near_pairs_of_short_and_long_strings(spark, monkeypatch):
    """Strings on both sides of the size from which all pairs of tiles meet, in tiles of few strings; of one table and of two."""
    from textloom.operators import similar

    monkeypatch.setattr(similar, "TILE", 16)
    draw, least = random.Random(5), 0.85
    most = similar.short_size(least)
    base = ["".join(draw.choice("abcdeéßœ😀") for _ in range(n)) for n in [*range(1, 2 * most), 70, 200]] + ["a" * 400, "a" * 350]
    strings = list(dict.fromkeys(base + [b[:k] + x + b[k + n :] for b in base for k in [draw.randrange(len(b)), draw.randrange(len(b))] for x, n in (("", 1), ("x", 0), ("y", 1), ("zz", 2), ("", 2))] + ["aéb", "baé"]))
    strings = [s for s in strings if s]
    df = spark.createDataFrame([(k % 2, s) for k in (0, 1) for s in strings[: len(strings) // (k + 1)]], "kind int, t string").repartition(3)
    alike = lambda pairs: {(r.a, r.b) for r in pairs.where("kind = 0").collect() if similar.indel_ratio(r.a, r.b) >= least}
    tables = entities.shared.Tables(spark, "test")
    every = {(a, b) for a in strings for b in strings if a != b and similar.indel_ratio(a, b) >= least}
    assert alike(similar.near_pairs(df, least, tables)) == {p for p in every if p[0] < p[1]} and len(every) > 400
    some = df.where("length(t) % 3 > 0")
    assert alike(similar.near_pairs(some, least, tables, df)) == {p for p in every if len(p[0]) % 3}


def test_long_strings_are_not_copied_for_each_tile(spark, monkeypatch):
    """What is shuffled grows with the strings, not with their number times that of tiles."""
    from textloom.operators import similar

    monkeypatch.setattr(similar, "TILE", 64)
    draw, tables = random.Random(8), entities.shared.Tables(spark, "test")
    base = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(1000)]
    strings = base + [t[:20] + "#" + t[21:] for t in base]
    df = spark.createDataFrame([(0, t) for t in strings], "kind int, t string")
    written = lambda: (lambda x: sum(x.apply(k).totalShuffleWrite() for k in range(x.length())))(spark.sparkContext._jsc.sc().statusStore().executorList(True))
    before = written()
    pairs = {(r.a, r.b) for r in similar.near_pairs(df, 0.85, tables).collect()}
    assert {tuple(sorted(p)) for p in zip(base, strings[1000:], strict=True)} <= pairs
    assert written() - before < 10 * sum(map(len, strings))


def test_short_strings_meet_in_rests_only(spark):
    """Words of one small alphabet have common parts throughout: the join makes few pairs besides those alike. It made nearly all before."""
    from textloom.operators import similar

    draw = random.Random(6)
    words = list({"".join(draw.choice(["th", "en", "lich", "ti", "on", "er"]) for _ in range(4)) for _ in range(600)})
    words = [w for w in words if len(w) <= similar.short_size(0.85)]
    pairs = similar.near_pairs(spark.createDataFrame([(0, w) for w in words], "kind int, t string"), 0.85, entities.shared.Tables(spark, "test")).collect()
    assert len(words) > 300 and pairs and all(similar.indel_ratio(r.a, r.b) >= 0.85 for r in pairs)


def test_vectors_in_small_blocks(spark, monkeypatch):
    """What a task holds against the queries is bounded, not the batch that it gets; ties at the k-th place go by number across blocks."""
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 3)
    draw = random.Random(9)
    rows = [(k, [float(draw.randint(-2, 2)) for _ in range(3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got: dict = {}
    for r in retrieval.search_all(df, df.withColumnRenamed("vec_id", "query_id"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 9)
    some = [(k, v) for k, v in rows if any(v)]
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [j for _, j in sorted((-cosine(v, w), j) for j, w in some if j != q)[:5]] for q, v in some}
