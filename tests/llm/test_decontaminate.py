import random
import re

from tests.llm.conftest import make_docs
from textloom.llm import decontaminate
from textloom.llm.toxicity import words_of

ITEMS = "item_id long, text string, row string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def brute(text, items, window):
    w = words(text)
    hit, found = [False] * len(w), set()
    for i, x in items:
        b = words(x)
        for win in {tuple(b[k : k + window]) for k in range(max(1, len(b) - window + 1))} if b else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit[k : k + len(win)] = [True] * len(win)
                    found.add("null" if i is None else str(i))
    n = sum(hit)
    return len(w), n, sorted(found), n > 0 and 20 * n >= len(w)


def test_against_every_window(spark, prose):
    draw = random.Random(7)
    items = [(k, prose(draw.randint(1, 40), 900 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "Élan VITAL 42"), (3, "second text of item three"), (None, "no name here"), (53, "the the the the the the the the the the the the the the")]
    texts = []
    for k in range(40):
        x = prose(draw.randint(0, 120), k)
        if k % 2:
            s = items[draw.randrange(12)][1].split()
            a = draw.randrange(len(s))
            x = x + " " + ("; ".join(s[a : a + draw.randint(1, 30)])).upper() + " " + prose(draw.choice([5, 500]), k + 200)
        texts.append(x)
    pairs = [*enumerate(texts + [None, "", "...", "élan vital 42", "the " * 40, "x élan-VITAL_42 y no NAME here"]), (None, items[3][1]), (0, items[2][1]), (0, items[2][1])]
    # the rule lower-cases A-Z only, so that the capital É of an item isn't the small one of a text
    bench = spark.createDataFrame([(*i, "r") for i in items], ITEMS)
    for shingle in (5, 1, 13):
        out = decontaminate.contamination(make_docs(spark, pairs), bench, shingle=shingle)
        got = sorted(((r.row.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in out.collect()), key=str)
        assert got == sorted(((i, *brute(x, items, 13)) for i, x in pairs), key=str)


def test_empty(spark):
    bench = spark.createDataFrame([], ITEMS)
    out = decontaminate.contamination(make_docs(spark, [(1, "a b"), (2, None)]), bench)
    assert sorted((r.row.doc_id, r.n_words, r.n_hit, r.contaminated) for r in out.collect()) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.contamination(make_docs(spark, []), spark.createDataFrame([(1, "a", "r")], ITEMS)).count() == 0


def test_prefix_is_the_rarest_shingle(spark):
    from textloom.llm.scratch import Scratch

    docs = make_docs(spark, [(1, "a b c d e"), (2, "a b c d e x"), (3, "b c d e f"), (4, "q b c d e f q b c d e f"), (5, "c d e f g")])
    bench = spark.createDataFrame([(1, "A b c d e f g", "r"), (2, "x y", "r"), (3, "a b c d e f g", "r")], ITEMS)
    owners, chosen, lengths = decontaminate.prefixes(bench, docs, Scratch(spark, "decontaminate"))
    assert sorted((r.n, r.words, r.offset) for r in chosen.collect()) == [(2, "x y", 0), (7, "a b c d e f g", 2)] and lengths == (2, 5)
    assert sorted(r["item"] for r in owners.collect()) == ["1", "2", "3"]


def test_words_against_split():
    draw = random.Random(3)
    texts = [None, b"", b" ", "Été naïve_x 42".encode(), *(" ".join("".join(draw.choice("abZ9é, ") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 60))).encode() for _ in range(50)), b"x" * 300, b"same same"]
    for piece in (16, 100, 1 << 20):
        old, decontaminate._PIECE = decontaminate._PIECE, piece
        try:
            w = decontaminate.Words(texts)
        finally:
            decontaminate._PIECE = old
        want = [words_of(x) for x in texts]
        got = [[w.raw[w.start[k] : w.end[k]] for k in range(w.first[t], w.first[t + 1])] for t in range(len(texts))]
        assert got == want
        by: dict = {}
        for k in range(len(w.hash)):
            by.setdefault(w.raw[w.start[k] : w.end[k]], set()).add(int(w.hash[k]))
        assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
        for n in (1, 2, 5):
            p, h = w.shingles(n)
            assert len(p) == sum(max(0, len(x) - n + 1) for x in want) and len(set(h.tolist())) == len({tuple(x[k : k + n]) for x in want for k in range(len(x) - n + 1)})


def test_hot_passage(spark, prose):
    """One passage in most texts, many times in some."""
    item = prose(30, 7777)
    pairs = [(k, f"{prose(20, k)} {item} {prose(30, 1000 + k)}" if k % 3 else prose(20, k)) for k in range(300)] + [(1000, f"{item} " * 500)]
    got = {r.row.doc_id: (r.n_hit, r.contaminated) for r in decontaminate.contamination(make_docs(spark, pairs), spark.createDataFrame([(1, item, "r")], ITEMS)).collect()}
    assert all(got[k] == ((30, True) if k % 3 else (0, False)) for k in range(300)) and got[1000] == (15_000, True)
