import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.conftest import CLASH
from textloom.llm import audit

LABELS = "doc_id long, quality int, toxic int, part string"
OUT = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text)]


def brute(rows, labels):
    """Applies the filters in each order, document by document."""
    place = lambda i: (i is None, i or 0)
    first, docs = {}, []
    for k, (i, text, lang) in enumerate(rows):
        first[text or ""] = min(first.get(text or "", (*place(i), lang or "", k)), (*place(i), lang or "", k))
    for k, (i, text, lang) in enumerate(rows):
        good, toxic = (max([int(x[c] == 1) for x in labels if x[0] == i and i is not None], default=0) for c in (1, 2))
        docs.append((lang or "", [*fails(text or ""), first[text or ""][-1] != k], good, toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, shapley, some = [d for d in docs if d[0] == part], Counter(), []
        for order in itertools.permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                all_, alone = sum(d[1][f] for d in mine), sum(d[1][f] and sum(d[1]) == 1 for d in mine)
                some.append(([part, "".join("ABCDE"[k] for k in order), step, len(left), len(gone), all_ - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)], f))
        out += [(*row, shapley[f]) for row, f in some]
    return sorted(out)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, x, "r", "k", "s", "src", lang, 0) for i, x, lang in rows], CLASH).withColumns({"part": F.lit("p"), "key": F.lit(1), "f0": F.lit(7), "sign": F.lit(9)})
    return audit.interactions(docs, spark.createDataFrame(labels, LABELS), audit.text_filters(), copies="E", outcomes={"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


def test_against_every_order(spark, prose):
    draw, rows = random.Random(3), []
    for k in range(150):
        text = prose(draw.choice([20, 90, 110, 200, 600]), draw.randint(0, 60))
        rows.append((k, draw.choice([text, text.upper(), text + " 5 % & more", "a b " * draw.randint(1, 90)]), draw.choice(["en", "de", None, ""])))
    rows += [(150, None, "en"), (151, "", "de"), (152, "same text", "en"), (152, "same text", "de"), (None, "same text", "en"), (None, "only here", None), (None, "only here", "fr"), (160, "É# ß" * 40, "en"), (161, "\x0b x\r\ny " * 30_000, "en")]
    labels = [(k, draw.randint(0, 1), draw.randint(0, 1), "p") for k in range(0, 165, 2)] + [(4, 1, 0, "p"), (None, 1, 1, "p"), (6, None, None, "p")]
    got = sorted(tuple(r[c] for c in OUT) for r in run(spark, rows, labels).collect())
    assert got == brute(rows, labels)


def test_order_changes_what_a_filter_removes(spark):
    """Shapley shares of two filters that fail the same documents are halves of them."""
    docs = spark.createDataFrame([(k, "x", "en") for k in range(10)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    out = audit.interactions(docs, labels, {"A": F.col("doc_id") < 6, "B": F.col("doc_id") < 6}, outcomes={"good": F.col("quality") == 1}).collect()
    assert len(out) == 4 and all((r.removed, r.redundant) == ((6, 0) if r.step == 1 else (0, 6)) and r.unique_fails == 0 and r.shapley == 6 and r.good_lost == 0 and r.kept == 4 for r in out)


def test_empty(spark):
    assert run(spark, [], []).count() == 0
