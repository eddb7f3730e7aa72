from collections import Counter

from tests.llm.conftest import CLASH
from textloom.llm import lines
from textloom.llm.scratch import Scratch


def brute(rows, ratio, least):
    total, pages = Counter(h for _, _, h in rows if h is not None), Counter()
    for _, x, h in rows:
        if h is not None and x is not None:
            pages.update({(h, line.strip(" ")) for line in x.split("\n") if line.strip(" ")})
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for i, x, h in rows:
        if x is None:
            out.append((i, None, 0, 0))
            continue
        all_ = x.split("\n")
        kept = [line for line in all_ if (h, line.strip(" ")) not in bad]
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return out


def test_against_counts(spark):
    rows = [(k, f"menu\nline {k}\n\n  menu \nfooter {k % 7}\nfooter {k % 7}", "big" if k % 2 else "small") for k in range(80)]
    rows += [(100, None, "big"), (101, "", "big"), (102, "menu", None), (103, "\n\n", "big"), (104, "menu", "tiny"), (105, "menu\nmenu", "tiny"), (None, "menu\nx", "big"), (100, "menu\r\ny", "big"), (106, "long " * 20_000 + "\nmenu", "big")]
    df = spark.createDataFrame([(i, x, "r", "k", "s", h, "en", 0) for i, x, h in rows], CLASH)
    got = lines.drop_boilerplate(df, Scratch(spark, "test"), ratio=0.12, least=3).select("row.doc_id", "kept", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 0.12, 3), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], CLASH)
    assert lines.drop_boilerplate(df, Scratch(spark, "test")).count() == 0
