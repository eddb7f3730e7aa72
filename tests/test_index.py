"""An index that changes, against a plain BM25 of the documents that are live."""

import math
import random
import re
from collections import Counter

import pytest

from textloom.operators import retrieval, segments


def plain(docs, asked):
    words = {i: re.findall(r"[^\W]+", (t or "").lower()) for i, t in docs.items()}
    n, length = len(words), sum(map(len, words.values())) / max(1, len(words))
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    score = {i: sum(idf.get(q, 0) * (tf := ws.count(q)) * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / length)) for q in asked) for i, ws in words.items() if ws}
    return df, idf, sorted(((round(-s, 9), i) for i, s in score.items() if s > 0))


def test_changes_against_plain_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FANOUT", 2)
    draw, live = random.Random(21), {}
    text = lambda: " ".join(draw.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta", "common", "common"], k=draw.randint(0, 12)))
    index = segments.Segments(spark, str(tmp_path / "index"))
    assert index.manifest() == segments.Manifest() and index.terms().count() == 0 and retrieval.opened(index).search(("alpha",)).count() == 0
    merged = False
    for step in range(7):
        if step % 3 == 2:
            gone = draw.sample(sorted(live), min(6, len(live))) + [999, None]
            index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            for i in gone:
                live.pop(i, None)
        else:
            new = {draw.randrange(40): draw.choice([text(), text(), None]) for _ in range(draw.randint(3, 15))}
            index.add(spark.createDataFrame([*new.items(), (None, "alpha alone")], "doc_id long, text string"))
            live |= new
        m = index.manifest()
        merged |= len(m.segments) < step
        df, idf, ranked = plain(live, ("alpha", "common", "alpha", "none"))
        assert m.documents == len(live) and {r.term: (r.df, round(r.idf, 9)) for r in index.terms(m).collect()} == {w: (c, round(idf[w], 9)) for w, c in df.items()}
        got = retrieval.opened(index).search(("alpha", "common", "alpha", "none"), 100).collect()
        assert sorted((round(-r.score, 9), r.doc_id) for r in got) == [(round(s, 9), i) for s, i in ranked]
    assert merged and index.vacuum() > 0 and index.vacuum() == 0
    assert sorted((round(-r.score, 9), r.doc_id) for r in retrieval.opened(index).search(("alpha", "common", "alpha", "none"), 100).collect()) == [(round(s, 9), i) for s, i in ranked]


def test_a_reader_keeps_its_manifest_and_writers_do_not_overwrite(spark, tmp_path):
    index = segments.Segments(spark, str(tmp_path / "index"))
    index.add(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string"))
    before = retrieval.opened(index)
    old = index.manifest()
    index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert {r.doc_id for r in before.postings.collect()} == {1, 2} and {r.doc_id for r in retrieval.opened(index).postings.collect()} == {2}
    assert index.manifest(old.number) == old
    old.number += 1  # a second writer that began from the same manifest
    with pytest.raises(RuntimeError):
        index._commit(old)
    assert index.manifest().documents == 1


def test_size_classes():
    assert segments._crowded([[1, 1, 5], [2, 2, 6], [3, 3, 7]]) == [] and len(segments._crowded([[k, k, 5] for k in range(4)] + [[9, 9, 1000]])) == 4


def test_a_changed_folder_is_indexed_anew(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    write([(1, "one two")])
    assert retrieval.index_of(spark, str(tmp_path)).documents == 1 and retrieval.index_of(spark, str(tmp_path)) is retrieval.index_of(spark, str(tmp_path))
    write([(1, "one two"), (2, "three")])
    assert retrieval.index_of(spark, str(tmp_path)).documents == 2
    retrieval.clear_indexes()


def test_documents_are_counted_where_they_are(spark):
    """A document's words are counted without a shuffle; only repeated documents are shuffled with their texts."""
    from textloom.operators import segments

    words = [(1, ["a", "b", "a"]), (2, []), (3, ["b"])] + [(k, ["x"] * k) for k in range(10, 600)]
    df = spark.createDataFrame(words, "doc_id long, words array<string>").coalesce(1).mapInArrow(segments.counted, segments.Segments.POSTINGS)
    got = sorted((r.term, r.doc_id, r.tf, r.dl) for r in df.collect())
    assert got == sorted([("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 3, 1, 1)] + [("x", k, k, k) for k in range(10, 600)])
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c")], "doc_id long, body string")
    rows = segments.once(docs).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3] and {r.body for r in rows if r.doc_id > 1} == {None, "c"}
