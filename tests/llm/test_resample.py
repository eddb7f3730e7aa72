import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import pytest

from tests.llm.conftest import make_docs
from textloom.llm import resample


def grams(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(pairs, target, longest=1, buckets=resample.BUCKETS, percent=10, least=20):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in pairs:
        s.update(map(bucket, grams(x, longest)[1]))
    for x in target:
        t.update(map(bucket, grams(x, longest)[1]))
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (s.total() + buckets)) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for k, (i, x) in enumerate(pairs):
        words, found = grams(x, longest)
        weight = math.floor(Fraction(sum(gain(bucket(g)) for g in found), len(found))) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([k, i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is None, r[1] or 0, r[0]))
    rank = {r[0]: n for n, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((r[1], *r[3:], rank.get(r[0])) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=str)


@pytest.mark.parametrize(("longest", "buckets", "heavy"), [(1, 10_000, 1e-4), (1, 7, 0.5), (2, 10_000, 0.01), (3, 50, 2.0)])
def test_against_plain_counts(spark, prose, monkeypatch, longest, buckets, heavy):
    monkeypatch.setattr(resample, "HEAVY", heavy)  # from all strings broadcast to none
    pairs = [(k, prose(5 + 7 * (k % 20), k)) for k in range(300)] + [(k, "Übung MACHT den-Meister, 3x 3x " * 9) for k in range(300, 400)]
    pairs += [(400, None), (401, ""), (402, " .,; "), (403, "word " * 40_000), (404, "x" * 5000 + " " + prose(30, 5)), (None, prose(40, 3)), (7, prose(40, 3)), (405, "\x00a\x1fb\x7fc" * 20)]
    target = [prose(60, 1000 + k) for k in range(20)] + [None, "", "Meister"]
    df = resample.resample(make_docs(spark, pairs).withColumnRenamed("row", "k"), spark.createDataFrame([(x, "k") for x in target], "text string, feature string"), longest=longest, buckets=buckets)
    assert rows_of(df) == brute(pairs, target, longest, buckets)


def test_ties_and_repeats(spark):
    """One id everywhere gives equal scores: as many are drawn as asked for, each with a rank of its own."""
    df = resample.resample(make_docs(spark, [(5, "a b " * 10)] * 100), spark.createDataFrame([("a",)], "text string"), percent=30)
    assert sorted(r.rank for r in df.collect() if r.rank) == list(range(1, 31))


def test_drawn_documents_are_closer_to_the_target(spark, prose):
    pairs = [(k, prose(50, k) if k % 10 else " ".join(["target", "like", "words"] * 17)) for k in range(500)]
    df = resample.resample(make_docs(spark, pairs), spark.createDataFrame([("target like words " * 5000,)], "text string"))
    drawn = [r.doc_id for r in df.collect() if r.rank]
    assert len(drawn) == 50 and sum(i % 10 == 0 for i in drawn) >= 40


def test_empty(spark):
    none, target = make_docs(spark, []), spark.createDataFrame([], "text string")
    assert resample.resample(none, target).count() == 0
    pairs = [(k, "a b c d " * 6) for k in range(10)] + [(10, "few words")]
    assert rows_of(resample.resample(make_docs(spark, pairs), target)) == brute(pairs, [])
    assert not [r for r in resample.resample(make_docs(spark, [(1, None), (2, "x")]), target).collect() if r.rank]
