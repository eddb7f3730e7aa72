import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import make_docs
from textloom.llm import filters, toxicity

LABELS = "doc_id long, quality int, toxic int, row string"


def corpus(spark, prose, n=400):
    bad = ["snarkle", "grumfit", "vexoid"]
    pairs = [(k, prose(60, k) + (" " + bad[k % 3].title() + "! " + bad[(k + 1) % 3] + "ish" if k % 5 == 0 else "")) for k in range(n)]
    labels = [(k, 1, int(k % 5 == 0), "r") for k in range(n)] + [(3, 1, None, "r"), (None, 1, 1, "r"), (9999, 0, 1, "r")]
    return pairs, spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark, prose):
    pairs, labels = corpus(spark, prose)
    more = [(5000, None), (5001, ""), (5002, "..."), (None, "snarkle grumfit"), (5003, "word " * 50_000), (5004, "Snarkle")]
    out = toxicity.toxicity_scores(make_docs(spark, pairs + more), labels).collect()
    assert len(out) == len(pairs) + len(more) and all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.CUT) for r in out)
    held = [(r.predicted, r.row.doc_id % 5 == 0) for r in out if r.row.doc_id is not None and r.row.doc_id < 5000 and toxicity.fold(r.row.doc_id) == 2]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95
    by = {r.row.doc_id: r for r in out}
    assert by[5004].predicted == 1 and by[None].predicted == 1 and not any(by[k].predicted for k in (5000, 5001, 5002, 5003))


def test_only_text_matters(spark, prose):
    pairs, labels = corpus(spark, prose, 200)
    one = {r.row.text: r.score for r in toxicity.toxicity_scores(make_docs(spark, pairs), labels).collect()}
    held = [(k, y) for k, y in ((k, int(k % 5 == 0)) for k in range(200)) if toxicity.fold(k) == 2]
    flipped = labels.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").unionByName(spark.createDataFrame([(k, 1, 1 - y, "r") for k, y in held], LABELS))
    two = {r.row.text: r.score for r in toxicity.toxicity_scores(make_docs(spark, pairs, source="elsewhere"), flipped).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-6 for k in one)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert len({r.score for r in toxicity.toxicity_scores(make_docs(spark, [(1, "a"), (2, None)]), none).collect()}) == 1
    assert toxicity.toxicity_scores(make_docs(spark, []), none).count() == 0


def test_words_count_to_their_ends(spark, prose):
    stems = ["neighbourhoods", "достопримечательность"]
    pairs = [(k, prose(60, k) + f" {stems[k % 2]}{'grumfit' if k % 5 == 0 else 'garden'}") for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 5 == 0), "r") for k in range(400)], LABELS)
    out = {r.row.doc_id: r for r in toxicity.toxicity_scores(make_docs(spark, pairs), labels).collect()}
    held = [(out[k].predicted, k % 5 == 0) for k in range(400) if toxicity.fold(k) == 2]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95


def test_beginnings_against_slices():
    words = [b"a", b"ab", b"x" * 300, b"x" * 299 + b"y", "привет".encode()]
    want = {(w, (word + b"$")[: k + 1]) for w, word in enumerate(words) for k in range(len(word) + 1)}
    for rows in (1, 50, 10_000):
        got = [z for block in toxicity.beginnings(words, rows) for z in zip(*(x.tolist() for x in block), strict=True)]
        assert len(got) == len(want) and len({h for _, h, _, _ in got}) == len({p for _, p in want})
        hashes = {h for _, h, _, _ in got} | {int(toxicity._BASIS)}
        assert all(parent in hashes for _, _, parent, _ in got) and {(w, d) for w, _, _, d in got} == {(w, len(p)) for w, p in want}


def plain_scores(texts, labels, held_out=2):
    """The same scores, word by word in dictionaries."""
    split = {i: collections.Counter(toxicity.words_of(t.encode()) if t else []) for i, t in texts.items()}
    known = {i: y for i, y in labels.items() if i in split and toxicity.fold(i) != held_out}

    def model(ids):
        seen = [collections.Counter(), collections.Counter()]
        for i in ids:
            seen[known[i]].update(split[i].keys())
        of, types, nodes = [sum(c.values()) for c in seen], set(seen[0]) | set(seen[1]), {}
        for w in types:
            for k in range(len(w) + 1):
                n = nodes.setdefault((w + b"$")[: k + 1], [0, 0, 0])
                n[0], n[1], n[2] = n[0] + seen[0][w], n[1] + seen[1][w], n[2] + 1
        kinds = collections.Counter((min(len(p), toxicity.DEPTHS), y) for p, n in nodes.items() for y in (0, 1) if n[y])

        def word(w):
            best = 0.0
            for k in range(len(w) + 1):
                p = (w + b"$")[: k + 1]
                n = nodes.get(p, (0, 0, 0))
                if n[0] + n[1] < toxicity.SEEN or min(of) == 0:
                    break
                a, b = (max(n[y] - toxicity.DISCOUNT, 0) / of[y] + toxicity.DISCOUNT * max(1, kinds[min(len(p), toxicity.DEPTHS), y]) / of[y] * n[2] / len(types) for y in (0, 1))
                best = max(0, round((math.log(b / a) - toxicity.MARGIN) * toxicity.UNIT))
            return best

        return lambda i: (sum(word(w) * n for w, n in split[i].items()), max(1, sum(split[i].values())))

    full, others = model(known), {f: model([i for i in known if toxicity.fold(i) != f]) for f in range(4)}
    features = lambda pairs: np.column_stack(toxicity._features(np.array([p[0] for p in pairs]) / toxicity.UNIT, np.array([p[1] for p in pairs], float), np.sqrt))
    w = toxicity.logistic(features([others[toxicity.fold(i)](i) for i in known]), np.array(list(known.values())))
    return dict(zip(split, 1 / (1 + np.exp(-(w[0] + features([full(i) for i in split]) @ w[1:]))), strict=True))


def test_against_plain_version(spark, prose):
    pairs, labels = corpus(spark, prose, 300)
    pairs += [(1000, None), (1001, ""), (1002, pairs[5][1]), (1003, "snarkleology " * 3 + "é" * 40)]
    want = plain_scores(dict(pairs), {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None})
    got = {r.row.doc_id: r.score for r in toxicity.toxicity_scores(make_docs(spark, pairs), labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4
    assert got[1002] == got[5] and got[1003] > 0.3


@pytest.mark.parametrize("share", (0.005, 0.02, 0.2))
@pytest.mark.parametrize("n", (200, 40_000))
@pytest.mark.parametrize("apart", (0.5, 3.0, 50.0))
def test_calibration_at_any_share(share, n, apart):
    draw = np.random.default_rng(3)
    y = (draw.random(n) < share).astype(int)
    y[:2] = 0, 1
    x = np.column_stack([np.abs(draw.normal(apart * y, 0.3)), np.zeros(n), np.abs(draw.normal(apart * y, 1.0)) * 1e3])
    w = toxicity.logistic(x, y)
    p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -500, 500)))
    assert np.isfinite(w).all() and abs(p.mean() - y.mean()) < 1e-4
    if apart > 1 and n * share > 20:
        assert p[y == 1].mean() > 0.5 and np.median(p[y == 0]) < 0.1


def test_weights_are_never_negative():
    draw = np.random.default_rng(5)
    x = np.abs(draw.normal(size=(500, 3)))
    for y in ((x[:, 0] < 0.2).astype(int), (x[:, 0] - x[:, 1] > 0.5).astype(int), (draw.random(500) < 0.1).astype(int)):
        w = toxicity.logistic(x, y)
        assert np.isfinite(w).all() and w[1:].min() >= 0
    assert toxicity.logistic(x, (x[:, 0] - x[:, 1] > 0.5).astype(int))[1] > 0.5


def test_rare_labels(spark, prose):
    """One toxic text in fifty: the others stay below the cut."""
    bad = ["snarkle", "grumfit", "vexoid"]
    pairs = [(k, prose(40, k) + (" " + " ".join(bad) if k % 50 == 0 else "")) for k in range(1500)]
    labels = spark.createDataFrame([(k, 1, int(k % 50 == 0), "r") for k in range(1500)], LABELS)
    out = {r.row.doc_id: r for r in toxicity.toxicity_scores(make_docs(spark, pairs), labels).collect()}
    assert sum(out[k].predicted for k in range(1500) if k % 50) == 0 and np.mean([out[k].predicted for k in range(0, 1500, 50)]) > 0.9


def test_counts_grow_with_the_labels(spark, prose):
    """Every labelled row outside the held-out fold counts, and every word seen often enough is in the model, whatever their number."""
    from textloom.llm.scratch import Scratch

    pairs, labels = corpus(spark, prose, 200)
    many = [(k, f"w{k // 6}x") for k in range(100_000, 130_000)]
    labels = labels.unionByName(spark.createDataFrame([(k, 1, 1, "r") for k, _ in many], LABELS))
    _, table = toxicity.toxic_beginnings(make_docs(spark, pairs + many), labels, Scratch(spark, "toxicity"))
    words = collections.Counter(x for k, x in many if toxicity.fold(k) != 2)
    often = [x.encode() for x, n in words.items() if n >= toxicity.SEEN]
    ends = [h[-1:].view(np.int64)[0] for x in often for _, h, _, _ in toxicity.beginnings([x])]
    assert len(words) > 4000 and {r.h for r in table.where("v0 > 0").collect()} >= set(ends)


def test_bit_filter(spark):
    values = [0, 1, -1, 7, 8, (1 << 26) - 1, 1 << 26, 32767, 32768, -(1 << 63), (1 << 63) - 1]
    bits = filters.bit_filter(spark.createDataFrame([(v,) for v in values], "h long"), "h")
    assert filters.passes(bits, np.array(values)).all() and not filters.passes(bits, np.array([2, 3, 9, 32766, 32769])).any()
    assert not filters.bit_filter(spark.createDataFrame([], "h long"), "h").any()


def plain_pair_scores(texts, labels, held_out=2):
    """The scores of order 2, word by word in dictionaries; each fitted and judged without Spark."""
    split = {i: toxicity.words_of(t.encode()) if t else [] for i, t in texts.items()}
    known = {i: y for i, y in labels.items() if i in split and toxicity.fold(i) != held_out}
    after = lambda i: list(zip([b"", *split[i]], split[i], strict=False))

    def model(ids):
        pairs, texts_with = [collections.Counter(), collections.Counter()], collections.Counter()
        for i in ids:
            pairs[known[i]].update(set(after(i)))
            texts_with.update(set(split[i]))
        total = pairs[0] + pairs[1]
        kept = {p for p, n in total.items() if n >= toxicity.SEEN}
        left, follow = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
        for y in (0, 1):
            for (u, w), n in pairs[y].items():
                follow[y][u] += n
                left[y][u] += n - (max(n - toxicity.DISCOUNT, 0) if (u, w) in kept else 0)
        weight = lambda u, y: left[y][u] / follow[y][u] if follow[y][u] else 1
        spread, of, nodes = [collections.Counter(w for _, w in p) for p in (*pairs, total)], [len(pairs[0]), len(pairs[1])], {}
        for w, seen in texts_with.items():
            for k in range(len(w) + 1):
                n = nodes.setdefault((w + b"$")[: k + 1], [0, 0, 0, 0])
                for j, x in enumerate((*(c[w] for c in spread), seen)):
                    n[j] += x
        kinds = collections.Counter((min(len(p), toxicity.DEPTHS), y) for p, n in nodes.items() for y in (0, 1) if n[y])

        def lower(w):
            longest = max((k for k in range(1, len(w) + 2) if nodes.get((w + b"$")[:k], (0, 0, 0, 0))[3] >= toxicity.SEEN), default=0)
            if not longest or not min(of):
                return 1.0, 1.0
            n, depth = nodes[(w + b"$")[:longest]], min(longest, toxicity.DEPTHS)
            return [max(n[y] - toxicity.DISCOUNT, 0) / of[y] + toxicity.DISCOUNT * max(1, kinds[depth, y]) / of[y] * n[2] / len(total) for y in (0, 1)]

        def word(u, w):
            p = lower(w)
            base = math.log(p[1] / p[0]) - toxicity.MARGIN
            if (u, w) in kept and min(of):
                a, b = (max(pairs[y][u, w] - toxicity.DISCOUNT, 0) / max(1, follow[y][u]) + weight(u, y) * p[y] for y in (0, 1))
                return max(0, math.log(b / a) - toxicity.MARGIN)
            return max(0, base + math.log(weight(u, 1) / weight(u, 0))) if base > 0 else 0

        return lambda i: (sum(word(*p) for p in after(i)), max(1, len(split[i])))

    full, others = model(known), {f: model([i for i in known if toxicity.fold(i) != f]) for f in range(4)}
    features = lambda pairs: np.array([[math.sqrt(v / n), v / n] for v, n in pairs])
    w = toxicity.logistic(features([others[toxicity.fold(i)](i) for i in known]), np.array(list(known.values())))
    return dict(zip(split, 1 / (1 + np.exp(-(w[0] + features([full(i) for i in split]) @ w[1:]))), strict=True))


def phrases(prose, n=400):
    """Every text has both words, and toxic ones have them one after the other, so that only the pair tells; further words are toxic by themselves."""
    pairs = []
    for k in range(n):
        a, b, c = (prose(20, 3 * k + j) for j in range(3))
        pairs.append((k, f"{a} garden {'' if k % 5 == 0 else b} party {c}" + (" snarkle" if k % 15 == 0 else "")))
    return pairs


def test_pairs_against_plain_version(spark, prose, monkeypatch):
    pairs = phrases(prose, 300) + [(1000, None), (1001, ""), (1002, "Garden, party!"), (1003, "party then garden"), (1004, "snarkleology é"), (1005, "snarkle party")]
    labels = {k: int(k % 5 == 0) for k in range(300)}
    want = plain_pair_scores(dict(pairs), labels)
    for words, texts in ((toxicity.WORDS, toxicity.BUCKET_TEXTS), (500, 1)):  # counted in one go, and in parts, a word's pairs in several buckets
        monkeypatch.setattr(toxicity, "WORDS", words)
        monkeypatch.setattr(toxicity, "BUCKET_TEXTS", texts)
        out = toxicity.toxicity_scores(make_docs(spark, pairs), spark.createDataFrame([(k, 1, y, "r") for k, y in labels.items()], LABELS), order=2).collect()
        got = {r.row.doc_id: r.score for r in out}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert got[1002] > 0.5 > got[1003]


def test_query_tells_phrases_of_ordinary_words(spark, prose, tmp_path):
    make_docs(spark, phrases(prose)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0), "r") for k in range(400)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    held = [(r.predicted, r.doc_id % 5 == 0) for r in out if r.held_out]
    assert len(out) == 400 and len(held) > 50 and np.mean([p == y for p, y in held]) > 0.98


def test_pairs_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    assert len({r.score for r in toxicity.toxicity_scores(make_docs(spark, [(1, "a b"), (2, None)]), none, order=2).collect()}) == 1
    assert toxicity.toxicity_scores(make_docs(spark, []), none, order=2).count() == 0
    one = spark.createDataFrame([(k, 1, 0, "r") for k in range(20)], LABELS)
    assert len({r.score for r in toxicity.toxicity_scores(make_docs(spark, [(k, "a b c") for k in range(20)] + [(30, None)]), one, order=2).collect()}) == 1


def test_a_block_of_words_stays_small():
    """What a task holds while it counts a block, by the word; and the counts that its rows give again."""
    draw, block = random.Random(1), 60_000
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(3, 9))) for _ in range(8000)]
    texts = [[w.encode() for w in draw.choices(words, k=300)] for _ in range(400)]
    kinds = [(k % 2, k % toxicity.FOLDS) for k in range(400)]
    columns = (pa.array([zlib.compress(b" ".join(x), 1) for x in texts]), pa.array([y for y, _ in kinds], pa.int32()), pa.array([f for _, f in kinds], pa.int32()))
    rows = [pa.RecordBatch.from_arrays([c.slice(k, 50) for c in columns], ["words", "toxic", "fold"]) for k in range(0, 400, 50)]
    tracemalloc.start()
    packed = list(toxicity._tally(2, block, 4)(iter(rows)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most / block * toxicity.WORDS < 250e6
    own, pair = collections.Counter(), collections.Counter()
    for text, (y, f) in zip(texts, kinds, strict=True):
        own.update((w, 2 * f + y) for w in {*text, b""})
        pair.update((w, h, 2 * f + y) for w, h in {*zip(text, [None, *text[:-1]], strict=True)})
    found = collections.Counter()
    for b in toxicity._merged(iter(sorted(packed, key=lambda b: b.column(0)[0].as_py()))):
        for r in b.to_pylist():
            for k, c in enumerate(toxicity._COUNTS):
                found[r["word"] if r["ctx"] is None else (r["word"], r["ctx"]), k] += r[c]
    spelt = sorted({w for x in texts for w in x})
    h = dict(zip([None, *spelt], [int(toxicity._BASIS.view(np.int64)), *toxicity.whole_words(spelt).view(np.int64).tolist()], strict=True))
    want = collections.Counter()
    for (w, x, k), n in pair.items():
        want[(w, h[x]), k] += n
    often = collections.Counter()
    for (key, _), n in want.items():
        often[key] += n
    want = {x: n for x, n in want.items() if often[x[0]] >= toxicity.SEEN} | dict(own)
    assert {x: n for x, n in found.items() if n} == want
