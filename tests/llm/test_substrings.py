import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import make_docs
from textloom.llm import substrings


def brute(texts, length):
    raws = [(x or "").encode() for x in texts]
    seen = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        on = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                on[k : k + length] = True
        edge = np.diff(np.concatenate([[0], on.astype(int), [0]]))
        out.append((len(r), int(on.sum()), int((edge == 1).sum()), hashlib.sha256(np.frombuffer(r, np.uint8)[~on].tobytes()).hexdigest()))
    return out


def check(spark, pairs, **more):
    got = sorted((tuple(r) for r in substrings.repeated_spans(make_docs(spark, pairs).repartition(3), **more).collect()), key=str)
    want = brute([x for _, x in pairs], more.get("length", substrings.LENGTH))
    assert got == sorted(((i, *w) for (i, _), w in zip(pairs, want, strict=True)), key=str)


def corpus(prose, n=40):
    draw = random.Random(8)
    passage, out = prose(150, 1000), []
    for k in range(n):
        words = prose(draw.randint(20, 250), k)
        cut = draw.randint(0, len(words))
        a = draw.randint(0, 300)
        out.append(words if k % 3 else words[:cut] + passage[a : a + draw.randint(300, 700)] + words[cut:])
    out += [out[5], out[5], out[6], "é" * 500, "é" * 199, "é" * 200, "ab" * 600, "x" * 399, "x" * 400, "x" * 401, "", None, prose(300, 77) + " and " + prose(300, 77)]
    return [*enumerate(out), (None, out[7]), (4, out[9]), (4, out[9]), (None, None)]


def test_against_all_strings(spark, prose):
    check(spark, corpus(prose))


def test_large_buckets_are_halved(spark, prose):
    draw = random.Random(3)
    passage = prose(120, 500)
    pairs = [(k, prose(30, k) + passage[: draw.randint(380, len(passage))] + prose(30, 10_000 + k)) for k in range(60)]
    check(spark, pairs, contexts=4)
    check(spark, corpus(prose, 20), contexts=1)


def test_empty(spark):
    assert substrings.repeated_spans(make_docs(spark, [])).count() == 0
    check(spark, [(1, None), (2, "short")])


def test_anchors_cover_every_start(monkeypatch, prose):
    raw = (prose(400, 5) + "z" * 900 + "ab" * 300).encode()
    for piece in (1 << 22, 700):
        monkeypatch.setattr(substrings, "_PIECE", piece)
        found = list(substrings.anchors(raw))
        covered = [s for _, _, u, v in found for s in range(u, v + 1)]
        assert sorted(covered) == list(range(len(raw) - 399)) and all(u <= p <= v + 400 - substrings.GRAM and u + 0 <= p for _, p, u, v in found)


def test_refinement_against_counts(prose):
    draw = random.Random(6)
    source = prose(500, 9).encode()
    texts = [source[(a := draw.randint(0, 1500)) : a + draw.randint(0, 900)] for _ in range(40)] + [b"q" * 450, b"", b"short"]
    seen = Counter(t[k : k + 400] for t in texts for k in range(len(t) - 399))
    for t, on in zip(texts, substrings.refine(texts), strict=True):
        assert on.tolist() == [seen[t[k : k + 400]] > 1 for k in range(max(0, len(t) - 399))]


def test_refined_keeps_both_ranges_of_an_anchor(monkeypatch, prose):
    """At the border of two pieces one anchor has two ranges of starts; the intervals are those of all strings, found by counting."""
    monkeypatch.setattr(substrings, "_PIECE", 700)
    passage = prose(200, 3)[:450]
    raws = [(prose(400, 1)[:a] + passage + prose(400, 2)[:900]).encode() for a in (250, 260, 270, 320, 450, 610, 690)]
    at, rows = substrings.LENGTH, []
    for k, r in enumerate(raws):
        rows += [(h, bytes([k]), k, p, p - v, p - u, 2, r[u : v + at]) for h, p, u, v in substrings.anchors(r)]
    rows.sort(key=lambda r: r[0])
    cols = [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), substrings._CONTEXT_ARROW, strict=True)]
    spans = [np.zeros(len(r), bool) for r in raws]
    for b in substrings._refined(at)(iter([pa.RecordBatch.from_arrays(cols, schema=substrings._CONTEXT_ARROW)])):
        for x in b.to_pylist():
            spans[x["rep"]][x["s"] : x["e"]] = True
    assert [int(on.sum()) for on in spans] == [n for _, n, _, _ in brute([r.decode() for r in raws], at)]
