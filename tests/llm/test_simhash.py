import random
import re

import numpy as np
import xxhash

from tests.llm.conftest import make_docs
from textloom.llm import simhash
from textloom.llm.components import components
from textloom.llm.scratch import Scratch


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(ids, fps, radius=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_fingerprints():
    for text in ("", " \t\r\n", "One", "one  TWO", "A b c", "É é ß Ünï x y z", "x " * 5000, "a b c d " * 40 + "e"):
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint(None) == 0


def test_long_text_in_parts(monkeypatch, prose):
    text = prose(3000, 1)
    monkeypatch.setattr(simhash, "_PART", 100)
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_groups_against_all_pairs(spark, prose):
    draw = random.Random(2)
    texts = [prose(draw.randint(1, 60), k) for k in range(60)]
    long = prose(400, 77)
    texts += [" ".join(w if draw.random() > 0.01 else "zz" for w in long.split()) for _ in range(40)] + ["", None, "  ", texts[0], texts[0]]
    pairs = [*enumerate(texts), (None, texts[3]), (7, texts[9]), (None, "only here and nowhere else")]
    want = groups([i for i, _ in pairs], [plain(x) for _, x in pairs])
    for tile in (8, 1024):
        got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_groups(make_docs(spark, pairs), tile=tile).collect()), key=str)
        assert got == sorted(((i, plain(x), c) for (i, x), c in zip(pairs, want, strict=True)), key=str)
    assert simhash.simhash_groups(make_docs(spark, [])).count() == 0


def test_tiles_lose_no_link(spark):
    draw = np.random.default_rng(4)
    centre = draw.integers(0, 1 << 63, 5, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in draw.choice(64, k, replace=False)) for c in centre for k in (0, 1, 2, 3, 4, 5) for _ in range(25)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, node long")
    scratch = Scratch(spark, "test")
    label = {r.node: r.component for r in components(simhash.fingerprint_links(df, scratch, 3, tile=16), scratch).collect()}
    want = groups(list(range(len(fps))), fps)
    assert [label.get(k, k) for k in range(len(fps))] == want


def test_components_of_paths_hubs_and_rings(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200 + k, 200 + (k * 7) % 31) for k in range(31)] + [(5, 5), (None, 3), (3, None)]
    draw.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[k] == 100 for k in range(101, 160)) and all(got.get(200 + k, 200) >= 200 for k in range(31))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
