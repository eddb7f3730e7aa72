import numpy as np

from textloom.llm import vectors
from textloom.llm.components import forest

SCHEMA = "vec_id long, embedding array<float>, label int, node long, tile int"


def brute(rows, cosine=0.98):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and y is not None and v and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    n, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (i, v, y), (j, w, z) = ok[a], ok[b]
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                n[i] += 1
                n[j] += 1
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (n[i], root(i), root(i) == i if i is not None else False) for i, *_ in rows}


def test_against_all_pairs(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal((40, 24))
    rows = [(k, [float(np.float32(x)) for x in base[k % 40] + draw.standard_normal(24) * (0, 0.02, 0.15, 0.19)[k % 4]], k % 3) for k in range(240)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(60)] + [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] + [1.0] * 23, 0), (2003, [None] + [1.0] * 23, 0), (2004, rows[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    for tile in (16, 2048):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.vector_groups(df, tile=tile).collect()}
        assert got == brute(rows)


def test_null_id_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1, 0, 0), (5, [1.0, 0.0], 1, 0, 0)], SCHEMA)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.vector_groups(df).collect()} == {(None, 0, None, False), (5, 0, 5, True)}
    assert vectors.vector_groups(df.where("false")).count() == 0


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(9)
    a = draw.standard_normal((300, 48))
    b = np.vstack([a + draw.standard_normal(a.shape) * s for s in (0.02, 0.1, 0.2)])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    turn = vectors.rotation(48)
    p, q = vectors.Codes(a, turn), vectors.Codes(b, turn)
    rows, exact = slice(0, 300), a @ b.T
    est = p.estimates(rows, q)
    assert abs((est - exact).mean()) < 0.01
    reach = exact >= 0.98
    assert reach.sum() > 250 and (est >= 0.98 - p.slack(rows, q, 0.98))[reach].all()
    i, j, computed = vectors.tile_links(a, b, turn)
    assert {(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True)} == set(zip(*(k.tolist() for k in np.nonzero(reach)), strict=True)) and computed < 0.05 * exact.size


def test_forest():
    assert forest(6, np.array([5, 4, 1]), np.array([4, 3, 0])).tolist() == [0, 0, 2, 3, 3, 3]
    n = 200
    assert (forest(n, np.arange(n - 1), np.arange(1, n)) == 0).all()


def test_forest_against_search():
    draw = np.random.default_rng(1)
    for n, m in ((50, 40), (300, 280), (1000, 1500)):
        i, j = draw.integers(0, n, m), draw.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            before = want.copy()
            np.minimum.at(want, i, before[j])
            np.minimum.at(want, j, before[i])
            if np.array_equal(before, want):
                break
        assert forest(n, i, j).tolist() == want.tolist()
