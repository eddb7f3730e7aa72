import random
import re

from tests.llm.conftest import make_docs
from textloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0]))


TEXTS = [
    None, "", "no data", "a@b.c", "x a.b+c@d-e.f.g, b@c", "a@b.c_d@e.f", "a@b@c.d", "@x.y a@.b a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 255.255.255.255 0001.02.3.4 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "4111  1111 1111 1111",
    "44111111111111111 4 111111111111111 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "+1 (017) 555-7713 and +49.30.1234567", "+12 +1( ) 2 +1 2345678", "+1 234 567 890 123 456 7", "é😀 a@b.cd é 10.0.0.1 😀 +44 20 7946 0958", "4111 1111 1111 1111 4111 1111 1111 1111",
    "00000000000000000000000000", "000000000000", "a" * 3000 + "@b.c", "1" * 5000, "1-" * 4000, ("x@y.z 10.1.1.1 " * 400),
]


def test_base_spans(spark):
    pairs = [*enumerate(TEXTS), (None, "a@b.c"), (2, "a@b.c"), (2, "a@b.c")]
    got = [(r.doc_id, sorted((x.s, x.k, x.e) for x in r.base)) for r in pii.private_spans(make_docs(spark, pairs)).collect()]
    assert sorted(got, key=str) == sorted(((i, brute(x)) for i, x in pairs), key=str)


def test_contexts_find_unseen_identifiers(spark):
    pairs = [(k, f"words {k} and more, reach me +1 555 010 {1000 + k} today") for k in range(60)]
    pairs += [(100, "please reach me 555-010-7788 today"), (101, "it cost 555-010-7788 today"), (102, "reach me soon"), (103, "reach me x5y"), (104, "Reach  me (555.0101234)"), (105, "you can reach me 555 010 7788, or not"), (106, "reach me " + "x" * 5000 + "1234"), (107, "reach me 12345"), (108, "reach me 123"), (109, "12 " * 50 + "reach me 98-76"), (110, "reach me +1 555 010 1000 555-010-9999")]
    pairs += [(200 + k, f"see the +1 555 020 {1000 + k} thing") for k in range(6)] + [(300 + k, f"see the 12345{k}78 thing") for k in range(6)]
    out = {r.doc_id: r for r in pii.private_spans(make_docs(spark, pairs)).collect()}
    added = {i: [pairs_of[x.s : x.e] for x in r.spans if x not in r.base] for i, r in out.items() for pairs_of in [dict(pairs)[i]]}
    assert {i: v for i, v in added.items() if v} == {100: ["555-010-7788"], 104: ["555.0101234"], 105: ["555 010 7788"], 106: ["x" * 5000 + "1234"], 107: ["12345"], 109: ["98-76"], 110: ["+1 555 010 1000 555-010-9999"]}
    assert all(b in r.spans for r in out.values() for b in r.base)


def test_running_sums(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 127, 128, 129, 5000):
        numbers = [(k * 7919) % 11 for k in range(n)]
        got = spark.createDataFrame([(numbers,)], "a array<bigint>").select(pii.running_sums(F.col("a")).alias("s")).first().s
        assert got == [sum(numbers[: k + 1]) for k in range(n)]


def test_many_matches_in_one_text(spark):
    """Time stays in proportion: a square of 60,000 matches would not end."""
    text = "x@y.zz 10.1.1.1 call me +1 555 010 1000 " * 30_000
    out = pii.private_spans(make_docs(spark, [(1, text), (2, "1 " * 300_000), (3, "a=" * 200_000 + "1234"), (4, "b" * 1_000_000 + " c 12345")])).collect()
    by = {r.doc_id: r for r in out}
    assert len(by[1].base) == 90_000 and by[1].base[-1].e == len(text) - 1 and not by[2].base and not by[3].spans


def plain_added(texts, trust=pii.TRUST, support=pii.SUPPORT, rounds=pii.ROUNDS):
    """The added spans by plain Python: the same patterns, and the graph scored in dictionaries."""
    digits = lambda v: re.sub("[^0-9]", "", v)
    form = re.compile(r"(?<![^\s(\[<\"'=:,;])(?:\+?[0-9][0-9./-]*(?: [0-9](?:[0-9./-]*[0-9])?(?![^\s\"'<>()\[\],;=:.!?]))+|(?=[^\s\"'<>()\[\],;=:0-9]*[0-9])[^\s\"'<>()\[\],;=:]*[A-Za-z0-9])")

    def context(left):
        m = re.search(r"(?<!\S)(\S+\s+\S+)\s*[\"'(\[<]?$", left)
        return re.sub("[0-9]+", "0", re.sub(r"\s+", " ", m[1].lower())) if m else ""

    def matches(pattern, text):
        ends = [0, 0]
        for m in re.finditer(pattern, text):
            yield m, context(text[ends[-2] : m.start()])
            ends.append(m.end())

    seeds, others = [], []
    for i, text in texts.items():
        blank = text or ""
        for k, kind in enumerate(PLAIN):
            seeds += [(c, m[0].lower(), k) for m, c in matches(PLAIN[kind], text or "") if valid(kind, m[0])]
            blank = re.sub(PLAIN[kind], lambda m, kind=kind: "\n" * len(m[0]) if valid(kind, m[0]) else m[0], blank)
        others += [(i, m.start(), m.end(), m[0].lower(), c) for m, c in matches(form, blank) if c and len(digits(m[0])) >= pii.DIGITS]
    edges = {}
    for c, v, k in seeds + [(c, v, None) for *_, v, c in others]:
        if c:
            edges[c, v] = max(-1 if k is None else k, edges.get((c, v), -1))
    total, score, patterns = {}, {}, {}
    for c, v in edges:
        total[c] = total.get(c, 0) + 1
    for r in range(rounds):
        hits = {}
        for (c, v), k in edges.items():
            for kind, x in [(k, 1.0)] if k >= 0 else score.get(v, {}).items():
                hits[c, kind] = hits.get((c, kind), 0) + x
        patterns = {(c, k): h / (total[c] + 1) for (c, k), h in hits.items() if h >= support and h / (total[c] + 1) >= trust}
        if not patterns:
            break
        score = {}
        for (c, v), k in edges.items():
            if k < 0:
                for (c2, kind), x in patterns.items():
                    if c2 == c:
                        score.setdefault(v, {})[kind] = 1 - (1 - score.get(v, {}).get(kind, 0.0)) * (1 - x)
    best = {}
    for (c, k), x in patterns.items():
        best[c] = max(best.get(c, (0, 0)), (x, -k))
    return {(i, s, e, -best[c][1]) for i, s, e, _, c in others if c in best}


def test_added_spans_against_a_plain_version(spark):
    """Identifiers planted after contexts that seeds share, others after contexts that they don't: how many are found, and that all that is found is expected."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))

    def card():
        body = [draw.randint(0, 9) for _ in range(15)]
        return next(x for c in range(10) for x in ["".join(map(str, [*body, c]))] if luhn(x))

    leads = {"email": "write to", "phone": "call me", "ip": "server at", "card": "pay by"}
    seed = {"email": lambda: f"{word()}@{word()}.com", "phone": lambda: f"+1 555 {draw.randint(100, 999)} {draw.randint(1000, 9999)}", "ip": lambda: f"10.{draw.randint(0, 255)}.{draw.randint(0, 255)}.7", "card": card}
    texts, planted = {}, set()
    for i in range(900):
        left, right = " ".join(word() for _ in range(draw.randint(0, 30))), " ".join(word() for _ in range(10))
        kind = draw.choice(list(leads))
        if i % 12 == 0:
            new = draw.choice([f"{draw.randint(100, 999)}-{draw.randint(1000, 9999)}", f"{word()}{draw.randint(1000, 99999)}", f"{draw.randint(100, 999)} {draw.randint(100, 999)} {draw.randint(1000, 9999)}"])
            lead = f"{left} {leads[kind]} "
            planted.add((i, len(lead), len(lead) + len(new), list(leads).index(kind)))
            texts[i] = f"{lead}{new} {right}"
        else:
            texts[i] = f"{left} {leads[kind] if i % 12 < 10 else word() + ' ' + word()} {seed[kind]() if i % 12 < 10 else draw.randint(10000, 99999)} {right}"
    texts |= {1000: None, 1001: "", 1002: "call me 777-8888 or pay by 99-99-99 and 5555"}
    got = {(r.doc_id, x.s, x.e, x.k) for r in pii.private_spans(make_docs(spark, list(texts.items()))).collect() for x in r.spans if x not in r.base}
    kinds = [list(leads).index(k) for k in pii.KINDS]
    got = {(i, s, e, kinds[k]) for i, s, e, k in got}
    assert got == {(i, s, e, kinds[k]) for i, s, e, k in plain_added(texts)}
    found = len({x[:3] for x in planted} & {x[:3] for x in got}) / len(planted)
    assert found > 0.7 and len(got - planted) < 10, (found, got - planted)


def test_empty(spark):
    assert pii.private_spans(make_docs(spark, [])).count() == 0


def test_no_python_in_the_plans(spark):
    plan = pii.private_spans(make_docs(spark, [(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
