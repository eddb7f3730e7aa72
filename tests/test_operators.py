import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import analytics, chunking, entities, mutations, retrieval, similar
from textloom.sources import parsers

SENTENCES = ["Python is a high-level programming language", "Machine learning models require large datasets", "Natural language processing uses transformers", "Deep learning neural networks are powerful", "Data science involves statistics and programming"]


def docs(spark, texts=SENTENCES):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_bm25(spark):
    index = retrieval.build_index(docs(spark))
    got = {r.doc_id: round(r.score, 6) for r in index.search(("programming", "language")).collect()}
    assert got == {0: pytest.approx(0.625995, abs=2e-6), 2: pytest.approx(0.363754, abs=2e-6), 4: pytest.approx(0.336472, abs=2e-6)}
    assert [r.doc_id for r in index.search(("learning",)).collect()] == [1, 3]
    assert index.search(("nothing",)).count() == 0


def scored(spark, pairs):
    return spark.createDataFrame([(1, k, float(v)) for k, v in pairs.items()], "query_id int, doc_id long, score double")


def test_fusion(spark):
    rows = retrieval.fuse(scored(spark, {1: 4, 2: 2, 3: 1}), scored(spark, {2: 0.9, 4: 0.5, 1: 0.1}), 10).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in rows] == [(2, 0.733333), (1, 0.4), (4, 0.3), (3, 0.0)]
    assert [r.score for r in retrieval.min_max(scored(spark, {1: 2, 2: 2})).collect()] == [1.0, 1.0]
    assert retrieval.min_max(scored(spark, {1: 2}).where("false")).count() == 0


@pytest.mark.parametrize(("weight", "want"), [(0.7, [1, 3, 2]), (0.3, [1, 3, 4]), (1.0, [1, 2, 3])])
def test_diversity(spark, weight, want):
    rows = [(1, 1, 1.0, ["alpha", "beta", "gamma"]), (1, 2, 0.95, ["alpha", "beta", "gamma"]), (1, 3, 0.6, ["delta", "epsilon"]), (1, 4, 0.5, ["alpha", "zeta"])]
    df = spark.createDataFrame(rows, "query_id int, doc_id long, score double, words array<string>")
    assert [r.doc_id for r in retrieval.mmr(df, 3, weight).orderBy("rank").collect()] == want
    assert [r.doc_id for r in retrieval.mmr(df, 9, weight).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_precision_and_recall(spark):
    found = spark.createDataFrame([(1, d, k + 1) for k, d in enumerate([1, 2, 90, 3, 91])] + [(2, 5, 1), (2, 6, 2), (2, 7, 3)], "query_id int, doc_id long, rank int")
    gold = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 9), (2, 6), (3, 1)], "query_id int, doc_id long")
    got = {r.query_id: r for r in retrieval.evaluate(found, gold).collect()}
    assert (got[1].p_5, got[1].r_5, got[1].rr) == (0.6, 0.75, 1.0) and got[2].p_5 == pytest.approx(1 / 3, abs=1e-6) and got[2].rr == 0.5 and (got[3].p_5, got[3].rr) == (0.0, 0.0)


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(k)) for k in range(1, 11)] + [("b", 7.0)], "name string, v double")
    got = {r.name: (r.p50, r.p95, r.p99) for r in analytics.percentiles(df, "name", "v", (0.5, 0.95, 0.99)).collect()}
    assert got == {"a": (6.0, 10.0, 10.0), "b": (7.0, 7.0, 7.0)}


def test_alerts(spark):
    kind = "signal double, quality double, duplicate_rate double, ingested long, topics array<string>"
    fired = lambda *now: {r.rule for r in analytics.alerts(spark.createDataFrame([now], kind), spark.createDataFrame([(0.8, 0.8, 0.05, 10, ["a", "b"])], kind)).where("fired").collect()}
    assert fired(0.65, 0.8, 0.10, 30, ["a"]) == {"signal"} and fired(0.8, 0.8, 0.16, 31, ["c"]) == {"duplicates", "ingestion", "topics"}


def test_name_similarity():
    got = [entities.similarity(*p) for p in (("weber", "thomas weber"), ("thomas weber", "thomas meyer"), ("weber", "schmidt"), ("dr thomas weber", "thomas weber prof"), ("a", "A"), ("", "b"))]
    assert got == pytest.approx([0.891667, 0.833333, 0.0, 0.75, 1.0, 0.0], abs=1e-6)


def test_clusters(spark):
    df = spark.createDataFrame([("person", n, k) for k, n in enumerate(["Thomas Weber", "Dr. Thomas Weber", "Thomas", "Anna Schmidt", "thomas weber"])], "kind string, name string, first long")
    got = {r.name: r.canonical for r in entities.clusters(df).collect()}
    assert got["thomas"] == got["thomas weber"] == "thomas weber" and got["anna schmidt"] == "anna schmidt"


def test_splitting():
    text = "One sentence here. " * 200
    parts = chunking.sliding(text)
    assert all(p in text for p in parts) and all(len(p) <= 1000 for p in parts) and parts[0].endswith(".") and text.strip().endswith(parts[-1])
    assert chunking.sliding("") == [] and chunking.sliding("x" * 2500) == ["x" * 1000, "x" * 1000, "x" * 900] and chunking.sliding("  \n ") == []
    got = chunking.structural("# A\npara one\n\n| a | b |\n| 1 | 2 |\n\n```py\n# no heading\n```\n## B\n- x\n- y\n")
    assert [(k, t) for _, k, t in got] == [("text", "A"), ("table", "A"), ("code", "A"), ("text", "B")] and "# no heading" in got[2][0]
    turns = chunking.chat_turns("Assistant: lost\nUser: First question\nAssistant: First answer\nUser: dropped\nUser: Second question\nAssistant: Second answer\nUser: open")
    assert turns == [("First question", "First answer"), ("Second question", "Second answer"), ("open", "")]
    assert chunking.chat("User: a\nAssistant: b") == [("User: a\n\nAssistant: b", "chat", None)] and chunking.chat("no turns") == []


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a. b"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.position, r.content, r.tokens) for r in chunking.chunk_table(df, chunking.sliding).collect()] == [(1, 0, "a. b", 1)]


def test_chat_lines(spark):
    df = spark.createDataFrame([(1, "1/15/24, 3:45 PM - Ann: hi: there\nmore"), (2, "15.1.24, 15:45 - Bo: x"), (3, "2024-01-15 15:45 - Cy: y"), (4, "[1/15/24, 3:45 PM] Di: z"), (5, "none")], "doc_id long, text string")
    got = {r.doc_id: (str(r.sent), r.sender, r.message) for r in parsers.chat_messages(df).collect()}
    assert got == {k: ("2024-01-15 15:45:00", s, m) for k, s, m in ((1, "Ann", "hi: there"), (2, "Bo", "x"), (3, "Cy", "y"), (4, "Di", "z"))}
    assert [r.x for r in df.orderBy("doc_id").select(parsers.is_chat(F.col("text")).alias("x")).collect()] == [True] * 4 + [False]


@pytest.mark.parametrize(("value", "want"), [("a\tb", [["a", "b"]]), ("| a | b |", [["a", "b"]]), ("a  b", [["a", "b"]]), ("a b\n\n", [["a b"]])])
def test_tables(spark, value, want):
    assert spark.createDataFrame([(value,)], "x string").select(parsers.table_rows(F.col("x")).alias("y")).head().y == want


def test_json_exports(spark):
    gpt = json.dumps({"title": "t", "mapping": {"b": {"message": {"author": {"role": "assistant"}, "create_time": 2.0, "content": {"parts": ["x", "y"]}}}, "a": {"message": {"author": {"role": "user"}, "create_time": 1.0, "content": {"parts": ["q"]}}}, "r": {"message": None}}})
    claude = json.dumps({"chat_messages": [{"text": "b", "sender": "assistant", "created_at": "2"}, {"text": "a", "sender": "human", "created_at": "1"}]})
    row = spark.createDataFrame([(gpt, claude)], "g string, c string").select(parsers.chatgpt_messages(F.col("g")).alias("g"), parsers.claude_messages(F.col("c")).alias("c"), parsers.llm_export(F.col("g")).alias("k"), parsers.llm_export(F.col("c")).alias("m")).head()
    assert [(m.role, m.text) for m in row.g] == [("user", "q"), ("assistant", "x\ny")] and [(m.role, m.text) for m in row.c] == [("user", "a"), ("assistant", "b")] and (row.k, row.m) == ("chatgpt", "claude")


def test_mail(spark, tmp_path):
    raw = b"Message-ID: <one@x>\r\nFrom: Ann <ann@x.y>\r\nTo: bo@x.y, cy@x.y\r\nSubject: =?utf-8?q?Caf=C3=A9?=\r\nDate: Mon, 15 Jan 2024 10:00:00 +0100\r\n\r\nhello\r\n"
    (tmp_path / "a.eml").write_bytes(raw)
    (tmp_path / "b.eml").write_bytes(raw.replace(b"<one@x>", b"<two@x>").replace(b"Subject: ", b"Subject: Re: ").replace(b"15 Jan", b"16 Jan"))
    mail = parsers.messages(parsers.read_folder(spark, str(tmp_path), "*.eml"))
    first = mail.where("message_id = '<one@x>'").head()
    assert (first.subject, first.recipients, first.body.strip(), str(first.sent)) == ("Café", ["bo@x.y", "cy@x.y"], "hello", "2024-01-15 09:00:00")
    t = parsers.threads(mail).head()
    assert (t.thread, t.messages, len(t.participants)) == ("one", 2, 3)


def test_patches():
    doc = json.dumps({"a": {"x": 1}, "tags": ["p"], "n": 1, "m": [1, 2]})
    got = json.loads(mutations.patched(doc, json.dumps({"add": {"a": {"y": 2}, "tags": ["p", "q"], "new.k": 3}, "replace": {"n": 5}, "remove": ["m[0]"]})))
    assert got == {"a": {"x": 1, "y": 2}, "tags": ["p", "q"], "n": 5, "m": [2], "new": {"k": 3}}
    with pytest.raises(ValueError):
        mutations.patched(doc, json.dumps({"replace": {"content_hash": 1}}))
    assert mutations.patched(None, "{}") is None


def test_ratio_and_repair(spark):
    assert similar.indel_ratio("", "") == 1.0 and similar.indel_ratio("abcd", "abxd") == 0.75
    values = ['```json\n{"a": 1}\n```', 'Sure: {"a": 1} ok', "no", '{"a": 1}']
    df = spark.createDataFrame([(v,) for v in values], "x string").select(mutations.repaired_json(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == ['{"a": 1}', '{"a": 1}', None, '{"a": 1}']


def test_chunks_of_few_texts_at_once():
    """A task gives the chunks of at most ROWS texts at a time, whatever the batch that it gets."""
    import pyarrow as pa

    texts = [None, "", *["a. " * (k % 900) for k in range(600)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "body"])
    out = list(chunking.chunk_rows(chunking.sliding)(iter([batch])))
    assert len(out) == 3 and all(len(set(b.column(0).to_pylist())) <= chunking.ROWS for b in out)
    got = [(r["doc_id"], r["position"], r["content"]) for b in out for r in b.to_pylist()]
    assert got == [(i, k, c) for i, t in enumerate(texts) if t for k, c in enumerate(chunking.sliding(t))]
