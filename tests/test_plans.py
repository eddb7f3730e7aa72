from pyspark.sql import functions as F

from textloom.functions import models
from textloom.plans import ingest
from textloom.sources import sinks
from textloom.streaming import streams


def test_chain(spark):
    good = "The report of 2024-01-02 has # headings and enough words to be kept. " * 8
    rows = [(1, good), (2, good), (3, "short"), (4, "Click here to unsubscribe. " + good), (5, None), (6, "only a little text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.gate_reason, r.do_index) for r in ingest.default_chain()(df).collect()}
    assert got == {1: (None, True), 2: ("duplicate", False), 3: ("too short", False), 4: ("junk", False), 5: ("too short", False), 6: ("below the gate", False)}
    chain = ingest.default_chain().remove("triage").add("mark", lambda d: d.withColumn("m", F.lit(1)))
    assert chain.get("triage") is None and {r.doc_id for r in chain(df).where("do_index").collect()} == {1, 4}
    chunks = ingest.chunked(ingest.default_chain()(df)).collect()
    assert [c.chunk_id for c in chunks] == ["1_chunk_0"] and chunks[0].content in good


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "x: y"), (2, "c", "z")], "doc_id long, text string, source string")
    notes = sinks.notes(df, fields=("source",))
    assert notes.orderBy("name").head().value.startswith("---\ndoc_id: 1\nsource: x: y\n---\n\na b")
    sinks.write_notes(notes, str(tmp_path / "n"), F.col("name"))
    assert spark.read.text(str(tmp_path / "n")).count() == 2 * 6  # marks, two fields, a blank line, the body
    sinks.write_tables(spark.createDataFrame([("t", 1, ["a", "b"])], "table string, row int, cells array<string>"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).head().value == "a,b"
    for at in (1, 2, 3):
        sinks.write_snapshot(spark.createDataFrame([(at,)], "at int"), str(tmp_path / "s"))
    assert [r.at for r in sinks.read_snapshots(spark, str(tmp_path / "s"), 2).collect()] == [3, 2]
    events = spark.createDataFrame([("b, c", "2024-01-02"), ("a", "2024-01-01")], "t string, d string").withColumn("d", F.to_date("d"))
    value = sinks.calendar(events, "t", "d").head().value
    assert value.index("SUMMARY:a") < value.index("SUMMARY:b\\, c") and value.count("BEGIN:VEVENT") == 2
    sinks.append_chunks(spark.createDataFrame([(1, "full")], "doc_id int, view string"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("view = 'full'").count() == 1


def test_models(spark):
    df = spark.createDataFrame([("a b", "a c"), ("", "x")], "q string, t string")
    rows = df.select(models.overlap_score(F.col("q"), F.col("t")).alias("o"), models.hashed_embedding(F.col("t")).alias("e"), F.size(models.variants(F.col("q"))).alias("v"), models.sigmoid(F.lit(0.0)).alias("s"), models.cost(F.lit(12000), F.lit(3000), F.lit(0.15), F.lit(0.6)).alias("c"), models.template_answer(F.col("t")).alias("a")).collect()
    assert [r.o for r in rows] == [0.5, 0.0] and abs(sum(x * x for x in rows[0].e) - 1) < 1e-9 and rows[0].v == 3 and rows[0].s == 0.5 and abs(rows[0].c - 0.0036) < 1e-12 and rows[0].a == "a c"


def test_folder_watch(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    stream = streams.watch(spark, str(tmp_path), "value string")
    assert {r.value for r in streams.drained(stream, "append").collect()} == {"one", "two"}
