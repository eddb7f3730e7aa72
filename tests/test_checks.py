from pyspark.sql import functions as F

from textloom.operators import checks
from textloom.sources import yaml_files


def test_software_names(spark):
    df = spark.createDataFrame([("Visual Studio",), ("Anna Weber",), ("Macarena Idealo",), ("Zoom",)], "n string")
    got = [(r.a, r.b) for r in df.select(checks.software_name(F.col("n")).alias("a"), checks.software_name(F.col("n"), strict=True).alias("b")).collect()]
    assert got == [(True, True), (False, False), (True, False), (True, True)]


def test_records(spark):
    df = spark.createDataFrame([('{"a": "x", "b": 1}',), ('{"a": "x"}',), ("{",), (None,)], "j string")
    got = [r.e for r in df.select(checks.record_errors(F.col("j"), "a string, b double", ("a", "b")).alias("e")).collect()]
    assert got[0] == [] and got[1] == ["b is missing"] and got[2][0] == got[3][0] == "no valid JSON"


def test_yaml(spark, tmp_path):
    gold = tmp_path / "gold.yaml"
    gold.write_text("queries:\n  - id: Q1\n    query: when?\n    expected_docs: [a, b]\n  - query_id: Q2\n    query_text: why?\n    expected_doc_ids: [c]\n    min_precision_at_5: 0.5\n")
    rows = yaml_files.gold_queries(spark, str(gold)).orderBy("query_id").collect()
    assert [(r.query_id, r.query_text, r.expected, r.least_precision) for r in rows] == [("Q1", "when?", ["a", "b"], 0.0), ("Q2", "why?", ["c"], 0.5)]
    yaml_files.write_gold_queries(yaml_files.gold_queries(spark, str(gold)), str(tmp_path / "two.yaml"))
    assert yaml_files.gold_queries(spark, str(tmp_path / "two.yaml")).count() == 2
    words = tmp_path / "words.yaml"
    words.write_text("meta: {version: 1}\nschool: [school/admin]\n")
    assert yaml_files.add_term(str(words), "school", "school/x") and not yaml_files.add_term(str(words), "school", "school/x")
    assert {tuple(r) for r in yaml_files.vocabulary(spark, str(words)).collect()} == {("school", "school/admin"), ("school", "school/x")}
