from pyspark.sql import functions as F

from textloom.operators import cleanup, linking


def test_chat():
    text = "User:\nUser:\nhello\n\nI hope this helps!\n```py\nI hope this helps!\n```\nCertainly!\nend"
    assert cleanup.chat_clean(text) == "User:\nhello\n\n```py\nI hope this helps!\n```\nend"


def test_manual():
    text = "Table of Contents\nOne ........ 1\n\nText\nPage 3 of 9\n12\n© a\nmore\n© b\nCopyright c\n```\n12\n```"
    assert cleanup.manual_clean(text) == "Text\n© a\nmore\n\n```\n12\n```"
    assert cleanup.manual_clean("© a\n© b") == "© a\n© b" and cleanup.manual_clean("") == ""


def test_paragraphs():
    assert cleanup.paragraphs("a\nb\n- x\n- y\nc") == "a\n\nb\n- x\n- y\nc" and cleanup.paragraphs("```\na\nb\n```") == "```\na\nb\n```"


def test_columns_and_concepts(spark):
    df = spark.createDataFrame([(1, ["A", "b", "a"], "x\ny"), (2, [], None)], "doc_id long, tags array<string>, t string")
    assert [r.y for r in df.select(cleanup.as_column(cleanup.paragraphs)(F.col("t")).alias("y")).collect()] == ["x\n\ny", None]
    concepts = spark.createDataFrame([("a", "one"), ("B", "two")], "label string, concept string")
    assert {r.doc_id: r.linked for r in cleanup.linked_concepts(df, "tags", concepts).collect()} == {1: ["one", "two"], 2: []}


def test_links():
    names = [("Ann Weber", "refs/persons/ann-weber"), ("Weber", "refs/persons/weber"), ("C++", "refs/t/c"), ("AI", "refs/t/ai")]
    got = linking.linked("---\nAnn Weber\n---\nann weber met Weber, Ann Weber and mail\n```\nAI\n```\nsee [[x]] AI\nAI, AI", names)
    assert got == "---\nAnn Weber\n---\n[[refs/persons/ann-weber|Ann Weber]] met [[refs/persons/weber|Weber]], Ann Weber and mail\n```\nAI\n```\nsee [[x]] AI\n[[refs/t/ai|AI]], AI"
    assert linking.linked("", names) == "" and linking.linked("x", []) == "x"
