import pytest
from pyspark.sql import functions as F

from textloom.functions import dates
from textloom.operators import chats, fields, rules


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return df.select(column(*(F.col(c) for c in df.columns)).alias("y")).head()["y"]


@pytest.mark.parametrize(
    ("body", "name", "want"),
    [
        ("Amtsgericht Köln\n310 F 141/25\nx", "a.pdf", "Amtsgericht Köln - 310 F 14125"), ("invoice # 2024-7 Customer: Bay & Co.", "", "Invoice 2024-7 - Bay & Co"), ("x Einschulung 2024/25", "", "Einschulung 202425"), ("Subject: a b\n# One two three\n", "a.pdf", "One two three"),
        ("Subject: Re: One [two] three\n", "", "One two three"), ("a # Two three four ## x", "a.pdf", "Two three four"), ("This first sentence has exactly eight words here. Next.", "a.pdf", "This first sentence has exactly eight words here"),
        ("Too short. Next", "scan_my_file-1.pdf", "my file 1"), ("", "20240101-x-72851.eml", "x"), ("", "", "Document"),
    ],
)
def test_titles(spark, body, name, want):
    assert one(spark, rules.title, body, name) == want


def test_people_and_topics(spark):
    assert one(spark, fields.people, "Dr. Anna Weber met Bo Meyer (court judge), jo.doe@x.y and Dr. Anna Weber") == ["Anna Weber", "Bo Meyer", "Jo Doe"]
    assert one(spark, fields.topic, "What is the best way to sort lists?") == "The Best Way To Sort Lists" and one(spark, fields.topic, "how?") == "Conversation"


@pytest.mark.parametrize(
    ("phrase", "want"),
    [
        ("see you tomorrow", ["01-16"]), ("it was Yesterday", ["01-14"]), ("due in 3 days", ["01-18"]), ("pay in 2 weeks", ["01-29"]), ("by next friday", ["01-19"]), ("it is next monday", ["01-22"]), ("someday or next time", []), ("kommt übermorgen", ["01-16", "01-17"]),
        ("am Montag, letzten Montag", ["01-08", "01-22"]), ("letzte Woche war es", ["01-08"]), ("nächsten Monat geht", ["02-15"]), ("am Monat wie im Tag", []), ("in 1 mes o in 2 jours", ["01-17", "02-15"]), ("am sábado venimos", ["01-20"]), ("tomorrow", []), ("in 12 apples and IN 2 Wochen", ["01-29"]),
    ],
)
def test_relative_dates(spark, phrase, want):
    """Seen from Monday, 2024-01-15; a sentence of under ten characters counts for nothing."""
    got = one(spark, lambda c: dates.relative_dates(c, F.lit("2024-01-15").cast("date")), phrase)
    assert got == [f"2024-{d}" for d in want]


def test_relative_dates_of_long_and_missing_texts(spark):
    base = F.lit("2024-01-31").cast("date")
    assert one(spark, lambda c: dates.relative_dates(c, base), "see you tomorrow. " * 100 + "in 1 year it is") == ["2024-02-01"], "only fifty sentences count"
    assert one(spark, lambda c: dates.relative_dates(c, base), "x" * 2995 + " see you tomorrow") == [] and one(spark, lambda c: dates.relative_dates(c, base), "payable next month") == ["2024-02-29"]
    assert one(spark, lambda c: dates.relative_dates(c, F.lit(None).cast("date")), "see you tomorrow") == []


def test_mail_and_money(spark):
    mail = "> quoted\nOn Monday Ann wrote:\nhello\n\n\n\nworld\n--\nAnn"
    assert one(spark, rules.mail_body, mail) == "hello\n\nworld"
    assert one(spark, rules.mail_body, "On Monday Ann wrote:\n  > in\nmine\nThanks for it\nThanks,\nBo") == "mine\nThanks for it"
    bill = one(spark, rules.invoice, "Acme GmbH\nInvoice No. A-7 of 01.02.2024\nBolt 12,50 EUR\nTotal € 1.234,56 and $1,234.56\npayment within 30 days, due 2024-03-01, 19% VAT")
    assert (bill.total, bill.currency, bill.number, bill.invoice_date, bill.due_date, bill.terms, bill.items, bill.tax) == (1234.56, "EUR", "A-7", "01.02.2024", "2024-03-01", "payment within 30 days", 3, "19% VAT")
    assert [one(spark, rules.invoice, f"{x}").currency for x in ("5,00 EUR $", "$5.00", "£5.00", "CHF 5,00", "x")] == ["EUR", "USD", "GBP", "CHF", None]


@pytest.mark.parametrize(
    ("name", "want"), [("Richterin", False), ("Lehrer", False), ("RECHTSANWALT", False), ("judge teacher", False), ("Richterin Meyer", True), ("Dr. Müller", True), ("Schmidt", True), ("andreas", True), ("weber", False), ("", False), ("Ann Lee", True)]
)
def test_specific_people(spark, name, want):
    assert one(spark, rules.specific_person, name) is want


def test_corrupt_texts(spark):
    long = "x" * 101
    assert [one(spark, rules.corrupt, x) for x in (long, long + "\0", long + "\ufffd", "\0", long + "\x07" * 11, long + "\x07" * 12, long + "\t" * 500)] == [False, True, True, False, False, True, False]


def test_manual(spark):
    m = one(spark, rules.manual, "# Manual: Pump\nRelease 2.1 Date: 2024-01-02\n1. Open it\nStep 1: go\n```sh\nx\n```\nsee section 4. Tutorial")
    assert (m.version, m.document_date, m.sections, m.steps, m.code_blocks, m.languages, m.level, m.product, m.cross_references) == ("2.1", "2024-01-02", 2, 2, 1, ["sh"], "beginner", "Pump", 1)
    assert one(spark, rules.manual, "Date 2024-01-02").version == "2024-01-02"


def test_answers(spark):
    hits = spark.createDataFrame([(7, 1, "a"), (9, 2, "b")], "doc_id long, rank int, text string")
    assert fields.answered(hits, "Q").head().sources == [7, 9] and fields.answered(hits, "Q").head().answer == "Q"
    assert fields.answered(hits.where("false"), "Q").head().answer == "No documents answer this."


def test_kept_people(spark):
    person = "array<struct<name:string,role:string,email:string,phone:string>>"
    plain = lambda n: [(f"p{k}", None, None, None) for k in range(n)]
    mixed = [("a", "Richterin", None, None), ("b", "Teacher", "b@x", None), ("c", None, None, "1"), ("d", "", "", None)]
    cases = [
        ("reference/report", plain(12), 5), ("reference/report", plain(10), 10), ("government/x", plain(20), 5), ("legal/x", plain(16), 15), ("legal/x", mixed, ["a"]), ("education/x", mixed, ["b"]), ("education/x", plain(7), 5), ("education/x", plain(5), 5),
        ("reference/brochure", mixed, ["a", "b", "c"]), ("reference/brochure", [mixed[0]], ["a"]), ("form/x", plain(20), 20), ("communication/meeting-notes", plain(20), 20), ("other", plain(20), 15), ("other", [], 0),
    ]
    df = spark.createDataFrame([(k, kind, people) for k, (kind, people, _) in enumerate(cases)], f"k int, kind string, people {person}")
    got = {r.k: [p.name for p in r.kept] for r in df.select("k", chats.people_of(F.col("kind"), F.col("people")).alias("kept")).collect()}
    assert all(got[k] == want if isinstance(want, list) else len(got[k]) == want for k, (_, _, want) in enumerate(cases))


@pytest.mark.parametrize(
    ("before", "now", "want"),
    [("alpha bravo charlie", "Moving on: alpha bravo charlie", True), ("what alpha bravo", "how alpha bravo", True), ("what alpha bravo", "what alpha bravo", False), ("alpha bravo charlie", "delta eagle foxtrot", True), ("", "delta", False), ("new question alpha", "alpha", False)],
)
def test_topic_shifts(spark, before, now, want):
    assert one(spark, chats.shifted, before, now) is want


def test_scans_and_contexts(spark):
    assert tuple(one(spark, chats.scan_fields, "a   b   c\n[ ] x ☑ _____ Signature: __")) == (True, True, 2, True) and tuple(one(spark, chats.scan_fields, "a   b")) == (False, False, 0, False)
    day = lambda c: chats.date_context(c, F.lit("2024-05-06"), 5)
    assert [one(spark, day, x) for x in ("0123456789 06.05.2024 abcdefghi", "x\n2024.05.06\ny", "none", "2024-05-06 and 06.05.2024")] == ["6789 06.05.2024 abcd", "x 2024.05.06 y", "", "2024-05-06 and"]
    assert one(spark, chats.tidy, "a \0 b\t\tc  \n\n\n\nd \n") == "a b c\n\nd"


def test_items_of_invoices(spark):
    """As many as the plain pattern finds, in time linear in a line."""
    import re

    from textloom.operators.rules import ITEM

    texts = ["a 1.50 b 2,50\nc\n 3.25", " 12.50", "x\n\n5.00 9.99", "no", "a  1.5 2.555", "word " * 40_000 + "1.25", "word " * 40_000]
    assert [one(spark, rules.invoice, x)["items"] for x in texts] == [len(re.findall(ITEM, x)) for x in texts[:5]] + [1, 0]


def test_long_words_end_at_letters_beyond_ascii(spark):
    # as in the SQL: of "elleanménage" only letters of ASCII count, so that these questions have no long word in common
    assert one(spark, chats.shifted, "de elleanai un", "de oireaué un") is True
    assert one(spark, chats.shifted, "de oireau un", "de éoireaué un") is False
