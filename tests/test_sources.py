"""Readers of office files, folders with bad files, and writers."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.operators import readings
from textloom.sources import cards, office, sinks

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


DOCX = {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": '<c xmlns:dc="x"><dc:title>T</dc:title><dc:creator>Ann</dc:creator></c>'}
PPTX = {f"ppt/slides/slide{k}.xml": f"<p:sld {A}><p:sp><a:p><a:t>slide {k}</a:t></a:p><a:p><a:t>more</a:t></a:p></p:sp></p:sld>" for k in (10, 2)}
XLSX = {
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>', "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="D1"><v>4.5</v></c></row><row><c r="B2" t="inlineStr"><is><t>in</t></is></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>',
}


def test_office_files_and_bad_ones(spark, tmp_path):
    files = {
        "a.docx": zipped(**DOCX), "b.pptx": zipped(**PPTX), "c.xlsx": zipped(**XLSX), "d.docx": b"no zip", "e.pdf": b"%PDF", "f.txt": "héllo".encode(), "g.txt": b"1/15/24, 3:45 PM - Ann: hi", "h.json": b'{"mapping": {}}', "i.py": b"x = 1", "j.bin": b"\0\1", "k.docx": zipped(x="y"), "l.png": b"P",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    out = {r.path.rpartition("/")[2]: r for r in office.ingest_folder(spark, str(tmp_path), readers={"image": lambda d: ("seen", {"n": str(len(d))})}).collect()}
    assert len(out) == len(files) and {n for n, r in out.items() if r.status == "failed"} == {"d.docx", "e.pdf", "j.bin", "k.docx"}
    assert out["a.docx"].text == "One two\na\tb" and out["a.docx"].properties == {"title": "T", "author": "Ann"}
    assert out["b.pptx"].text == "--- Slide 1 ---\nslide 2\nmore\n--- Slide 2 ---\nslide 10\nmore"
    assert out["c.xlsx"].text == "--- Sheet: Data ---\nname\t\t\t4.5\n\tin\tTRUE"
    assert [out[n].kind for n in ("f.txt", "g.txt", "h.json", "i.py", "j.bin", "e.pdf")] == ["text", "whatsapp", "llm_export", "code", "unknown", "pdf"] and "no reader for pdf" in out["e.pdf"].error
    assert out["l.png"].text == "seen" and "BadZipFile" in out["d.docx"].error
    small = office.extracted(spark.createDataFrame([("a.txt", b"12345"), ("b.txt", None), (None, b"x")], "path string, content binary"), max_bytes=4).collect()
    assert [(r.path, r.status) for r in small] == [("a.txt", "failed"), ("b.txt", "failed"), (None, "done")]


def test_tables_as_csv(spark, tmp_path):
    rows = [("t", 0, ["a,b", 'say "x"', "c"]), ("t", 1, ["two\nlines", "", None]), ("u", 0, ["z"])]
    df = spark.createDataFrame(rows, "table string, row int, cells array<string>")
    sinks.write_tables(df, str(tmp_path / "x"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "x" / "table=t").glob("part-*")))
    assert list(csv.reader(io.StringIO(text))) == [["a,b", 'say "x"', "c"], ["two\nlines", "", ""]]
    assert {r.name: r.value.count("rows: 2") for r in sinks.table_references(df).collect()} == {"t": 1, "u": 0}


def test_stubs_queue_and_cards(spark, tmp_path):
    stubs = sinks.entity_stubs(spark.createDataFrame([("person", "Ann", k) for k in range(25)] + [("place", "Rome", 1)], "kind string, name string, doc_id long")).collect()
    by = {r.name: r for r in stubs}
    assert len(stubs) == 2 and any("and 5 more" in r.value and r.value.count("[[") == 20 for r in stubs)
    sinks.write_queue(spark.createDataFrame([(1, "new")], "id long, state string"), str(tmp_path / "q"))
    assert sinks.read_queue(spark, str(tmp_path / "q"), "id long, state string").collect() == [(1, "new")] and by
    (tmp_path / "a.vcf").write_text("BEGIN:VCARD\r\nFN:Ann: x\r\nNOTE:Mentioned in: a, b (+3 more)\r\nno colon\r\nEND:VCARD")
    r = cards.read_cards(spark, str(tmp_path)).first()
    assert r.fields == {"BEGIN": "VCARD", "FN": "Ann: x", "END": "VCARD"} and r.sources == ["a", "b"]


@pytest.mark.parametrize(
    ("patch", "error"),
    [('{"add": {"x": 1}}', None), ("no", "not JSON"), ("[]", "neither"), ('{"add": []}', "wrong type"), ('{"remove": ["id"]}', "id is locked"), ('{"replace": {"source.path.x": 1}}', "locked"), ('{"replace": {"summary.tl_dr": "' + "x" * 601 + '"}}', "too long"), ('{"add": {"summary.key_points": [1,2,3,4,5,6]}}', "points"), (None, "not JSON")],
)
def test_patch_rules(patch, error):
    got = readings.patch_error(patch)
    assert got is None if error is None else error in got


def test_review_stops(spark):
    df = spark.createDataFrame([(1, '{"v": 5}'), (2, '{"v": 1}'), (3, '{"v": 3}'), (4, None)], "doc_id long, record string")
    out = readings.reviewed(df, lambda r: F.get_json_object(r, "$.v").cast("double"), lambda r: F.concat(F.lit('{"replace": {"v": '), (F.get_json_object(r, "$.v").cast("int") + 1).cast("string"), F.lit("}}")))
    got = {r.doc_id: (json.loads(r.record)["v"] if r.record else None, r.score, r.rounds, r.error) for r in out.collect()}
    assert got == {1: (5, 5.0, 0, None), 2: (3, 3.0, 2, None), 3: (4, 4.0, 1, None), 4: (None, None, 0, "not JSON")}
