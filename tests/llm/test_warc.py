import base64
import hashlib
import struct

import pytest
import zstandard

from textloom.llm import warc

PAGES = "page_id long, url string, html string, payload string, sha1 string"


def expected(rows):
    top = {}
    for i, _, x in rows:
        if i is not None:
            top[x or ""] = max(top.get(x or "", i), i)
    out = []
    for i, _, x in rows:
        first = top.get(x or "")
        revisit = first is not None and (i is None or i < first)
        raw = (x or "").encode()
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(1, "http://a/x y\r\nz", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a", None), (4, "http://b", ""), (5, "http://c", "x" * 300_000), (None, "u", "<p>é</p>"), (6, "http://d", "one"), (6, "http://d", "one"), (None, None, "alone")]
    rows += [(k, f"http://h/{k}", "same page\r\n\r\nwith a gap") for k in range(100, 300)]
    df = spark.createDataFrame([(*r, "p", "s") for r in rows], PAGES).repartition(3)
    got = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_archives_are_cut_and_always_have_a_dictionary(spark):
    from textloom.llm.scratch import Scratch

    rows = [(k, f"http://h/{k}", f"page {k} " + " ".join(str(k * j) for j in range(2000))) for k in range(60)]
    df = spark.createDataFrame([(*r, "p", "s") for r in rows], PAGES).repartition(2)
    got = warc.round_trip(df, archive_bytes=20_000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    for some in (df, df.limit(1), spark.createDataFrame([(1, None, None, "p", "s")], PAGES)):
        scratch = Scratch(spark, "warc")
        folder = scratch.path("archives")
        made = warc.write_archives(warc.classify(some, scratch), folder, scratch, archive_bytes=20_000).collect()
        assert sum(r.n for r in made) == some.count() and (len(made) > 5) == (some is df)
        for r in made:
            with open(r.path, "rb") as f:
                assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_FRAME


def test_least_bytes_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "aa", "", ""), (2, "u", "aa", "", ""), (3, "u", "aaaa", "", ""), (4, "u", "aaaa", "", "")], PAGES)
    assert {tuple(r) for r in warc.round_trip(df, least=3).select("page_id", "record_type").collect()} == {(1, "response"), (2, "response"), (3, "revisit"), (4, "response")}
    assert warc.round_trip(df.where("false")).count() == 0


def test_attempts_of_a_task(spark, tmp_path):
    """A first attempt that fails after two archives, a second with other rows first that makes one, and one that races with it: the named archives alone are read."""
    import pyarrow as pa

    def batch(ids):
        texts = [f"<p>page {k}</p>".encode() * 50 for k in ids]
        return pa.RecordBatch.from_pylist([{"page_id": k, "url": f"http://h/{k}", "payload": x, "size": len(x), "sha1": hashlib.sha1(x).digest(), "kind": "response", "refers_to": None} for k, x in zip(ids, texts, strict=True)])

    root = str(tmp_path / "archives")
    failed = warc._writer(root, 10, 0, 7)(iter([batch([1, 2, 3, 4])]))
    next(failed), next(failed)
    failed.close()
    racing = warc._writer(root, 10, 0, 9)(iter([batch([4, 3, 2, 1])]))
    next(racing)
    done = [r for b in warc._writer(root, 1 << 20, 0, 8)(iter([batch([3, 1, 4, 2])])) for r in b.to_pylist()]
    list(racing)
    manifest = spark.createDataFrame([(r["path"], r["n"]) for r in done], "path string, n long")
    assert len(done) == 1 and len(list((tmp_path / "archives").iterdir())) >= 6
    assert sorted(r.page_id for r in warc.read_written(manifest).collect()) == [1, 2, 3, 4]
    short = spark.createDataFrame([(done[0]["path"], 5)], "path string, n long")
    with pytest.raises(Exception, match="4 records instead of 5"):
        warc.read_written(short).collect()


def archive(records, trained=None):
    import io

    out = io.BytesIO()
    w = warc.Writer(out, trained)
    for r in records:
        w.write(r)
    return out.getvalue()


def samples():
    return [warc.record(k, f"http://a/{k}", (f"<html>page {k}</html>" * 20).encode(), len(f"<html>page {k}</html>" * 20), warc.digest((f"<html>page {k}</html>" * 20).encode()), "response", None) for k in range(40)]


def test_dictionary_plain_and_compressed():
    recs = samples()
    trained = warc.dictionary([f"some payload {k} of many words {k * 7} here".encode() * 30 for k in range(64)])
    assert trained
    packed = archive(recs, trained)
    assert struct.unpack_from("<I", packed)[0] == warc.DICTIONARY_FRAME and list(warc.frames(packed)) == recs
    size = struct.unpack_from("<I", packed, 4)[0]
    plain = struct.pack("<II", warc.DICTIONARY_FRAME, len(trained)) + trained + packed[8 + size :]
    assert list(warc.frames(plain)) == recs
    other = plain + struct.pack("<II", warc.SKIPPABLE + 3, 4) + b"skip" + zstandard.compress(b"tail")
    assert list(warc.frames(other))[-1] == b"tail"
    assert list(warc.frames(archive(recs))) == recs and list(warc.frames(b"")) == []


@pytest.mark.parametrize("broken", [lambda a: a[:-3], lambda a: a + b"xx", lambda a: a[:4] + b"\0" + a[5:], lambda a: b"abcdefghij" + a])
def test_broken_archives(broken):
    with pytest.raises(warc.WarcError):
        list(map(warc.parse, warc.frames(broken(archive(samples()[:3])))))


def test_broken_records():
    good = samples()[0]
    assert warc.parse(good)["page_id"] == 0
    for bad in (good[:-1], good + b"x", good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"Content-Length: ", b"Content-Length: 9", 1), good.replace(b"page 0<", b"page 1<", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_large_record_limit():
    with pytest.raises(warc.WarcError):
        list(warc.frames(zstandard.compress(b"a" * 10_000), most=1000))
