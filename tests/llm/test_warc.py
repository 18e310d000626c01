"""WARC archives: round trips, and what the reader makes of broken files."""

import gzip
import hashlib
import io
import random

import pytest

from tributary.llm import warc

PAGES = "page_id long, url string, html string, path string, n_records long, headers string"


def pages_of(spark, rows, slices=3):
    return spark.createDataFrame([(*r, "p", 1, "h") for r in rows], PAGES).repartition(slices, "page_id")


def expected(rows, least=warc.MIN_REVISIT):
    last = {}
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= least and (-1 if i is None else i) < last[html or ""]
        yield i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[html or ""] if again else None


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=str)


def test_archives_give_every_page_back(spark):
    rng = random.Random(5)
    page = "<p>" + "é語😀 x " * 400
    rows = [(i, f"http://h/{i}", page) for i in range(40)]
    rows += [(100 + i, None, "short") for i in range(5)] + [(200, "http://h/a\r\nWARC-Type: revisit\r\n\r\n", "x" * 1000), (201, "u", "x" * 1000), (202, "u", "x" * 999), (203, "u", "x" * 999)]
    rows += [(300, "u", None), (301, "u", ""), (302, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 50), (303, "u", "\r\n\r\n" * 300 + "\x00")]
    rows += [(304, "u", "".join(rng.choice("abc<>\n") for _ in range(1_500_000)))]
    rows += [rows[0], rows[39], (None, "u", page), (305, "u", "é" * 500), (306, "u", "é" * 500)]
    found = warc.report(pages_of(spark, rows)).collect()
    assert sorted_rows(found) == sorted_rows(expected(rows))


def test_tables_without_rows_or_with_few_columns(spark):
    assert warc.report(pages_of(spark, [])).count() == 0
    few = spark.createDataFrame([(1, None, "a")], "page_id int, url string, html string")
    assert [tuple(r) for r in warc.report(few).collect()] == [(1, 1, hashlib.sha1(b"a").hexdigest(), "response", None)]


def test_files_are_standard_and_roll_over(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}" * 300) for i in range(50)]
    manifest = warc.write_archives(pages_of(spark, rows, 2), f"file://{tmp_path}", file_bytes=5_000)
    files = manifest.collect()
    assert len(files) > 3 and sum(r["n_records"] for r in files) == 50
    for r in files:
        raw = open(r["path"].removeprefix("file://"), "rb").read()
        assert len(raw) == r["n_bytes"]
        text = gzip.decompress(raw)  # any gzip reader sees the records one after the other
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.count(b"WARC/1.1\r\n") == r["n_records"]
    read = warc.read_archives(manifest, with_payload=True).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in read} == {i: h for i, _, h in rows}
    for r in read:  # a record can be read on its own from its offset
        with open(r["path"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            first = next(iter(warc.Reader(f.read)))
            assert b"".join(first.payload()) == bytes(r["payload"]) and first.headers["warc-target-uri"] == r["target_uri"] == f"http://h/{r['page_id']}"


def read_all(raw, step=7):
    stream = io.BytesIO(raw)
    return [(r.offset, r.headers, b"".join(r.payload())) for r in warc.Reader(lambda n: stream.read(min(n, step)), "here")]


def members(*records):
    return b"".join(gzip.compress(r, mtime=0) for r in records)


def test_any_split_of_the_input_reads_the_same():
    raw = members(warc.record(1, "u", b"abc" * 500), warc.record(2, None, b"", 1, "u"), warc.record(3, "u", b""))
    whole = read_all(raw, 1 << 20)
    assert [x[2] for x in whole] == [b"abc" * 500, b"", b""] and [x[1]["warc-type"] for x in whole] == ["response", "revisit", "response"]
    assert all(read_all(raw, n) == whole for n in (1, 2, 3, 64))


def test_unread_blocks_are_passed_over():
    raw = members(warc.record(1, "u", b"x" * 2_000_000), warc.record(2, "u", b"y"))
    stream = io.BytesIO(raw)
    assert [r.headers["page-id"] for r in warc.Reader(stream.read)] == ["1", "2"]


def broken():
    good = warc.record(1, "u", b"payload " * 200)
    yield "digest", members(good.replace(b"payload payload", b"payload PAYLOAD"))
    yield "within a gzip member", members(good)[:-20]
    yield "not a gzip member", members(good) + b"garbage that is no gzip"
    yield "more than one record|does not end where", members(good + good)
    yield "does not end where", members(good[:-4])
    yield "bytes early", members(good[:-20])
    yield "Content-Length", members(good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: x", 1))
    yield "header does not end", members(b"WARC/1.1\r\nWARC-Type: response")
    yield "no WARC record", members(b"HTTP/1.1 200 OK\r\n\r\n")
    yield "without a colon", members(good.replace(b"WARC-Date: ", b"WARC-Date ").replace(b"00:00:00", b"0"))


@pytest.mark.parametrize("what, raw", list(broken()))
def test_broken_archives_are_errors(what, raw):
    with pytest.raises(warc.WarcError, match=what):
        read_all(raw)


def test_a_broken_file_can_be_reported_instead(spark, tmp_path):
    good = warc.record(7, "u", b"x" * 50)
    (tmp_path / "a.warc.gz").write_bytes(members(good, good[:-9]))
    (tmp_path / "b.warc.gz").write_bytes(members(good))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in "ab"], "path string")
    rows = warc.read_archives(paths, strict=False).collect()
    assert sorted((r["path"][-9], r["page_id"], bool(r["problem"])) for r in rows if r["page_id"]) == [("a", 7, False), ("b", 7, False)]
    assert [r["path"][-9] for r in rows if r["problem"]] == ["a"]
    with pytest.raises(Exception, match="bytes early|does not end"):
        warc.read_archives(paths).collect()
