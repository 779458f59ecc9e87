import hashlib

import pytest

from orgatlas.llm import warc

PAGES = [(1, "http://a.example/x y", "<p>" + "z" * 1200), (2, "http://b.example/", "<p>" + "z" * 1200), (3, None, None), (4, "http://c.example/", "small"), (5, "http://d.example/", "small"), (6, "http://e.example/", "WARC/1.1\r\n\r\nhttp://x 1 2 3 4\nä" * 90), (None, "http://f.example/", "é"), (2, "http://b.example/", "<p>" + "z" * 1200)]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_version(version):
    raw = warc.arc_opening(version, "n.arc") + warc.arc_record(version, 7, "http://x/a b", b"body\nhttp://y 1 2") + warc.arc_record(version, None, None, b"")
    (a, block), (b, rest) = warc.parse_arc(raw)
    assert a["URL"] == "http://x/a%20b" and warc.http_parts(block)[1]["x-page-id"] == "7" and bytes(warc.http_parts(block)[2]) == b"body\nhttp://y 1 2"
    assert b["URL"] == "unknown:" and bytes(warc.http_parts(rest)[2]) == b""


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id long, url string, html string, digest int")
    rows = warc.round_trip(pages.repartition(2)).collect()
    assert len(rows) == len(PAGES)
    by = {r.page_id: r for r in rows}
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        assert by[page_id].payload_bytes == len(raw) and by[page_id].payload_digest == hashlib.sha1(raw).hexdigest()
    assert (by[1].record_type, by[1].refers_to) == ("revisit", 2)
    assert all(by[i].record_type == "response" and by[i].refers_to is None for i in (2, 3, 4, 5, 6, None))
    assert warc.round_trip(pages.where("page_id = 99")).count() == 0


def test_archives_are_cut_at_their_size(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "q" * 500) for i in range(40)]
    batches = list(warc.archives(iter(rows), lambda n: b"open%d\n" % n, lambda r: r[2].encode() + b"\n", lambda r: len(r[2]), 1))
    assert len(batches) == 1
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    small = list(warc.archives(iter(rows), lambda n: b"open%d\n" % n, lambda r: r[2].encode() + b"\n", lambda r: len(r[2]), 1))
    assert len(small) > 10 and b"".join(b.column(0)[0].as_py() + b"\n" for b in small).count(b"q" * 500) == 40


def test_headers_of_any_length():
    raw = b"HTTP/1.1 200 OK\r\nX-Long: " + b"a" * 200_000 + b"\r\nX-Page-Id: 7\r\n\r\nbody"
    status, headers, payload = warc.http_parts(memoryview(raw))
    assert status == "200" and headers["x-page-id"] == "7" and bytes(payload) == b"body"
