import gzip
import hashlib
import io

import pytest
from loomlog.llm import warc


def test_roundtrip(spark, tmp_path):
    long = "<p>é" + "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 3\r\n\r\n" * 40
    rows = [(3, "http://a/x", long), (1, "http://b", long), (2, None, None), (5, "u", "short"), (6, "u", "short"), (7, "bad\r\nurl", "\r\n\r\n"), (None, "n", long), (1, "http://b", long), (8, "v", "y" * 500_000)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = str(tmp_path / "w")
    warc.write(df, path)
    got = warc.assemble(warc.records(spark, path, with_payload=True)).collect()
    assert len(got) == len(rows)
    first = rows.index((1, "http://b", long))  # the other row of page 1 revisits it
    want = sorted((i or -1, "revisit" if h == long and k != first else "response") for k, (i, u, h) in enumerate(rows))
    by = {(r.response.page_id or -1): r for r in got if r.response.page_id != 1 or r.response.type == "response"}
    assert sorted((r.response.page_id or -1, r.response.type) for r in got) == want
    for i, _u, h in rows:
        r = by[i or -1]
        assert r.metadata.size == len((h or "").encode()) and r.response.digest == hashlib.sha256((h or "").encode()).hexdigest()
        assert r.request.concurrent_to == r.response.record_id == r.metadata.concurrent_to
        if r.response.type == "response":
            assert bytes(r.response.payload).decode() == (h or "")
            assert r.response.refers_to is None
        else:
            assert r.response.refers_to == 1


def test_parse_by_record_members_and_damage():
    rec = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    out = io.BytesIO()
    for _ in range(2):
        out.write(gzip.compress(rec))
    assert [b for _, b in warc.parse(out.getvalue())] == [b"abc", b"abc"]
    assert [b for _, b in warc.parse(rec)] == [b"abc"]
    with pytest.raises(ValueError):
        list(warc.parse(rec[:-6]))


def test_empty(spark):
    assert warc.roundtrip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_equal_payloads_without_an_id_or_under_one(spark):
    same, other = "p" * 100, "q" * 100
    rows = [(None, "b", same), (None, "a", same), (None, "a", same), (4, "z", other), (4, "y", other), (9, "a", other), (4, "y", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    c = warc.captures(df).collect()
    assert sorted((r.html[0], r.url) for r in c if not r.revisit) == [("p", "a"), ("q", "y")]
    assert {r.refers_to for r in c if r.revisit and r.html == other} == {4} and {r.refers_to for r in c if r.html == same} == {None}
    number = {r.html: r.n for r in c if not r.revisit}
    assert all(r.refers_n == number[r.html] for r in c if r.revisit)
