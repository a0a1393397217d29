import base64
import hashlib
import io
from collections import defaultdict

from modelsieve.llm import op1_arc as op
from tests.conftest import SF


def expected(rows):
    """Brute force: sorted (page_id, bytes, digest, type, refers_to)."""
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for body, pages in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        pages = sorted(pages, key=lambda p: (p is not None, p))
        out += [(p, len(body), digest, "revisit", pages[-1]) for p in pages[:-1]]
        out.append((pages[-1], len(body), digest, "response", None))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r["intact"] for r in rows) and len({r["record_id"] for r in rows}) == len(rows)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)


def test_whole_table(spark):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert got(op.round_trip(spark.read.parquet(f"{SF}/pages.parquet"))) == expected(rows)


def test_odd_rows(spark):
    long = "<p>é WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n</p>" * 40_000
    rows = [(1, "http://a/ b\n", "x"), (2, None, "x"), (2, None, "x"), (3, "ftp://q", None), (4, "", ""), (None, "u", "x"), (None, None, None),
            (5, "http://é", long), (6, "dns:host", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "\n\n\n"), (-8, "u", "filedesc://x 0.0.0.0 20240101000000 text/plain 5\n"),
            (9, "u", "\r\n\r\nHTTP/1.1 X-Page-Id: 77\r\n")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, record_type string, rank int").repartition(3)
    assert got(op.round_trip(table)) == expected([(p, h) for p, _, h in rows])
    assert op.round_trip(table.limit(0)).count() == 0


def test_both_versions_and_their_records():
    for version in (1, 2):
        doc = b"HTTP/1.0 200 OK\nX-Page-Id: 5\n\nbody"
        data = op.arc_version_block("a.arc", version, "20240101000000") + b"\n" + op.arc_record("http://h/a b", doc, version, "20240102030405", 9, "a.arc")
        data += b"\n" + op.arc_record("dns:h", b"20240101 h A 1.2.3.4", version, "20240101000000", 9, "a.arc").replace(b" 0.0.0.0 ", b" 9.8.7.6 ", 1)
        data += b"\nnot a header line\n" + op.arc_record("http://h/cut", b"HTTP/1.1 200 OK\r\n\r\nlong body", version, "202401020304", 9, "a.arc")[:-3]
        records = list(op.read_arc(io.BytesIO(data)))
        assert [r.kind for r in records] == ["warcinfo", "response", "resource", "response"]
        assert [r.problem for r in records] == [None, None, None, "truncated"]
        assert records[1].payload == b"body" and records[1].rank("X-Page-Id") == 5
        warc = b"\r\n".join(op.converted(r, "dir/a.arc", None) for r in records) + b"\r\n"
        found = list(op.read_warc(io.BytesIO(warc)))
        assert [f["WARC-Type"] for f, _ in found] == ["warcinfo", "response", "resource", "response"]
        assert found[1][0]["WARC-Date"] == "2024-01-02T03:04:05Z" and found[1][0]["WARC-Target-URI"] == "http://h/a%20b"
        assert found[2][0]["WARC-IP-Address"] == "9.8.7.6" and found[2][0]["Content-Type"] == "text/dns"
        assert found[3][0]["WARC-Date"] == "2024-01-02T03:04:00Z" and found[3][0]["WARC-Truncated"] == "length"
        assert [b for _, b in found[1:]] == [r.data for r in records[1:]]


def test_blank_in_a_url_of_an_old_archive():
    line = b"http://h/a b 1.2.3.4 20240101000000 text/html 4\n"
    assert op._header(line, 1)["URL"] == "http://h/a b" and op._header(b"http://h/ x y z\n", 1) is None
