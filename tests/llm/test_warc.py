"""Archives by exact round trip, revisits and index by plain versions."""
import gzip
import hashlib
import re
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from pliego.llm import warc as W


def plain(rows):
    """[(page_id, bytes, digest, type, refers_to)]"""
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        ids = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        again = len(p) >= 100 and ids and i != min(ids)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return out


def parsed(data):
    """Records of an archive by the lengths in their headers."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4:]
    return out


BIG = "<p>" + "große Seite " * 20
ODD = [(1, "http://www.A.example.com:80/x?b=1#f", BIG), (2, "https://a.example.com/x", BIG), (3, None, None), (4, "u\r\nX: y", ""),
       (5, "http://b.example.com", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9), (6, "http://b.example.com", "WARC/1.1\r\n"),
       (7, "http://b.example.com", "\r\n\r\n"), (8, "", "a\r\n\r\n\r\n\r\nWARC/1"), (9, "http://c.example/", BIG), (9, "http://c.example/", BIG),
       (None, "http://d.example/", BIG), (10, "http://e/", "\r\n\r\nWARC/1.1"), (11, "http://e/", "y\r"), (12, "http://e/", "0\x00\x85 "),
       (13, "http://b.example.com", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)


def by_id(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archives(frame(spark, ODD), path)
    got = W.read_archives(spark, path).collect()
    assert by_id((r.page_id, r.payload_bytes, r.digest, r.record_type, r.refers_to) for r in got) == by_id(plain(ODD))
    texts = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert all(texts[i] == (h or "") for i, _, h in ODD if i in texts)
    found = [x for f in Path(path).glob("*.gz") for x in parsed(gzip.open(f).read())]
    assert {"response", "revisit", "continuation"} == {f["WARC-Type"] for f, _ in found}
    for f, block in found:
        if f["WARC-Type"] == "response" and "WARC-Segment-Number" not in f:
            assert f["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(block.partition(b"\r\n\r\n")[2]).hexdigest()


def test_index_is_in_order(spark):
    rows = [(i, f"http://h{i * 7 % 5}.example.com/p{i % 3}", f"page {i % 4} " * 30) for i in range(200)] + ODD
    index = W.capture_index(frame(spark, rows)).collect()
    assert by_id((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index) == by_id(plain(rows))
    keys = [(r.url_key, r.date, (r.page_id is not None, r.page_id or 0), r.record_id) for r in index]
    assert keys == sorted(keys)


def test_url_keys(spark):
    urls = {"http://www.Example.com:80/a?q#f": "com,example)/a?q", "https://u:p@x.org:8443": "org,x:8443)/", "x.org/y": "org,x)/y", "": ")/"}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.k for r in df.select("url", W.url_key(W.F.col("url")).alias("k")).collect()} == urls


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=9))
def test_loser_tree(lists):
    lists = [sorted(x) for x in lists]
    assert list(W.LoserTree(lists)) == sorted(x for xs in lists for x in xs)


def test_whole_table(spark, sf_dir):
    from pliego.llm.queries import QUERIES
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op2_warc_index"](spark, sf_dir).collect()]
    assert by_id(got) == by_id(plain(rows))


def test_empty_table(spark):
    assert W.capture_index(frame(spark, ODD).limit(0)).count() == 0
