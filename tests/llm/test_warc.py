import base64
import gzip
import hashlib
import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from parcelkit.llm import warc

SCHEMA = "page_id long, url string, html string, key string, file int"
FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def told(rows, least=0):
    """What each of ``rows`` (page, url, html) must come back as."""
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = data in first and len(data) >= least and first[data] != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def sites(n):
    return [(k, f"http://{'www.' * (k % 2)}s{k % 7}.example{k % 3}.org/p/{k % 90}?q={k % 5}#top", f"<p>{'x' * (k % 4)}{k % 11}</p>" if k % 3 else f"page {k}") for k in range(n)]


@pytest.mark.parametrize("lines, archive_bytes, broadcast", [(3000, 1 << 30, 200_000), (5, 2000, 0)])
def test_round_trip_by_index_and_by_walking(spark, monkeypatch, lines, archive_bytes, broadcast):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = sites(400) + [(500, None, "nowhere"), (501, "not a url\n\twith % breaks %09", "x"), (502, "http://[::1]/ø?ü", ""), (503, "http://e.org", None), (-7, "http://e.org/", "é" * 50_000), (None, "http://e.org/", "é" * 50_000), (None, "http://e.org/", "alone")]
    rows += [rows[3], rows[3], rows[40], (1000, "http://one.example.com/", "hot")] + [(1000 + k, "http://one.example.com/", "hot") for k in range(1, 200)]
    df = spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA)
    for least in (0, 6):
        made = warc.archive(df, least=least)
        got = made.pages(df).select(*FIELDS, "payload", "intact").collect()
        assert sorted((tuple(r[:5]) for r in got), key=str) == told(rows, least)
        html = {}
        for page, _, text in rows:
            html.setdefault(page, set()).add((text or "").encode())
        assert all(bytes(r.payload) in html[r.page_id] and r.intact for r in got if r.record_type == "response")
        walked = made.every_record().select(*FIELDS).collect()
        assert sorted(map(tuple, walked), key=str) == told(rows, least)


def test_lookup_finds_all_captures_of_a_url(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = [(k, f"https://example.org/{k % 5}", f"p{k}") for k in range(200)] + [(900, "http://www.example.org:80/3#x", "same key")]
    made = warc.archive(spark.createDataFrame([(*r, "k", 3) for r in rows], SCHEMA))
    asked = spark.createDataFrame([("http://example.org/3",), ("http://EXAMPLE.org/3",), ("http://example.org/9",), ("",)], "url string")
    assert sorted(r.page_id for r in made.lookup(asked).collect()) == [k for k in range(200) if k % 5 == 3] + [900]
    assert made.directory.count() >= 200 // 7


def test_files_are_warc(spark):
    made = warc.archive(spark.createDataFrame([(1, "http://e.org/ü", "é", "", 1), (2, "http://e.org/2", "é", "", 1)], SCHEMA).coalesce(1))
    folder = urlparse(made.folder).path
    (name,) = [x for x in os.listdir(folder) if x.endswith(".warc.gz")]
    text = gzip.open(f"{folder}/{name}").read().decode()
    info, first, second = [x for x in text.split("WARC/1.1\r\n") if x]
    assert "WARC-Type: warcinfo" in info and "WARC-Target-URI: http://e.org/%C3%BC\r\n" in first
    assert first.endswith("Content-Length: 2\r\n\r\né\r\n\r\n") and "WARC-Refers-To: " + warc.record_name(1, "") [:10] in second and warc.PROFILE in second


def test_empty_table_and_keys(spark):
    none = spark.createDataFrame([], SCHEMA)
    made = warc.archive(none)
    assert made.pages(none).collect() == [] and made.lookup(none).collect() == []
    urls = {"http://www.Example.com/a?b#c": "com,example)/a?b", "https://u:p@a.b.org:8443": "org,b,a:8443)/", "http://10.0.0.1/x": "10.0.0.1)/x", "//x.org?q": "org,x)/?q", "mailto:a@b": "mailto:a@b", "": "", None: ""}
    df = spark.createDataFrame([(k, v) for k, v in urls.items()], "url string, want string")
    assert [(r.got, r.want) for r in df.select(warc.url_key(F.col("url")).alias("got"), "want").collect() if r.got != r.want] == []
