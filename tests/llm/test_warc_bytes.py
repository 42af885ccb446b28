"""WARC records as bytes: charsets, encodings, references, digests and fields."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import zlib

from oracle import assert_same, connect
from pyspark.sql import functions as F

from isogloss.llm import warc


def record(name, block, kind="response", **fields):
    more = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def http(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers]).encode() + b"\r\n\r\n" + body


def test_payloads_are_read_as_bytes(spark, tmp_path):
    page = "<p>camí vell — fi</p>"
    latin, utf = page.encode("cp1252"), page.encode()
    cut = gzip.compress(utf)[:-9]
    blocks = {
        "latin": http(latin, "Content-Type: text/html; charset=ISO-8859-1"), "meta": http(b"<meta charset='windows-1252'>" + latin), "none": http(latin), "utf": http(utf), "mark": http(page.encode("utf-16")),
        "gzip": http(gzip.compress(utf), "Content-Encoding: gzip"), "deflate": http(zlib.compress(utf), "content-encoding: deflate"), "raw": http(zlib.compress(utf)[2:-4], "Content-Encoding: deflate"),
        "chunked": http(b"5\r\n" + utf[:5] + b"\r\nA;x=y\r\n" + utf[5:15] + b"\r\n%x\r\n" % (len(utf) - 15) + utf[15:] + b"\r\n0\r\n\r\n", "Transfer-Encoding: chunked"),
        "bad": http(cut, "Content-Encoding: gzip"), "short": http(b"FF\r\nabc", "Transfer-Encoding: chunked"), "brotli": http(b"x", "Content-Encoding: br"), "bare": utf, "odd": http(utf, "Content-Type: text/html; charset=no-such"),
    }
    (tmp_path / "a.warc").write_bytes(b"".join(record(k, v) for k, v in blocks.items()))
    r = warc.read(spark, str(tmp_path / "a.warc"))
    found = {x.record_id[1:-1]: x for x in warc.http_responses(r).collect()}
    assert {k for k, x in found.items() if x.problem} == {"bad", "short", "brotli"}
    texts = {k: x.payload for k, x in found.items() if not x.problem}
    assert {k: t for k, t in texts.items() if k not in ("meta", "odd")} == dict.fromkeys(["latin", "none", "utf", "mark", "gzip", "deflate", "raw", "chunked", "bare"], page)
    assert texts["meta"] == "<meta charset='windows-1252'>" + page and texts["odd"].startswith("<p>cam")
    # Digests are of the payload's own bytes.
    assert found["latin"].payload_digest == f"sha256:{hashlib.sha256(latin).hexdigest()}" and found["chunked"].payload_digest == found["utf"].payload_digest
    assert found["gzip"].payload_digest == f"sha256:{hashlib.sha256(blocks['gzip'].split(b'\r\n\r\n', 1)[1]).hexdigest()}"
    assert warc.responses_of(r).count() == len(blocks) - 3


def test_stated_digests_and_fields(spark, tmp_path):
    block = http(b"<p>x</p>", "X: y")
    sha1 = hashlib.sha1(block).digest()
    rows = [
        record("b32", block, WARC_Block_Digest="sha1:" + base64.b32encode(sha1).decode(), WARC_IP_Address="10.0.0.1", WARC_Warcinfo_ID="<i>", WARC_Concurrent_To="<q>"), record("hex", block, WARC_Block_Digest="sha256:" + hashlib.sha256(block).hexdigest()),
        record("wrong", block, WARC_Block_Digest="sha1:" + "A" * 32), record("other", block, WARC_Block_Digest="crc:1"), record("none", block, WARC_Payload_Digest="sha1:P"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(rows))
    r = warc.read(spark, str(tmp_path / "a.warc"))
    assert {x.record_id[1:-1]: x.digest_ok for x in r.collect()} == {"b32": True, "hex": True, "wrong": False, "other": None, "none": None}
    assert [x.record_id for x in warc.broken(r).collect()] == ["<wrong>"]
    found = {x.record_id[1:-1]: x for x in warc.responses_of(r).collect()}
    assert set(found) == {"b32", "hex", "other", "none"} and found["none"].payload_digest == "sha1:P"
    assert found["b32"].headers == "HTTP/1.1 200 OK\r\nX: y\r\nwarc-ip-address: 10.0.0.1\r\nwarc-warcinfo-id: <i>\r\nwarc-concurrent-to: <q>" and found["hex"].headers == "HTTP/1.1 200 OK\r\nX: y"


def test_all_references(spark):
    texts = ["&#233;&eacute;&mdash;&#xE9;&#X2014;", "&amp;lt; &amp;#233; &lt;b&gt;", "&#150;&#0;&#xD800;&#1114112;&#128512;", "a & b &unknown; &; &#; &#x; &copy 1", "&nbsp;&#160;x&NotEqualTilde;", "", "&amp;", "x&AMP;y &hellip", "&#60;b&#62; &#38;lt; &#x26;amp; &LT;", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", warc.references(F.col("t")).alias("u")).orderBy("i").collect()]
    want = [None if t is None else html.unescape(t.replace("&copy 1", "&amp;copy 1").replace("&hellip", "&amp;hellip")).replace("\xa0", " ") for t in texts]
    assert got == want


def test_null_pages_and_reading_back(spark, sf, tmp_path):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a/", "<p>é &eacute; \U0001f600</p>"), (2, "http://b/", ""), (2, "http://b/", "")], "page_id long, url string, html string")
    first = warc.responses(pages)
    warc.write(warc.response_records(first), str(tmp_path / "w"))
    r = warc.read(spark, str(tmp_path / "w"))
    assert warc.broken(r).isEmpty() and r.filter("digest_ok").count() == 4
    key = lambda df: sorted((x.record_id, x.payload, x.payload_digest) for x in df.collect())
    assert key(warc.responses_of(r)) == key(first)
    assert_same(spark, connect(sf), warc.QUERIES["warc_read_back"], warc.ORACLE_SQL["warc_read_back"], sf)
