"""Archives of no pages, of repeated rows, of ties, nulls and payloads of many chunks."""

import base64
import hashlib

from sheetwise.llm import warc

SCHEMA = "page_id long, url string, html string, payload_digest string"


def read_back(spark, rows, tmp_path, chunk=warc.CHUNK):
    at = f"file://{tmp_path}/archives"
    warc.write_archives(spark.createDataFrame([(i, "http://a", h, "clash") for i, h in rows], SCHEMA), at, chunk=chunk)
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, at).collect()], key=repr)


def expected(rows):
    out = []
    for i, h in rows:
        data = (h or "").encode()
        top = max(j for j, g in rows if (g or "") == (h or ""))
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out, key=repr)


def test_no_pages(spark, tmp_path):
    assert read_back(spark, [], tmp_path) == []


def test_ties_nulls_and_long_payloads(spark, tmp_path):
    long = "é<p>\r\n\r\nWARC/1.0\r\n" * 5000
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, long), (6, long), (7, "b" * 3000), (8, "a")]
    assert read_back(spark, rows, tmp_path, chunk=1000) == expected(rows)
