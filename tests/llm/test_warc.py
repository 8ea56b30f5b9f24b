import hashlib

import pytest
from pyspark.sql import functions as F

from cardlake.llm import warc
from cardlake.session import scratch_dir

SCHEMA = "page_id bigint, url string, html string, digest string, header int, type string"
LONG = "<p>" + "x" * 120 + "</p>"
PAGES = [(i, u, h, "d", 1, "t") for i, u, h in [
    (7, "http://a/\r\nX: y", LONG), (3, "http://b", LONG), (9, None, LONG), (4, "u", None), (5, "u", ""), (6, "u", "short"), (8, "u", "short"),
    (10, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n" * 5), (11, "u", "é" * 50), (2, "u", "é" * 50), (12, "u", "é" * 49 + "a"),
    (1, "u", "x" * 200_000), (13, "u", "y\n" * 99), (None, "u", LONG), (None, "u", "z" * 100), (13, "u", "y\n" * 99),
]]


def expected(rows):
    first = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and html in first and first[html] != page_id
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    return sorted(out, key=repr)


def test_archives_hold_every_record(spark, rows):
    path = scratch_dir(spark, "archives")
    read = warc.archive(spark.createDataFrame(PAGES, SCHEMA), path, file_bytes=50_000)
    assert rows(warc.with_full_payload(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(PAGES)
    payloads = {r.payload_digest: bytes(r.payload) for r in read.filter("record_type = 'response'").collect()}
    assert payloads == {hashlib.sha256((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h, *_ in PAGES}
    assert spark.read.format("binaryFile").load(path).count() > 1


def test_store_keeps_a_payload_once_and_verifies_it(spark):
    headers, payloads = warc.store(spark.createDataFrame(PAGES, SCHEMA))
    assert payloads.count() == len({h or "" for _, _, h, *_ in PAGES})
    assert headers.count() == len(PAGES)
    other = payloads.selectExpr("min(packed) as packed").first().packed
    broken = payloads.select("digest", F.lit(other).alias("packed"), "uses")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.restored(headers, broken).collect()


def test_a_cut_archive_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha256:%s\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    whole = record % hashlib.sha256(b"ab").hexdigest().encode()
    assert [r["payload"] for r in warc.parse(whole * 2)] == [b"ab", b"ab"]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse(whole[:-1]))
    with pytest.raises(ValueError, match="differs"):
        list(warc.parse(whole.replace(b"\nab", b"\nac")))


def test_empty_table(spark):
    assert warc.with_full_payload(warc.archive(spark.createDataFrame([], SCHEMA))).count() == 0
