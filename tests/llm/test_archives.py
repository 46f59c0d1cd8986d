import base64
import glob
import gzip
import hashlib
import io

from turnlake.llm import archives


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def pages(spark):
    rows = [(5, "http://a/", "<p>same</p>"), (2, "http://b/ x\ny", "<p>same</p>"), (9, None, "<p>same</p>"), (7, "u", "other é漢\r\n\r\nWARC/1.1\r\n"),
            (8, "u", None), (1, "", ""), (3, "u", "x" * 70000), (None, "n", "<p>same</p>"), (11, "u", "tail\r\n\r\n"), (2, "http://b/", "<p>same</p>")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to")


def test_round_trip(spark):
    rows, df = pages(spark)
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    wanted = sorted((str(p), len((h or "").encode()), digest(h), "response" if first[h or ""] == p else "revisit",
                     str(None if first[h or ""] == p else first[h or ""])) for p, _, h in rows)
    got = archives.round_trip(df).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == wanted
    payload = {r.page_id: bytes(r.payload) for r in got if r.record_type == "response"}
    assert payload[7].decode() == rows[3][2] and payload[3] == b"x" * 70000 and payload[1] == b""


def test_small_payloads_are_responses(spark):
    _, df = pages(spark)
    got = archives.round_trip(df, least_bytes=12).collect()
    assert {r.record_type for r in got} == {"response"}


def test_files_are_archives(spark, tmp_path):
    _, df = pages(spark)
    archives.write_archives(df, f"file://{tmp_path}/w")
    seen = []
    for path in glob.glob(f"{tmp_path}/w/*.gz"):
        data = gzip.open(path).read()
        for head, reply, payload in archives.parsed(io.BytesIO(data)):
            assert head["content-type"].startswith("application/http") and head["warc-date"].endswith("Z")
            assert "\n" not in head.get("warc-target-uri", "")
            if head["warc-type"] == "revisit":
                assert (head["warc-refers-to"], reply["content-length"]) in (("<urn:page:2>", "11"), ("<urn:page:1>", "0"))
                assert head["warc-profile"] == archives.PROFILE and payload == b""
            seen.append(head["warc-record-id"])
    assert len(seen) == 10


def test_empty(spark):
    assert archives.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
