import io
import zipfile

import pytest

from almanac.llm import warc


def test_package_round_trip_by_range_reads():
    for zip64 in (False, True):
        writer, want = warc.PackageWriter(zip64), []
        for i in range(200):
            payload = f"<p>{i}</p>".encode() * (i % 7) + bytes([i % 256])
            writer.add(i, f"http://x/{i} ä", payload, 3 if i % 10 == 9 else None)
            want.append((str(i), payload if i % 10 != 9 else b"", warc.digest(payload)))
        out = io.BytesIO()
        writer.close(out)
        data, reads = out.getvalue(), []

        def read_at(at, n):
            reads.append(n)
            return data[at : at + n]

        got = []
        for record in warc.read_records(read_at, len(data)):
            head, _, payload = warc.parse_record(record)
            got.append((head["x-page-id"], payload, head["warc-payload-digest"].removeprefix("sha1:")))
        assert got == want
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_directory_after_a_comment_and_bad_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m", b"hello")
        z.writestr(zipfile.ZipInfo("d"), b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside it, long enough to be taken for a record"
    data = out.getvalue()
    read_at = lambda at, n: data[at : at + n]
    found = warc.read_directory(read_at, len(data))
    at = warc.data_start(read_at, found["m"])
    assert data[at : at + found["m"].size] == b"hello"
    with pytest.raises(ValueError, match="compressed"):
        warc.data_start(read_at, found["d"])
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.read_directory(lambda at, n: b"nothing"[at : at + n], 7)


def test_pages(spark):
    rows = [(3, "u3", "same"), (1, "u1", "same"), (2, None, "same"), (4, "u4", None), (5, "u5", ""), (6, "u6", "é" * 100_000), (7, "u7", "own"), (7, "u7", "own"), (None, "u", "same"), (None, "v", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS key", "'clash' AS refers_to", "'clash' AS payload")
    out = warc.archive_pages(pages).collect()
    assert len(out) == len(rows) and all(r.digest_ok for r in out)
    kind = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in out), key=str)
    assert (False, 1, "response", None) in kind and (False, 2, "revisit", 1) in kind and (False, 3, "revisit", 1) in kind and (False, 5, "revisit", 4) in kind
    assert kind.count((False, 7, "response", None)) == 2 and (True, 0, "revisit", 1) in kind and (True, 0, "response", None) in kind
    assert {r.payload_bytes for r in out if r.page_id == 6} == {200_000}
    assert {r.payload.decode() for r in out if r.page_id == 1} == {"same"}
    large = warc.archive_pages(pages, min_revisit_bytes=10).collect()
    assert {r.record_type for r in large} == {"response"}
    assert warc.archive_pages(pages.limit(0)).count() == 0
