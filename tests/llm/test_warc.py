import base64
import gzip
import hashlib

from quire.llm.warc import member, page_digests, read_records, read_warc, record, write_warc


def brute(rows):
    best = {}
    for i, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, h in rows:
        data = (h or "").encode()
        other = best.get(h or "", i)
        refers = None if i is None or other == i else other
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    extra = [(900, None), (901, ""), (902, "\r\n\r\nWARC/1.1\r\n"), (903, rows[0][1]), (904, "é" * 200_000), (905, None)]
    df = pages.select("page_id", "url", "html").union(spark.createDataFrame([(i, None, h) for i, h in extra], "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    files = write_warc(df, folder)
    got = sorted((tuple(r) for r in page_digests(spark, folder, files).collect()), key=str)
    assert got == brute(rows + extra)
    whole = read_warc(spark, folder)
    assert {r.page_id: r.payload.decode() for r in whole.filter("record_type = 'response'").select("page_id", "payload").collect()}[904] == "é" * 200_000
    assert whole.filter("record_type = 'revisit' and refers_to = '<urn:page:905>'").count() == 2
    assert whole.filter("target_uri like 'http%'").count() == len(rows)
    assert read_warc(spark, folder, payload="false").filter("payload is not null").count() == 0
    path = files.first().path
    text = gzip.open(path.removeprefix("file://")).read()
    assert text.startswith(b"WARC/1.1\r\n")


def test_members_of_other_writers(tmp_path):
    parts = [record(1, "http://a", b"x" * 100_000, None, "2020-01-01T00:00:00Z"), record(2, "http://b\r\nX: y", b"", 1, "2020-01-01T00:00:00Z"), record(None, None, b"z", None, "2020-01-01T00:00:00Z")]
    for name, make in (("other", gzip.compress), ("own", member)):
        (tmp_path / name).write_bytes(b"".join(map(make, parts)))
        got = list(read_records(str(tmp_path / name)))
        assert [(r[0], r[3], r[6]) for r in got] == [("response", 1, 100_000), ("revisit", 2, 0), ("response", None, 1)]
        assert got[0][8] == b"x" * 100_000 and got[1][2] == "http://b X: y"
        only = list(read_records(str(tmp_path / name), lambda h: h["warc-type"] == "revisit"))
        assert [r[3] for r in only] == [2]


def test_records_of_other_kinds(spark, tmp_path):
    def raw(kind, block, *lines, length=None):
        head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}>", *lines, f"Content-Length: {len(block) if length is None else length}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    info = raw("warcinfo", b"software: x\r\nformat: y\r\n", "Content-Type: application/warc-fields")
    resource = raw("resource", b"one\r\n\r\ntwo", "Content-Type: text/plain", "X-Note: a", "x-note: b", "X-Long: first", "\tsecond")
    request = raw("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request")
    response = record(5, "http://a", b"body \r\n\r\n of it", None, "2020-01-01T00:00:00Z")
    empty = raw("metadata", b"")
    want = {"warcinfo": b"software: x\r\nformat: y\r\n", "resource": b"one\r\n\r\ntwo", "request": b"", "response": b"body \r\n\r\n of it", "metadata": b""}
    parts = [info, resource, request, response, empty]
    (tmp_path / "a.warc").write_bytes(b"".join(parts) + b"\r\n")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(member, parts)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "notes.txt").write_text("no archive")
    for name in ("a.warc", "b.warc.gz", "c.warc.gz"):
        got = list(read_records(str(tmp_path / name)))
        assert {r[0]: r[8] for r in got} == want and all(r[6] == len(r[8]) for r in got)
        headers = next(r[7] for r in got if r[0] == "resource")
        assert headers["x-note"] == "a, b" and headers["x-long"] == "first second"
        assert [r[3] for r in read_records(str(tmp_path / name), lambda h: h["warc-type"] == "response", False)] == [5]
    for make in (member, gzip.compress):  # a length that is no number
        (tmp_path / "d").write_bytes(make(raw("resource", b"abc", length="x1")) + make(resource))
        assert [r[8] for r in read_records(str(tmp_path / "d"))] == [b"abc", want["resource"]]
    df = read_warc(spark, f"file://{tmp_path}")
    assert df.count() == 15 and df.filter("record_type = 'resource'").select("payload").distinct().count() == 1


def test_empty_table_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a", "c"), (1, "u", "a", "c"), (0, "u", "a", "c")], "page_id long, url string, html string, payload string")
    files = write_warc(df, f"file://{tmp_path}/r")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in page_digests(spark, f"file://{tmp_path}/r", files).collect()) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    files = write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert page_digests(spark, f"file://{tmp_path}/e", files).count() == 0
