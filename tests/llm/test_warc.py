"""op6: both archive formats, the round trip, revisits."""

import glob
import gzip
import hashlib

import pytest

from quillon.llm import warc


def rows():
    long = "<p>é</p>" * 300
    tricky = "WARC/1.0\r\nContent-Length: 3\r\n\r\nfoo\r\n\r\nfiledesc://x 1 2 3 4\n" * 30
    return [
        (1, "http://a/b c", long), (2, None, long), (3, "http://a", long), (3, "http://a", long), (4, "u", "short"), (5, "u", "short"), (6, "u", ""), (7, "u", None),
        (8, "u\nv", tricky), (9, "u", tricky), (None, "u", tricky), (None, "u", "n"), (10, "u", "x" * 3_000_000), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "z" * 1000), (14, "u", "z" * 1000),
    ]


def want(pages):
    top = {}
    for page, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 1000 and page is not None:
            top[body] = max(top.get(body, page), page)
    out = []
    for page, _, html in pages:
        body = (html or "").encode()
        target = top.get(body)
        revisit = target is not None and (page is None or page < target)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", target if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [500, 8 << 20])
def test_round_trip(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as top").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    found = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == want(rows())
    assert {r.url for r in found if r.page_id in (1, 2, 8)} == {"http://a/b%20c", "about:blank", "u%0Av"}
    kinds = {"response": 0, "revisit": 0}
    for name in glob.glob(path + "/*.gz"):
        for fields, block in warc.read_warc(gzip.open(name).read()):
            kinds[fields["warc-type"]] += 1
            assert fields["warc-date"] == "2020-01-01T00:00:00Z" and len(block) == int(fields["content-length"])
            assert ("warc-refers-to" in fields) == (fields["warc-type"] == "revisit") == ("warc-block-digest" not in fields)
    assert kinds["revisit"] == sum(w[3] == "revisit" for w in want(rows()))


def test_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_legacy_archives(version):
    blocks = [b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody\n\nwith lines", b"no header at all", b""]
    arc = warc.arc_header(version, "x.arc") + b"".join(warc.arc_record(version, "x.arc", 9, f"http://h/{i}", b, "19991231235959") for i, b in enumerate(blocks))
    read = list(warc.read_arc(arc))
    assert [b for _, b in read] == blocks and len(read[0][0]) == (5 if version == 1 else 10)
    records = list(warc.read_warc(warc.convert(arc, {})))
    assert [f["warc-type"] for f, _ in records] == ["response", "resource", "resource"]
    assert records[0][0]["warc-date"] == "1999-12-31T23:59:59Z" and records[0][0]["warc-record-id"].startswith("<urn:uuid:")
    assert records[0][0]["warc-payload-digest"] == "sha1:" + hashlib.sha1(b"body\n\nwith lines").hexdigest()
    assert len({f["warc-record-id"] for f, _ in records}) == 3
    assert warc.convert(arc, {}) == warc.convert(arc, {})


def test_broken_archives():
    good = warc.arc_header(1, "x") + warc.arc_record(1, "x", 0, "u", b"abc")
    for bad in (good[:-3], good.replace(b"filedesc", b"filedisc"), good + b"u 0 1\n", good + b"u 0.0.0.0 20200101000000 t 5", warc.arc_header(1, "x").replace(b"\n1 0", b"\n9 0")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    record = warc.convert(good, {})
    for bad in (record[:-2], record[5:], record[:20]):
        with pytest.raises(ValueError):
            list(warc.read_warc(bad))
    with pytest.raises(ValueError):
        warc.warc_date("2020")


def test_archives_that_exist(spark, tmp_path):
    """Files of both versions, compressed or not, with payloads that are no text."""
    payload = bytes(range(256)) * 3
    for version, name in ((1, "a.arc"), (2, "b.arc.gz")):
        data = warc.arc_header(version, name) + warc.arc_record(version, name, 0, "http://x/y z", b"HTTP/1.1 200 OK\r\n\r\n" + payload) + warc.arc_record(version, name, 9, "dns:x", b"raw\n\n")
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    rows = {r.path.rsplit("/", 1)[-1]: bytes(r.warc) for r in warc.convert_files(spark, str(tmp_path)).collect()}
    assert sorted(rows) == ["a.arc", "b.arc.gz"]
    for data in rows.values():
        (first, block), (second, raw) = warc.read_warc(data)
        assert warc.split_http(block)[1] == payload and first["warc-type"] == "response" and first["warc-target-uri"] == "http://x/y%20z"
        assert raw == b"raw\n\n" and second["warc-type"] == "resource"
