import base64
import gzip
import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from codeloom.llm import warc_zip as wz


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_that_others_read(zip64):
    members = [("a/data", b"x" * 1000), ("é.txt", b""), ("c", bytes(range(256)))]
    raw = wz.zip_stored(members, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    source = wz.BytesSource(raw)
    for name, m in wz.directory(source).items():
        assert source.read(wz.place(source, m), m.size) == dict(members)[name]


@pytest.mark.parametrize("comment", [b"", b"a note PK\x05\x06 inside", b"n" * 65535])
def test_archives_that_others_wrote(comment, tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        with z.open("big", "w", force_zip64=True) as f:
            f.write(b"data" * 100)
        z.writestr("small", b"s")
        z.writestr(zipfile.ZipInfo("packed"), b"p" * 1000, zipfile.ZIP_DEFLATED)
        z.comment = comment
    source = wz.FileSource(str(path))
    found = wz.directory(source)
    assert source.read(wz.place(source, found["big"]), found["big"].size) == b"data" * 100
    with pytest.raises(ValueError, match="not stored"):
        wz.place(source, found["packed"])


def test_many_members_need_zip64():
    members = [(f"m{i}", b"%d" % i) for i in range(70_000)]
    raw = wz.zip_stored(members)
    source = wz.BytesSource(raw)
    found = wz.directory(source)
    assert len(found) == 70_000 and source.read(wz.place(source, found["m69999"]), 5) == b"69999"
    assert len(zipfile.ZipFile(io.BytesIO(raw)).namelist()) == 70_000


@pytest.mark.parametrize("raw", [b"", b"PK", b"x" * 100, wz.zip_stored([("a", b"b")])[:-5]])
def test_broken_archives(raw):
    with pytest.raises(ValueError, match="end of central directory"):
        wz.directory(wz.BytesSource(raw))


def test_records():
    payload = b"<html>\r\n\r\n body"
    package = wz.Package()
    digest = wz.digest32(payload)
    package.add(wz.record("response", 5, "http://x/\r\nEvil: 1", payload, digest), "response", 5, digest)
    package.add(wz.record("revisit", 3, None, payload, digest, 5), "revisit", 3, digest)
    raw = package.finish()
    (a, _, body), (b, http, nothing) = wz.read_records(wz.BytesSource(raw))
    assert body == payload and nothing == b"" and http["content-length"] == str(len(payload))
    assert a["warc-target-uri"] == "http://x/%0D%0AEvil: 1" and "evil" not in a and "warc-target-uri" not in b
    assert b["warc-refers-to"] == a["warc-record-id"] == "<urn:page:5>"
    assert digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # a run of gzip members is a gzip file
        assert gzip.decompress(z.read(wz.RECORDS)).count(b"WARC/1.1") == 2


def brute(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == payload and p is not None), default=None)
        revisit = top is not None and (page is None or page < top)
        out.append((page, len(payload), wz.digest32(payload), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def test_query(spark, make_tables):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 3_000_000), (6, "u\n", "one\r\n\r\ntwo"), (2, "http://b", "<p>x</p>"), (None, "n", "<p>x</p>"), (None, "n", "alone")]
    rows += [(100 + i, "c", "copy") for i in range(50)]
    got = wz.op9_warc_zip(spark, make_tables(pages=rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert wz.op9_warc_zip(spark, make_tables()).collect() == []


def test_payloads_and_packages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<b>{i % 3}</b>" * 50) for i in range(40)], "page_id long, url string, html string").withColumns({"first": F.lit(1), "sha1": F.lit("x")})
    packages = wz.pack(wz.plan(pages, least_bytes=10**6), limit=2000).cache()
    assert packages.count() > 3
    found = wz.unpack(packages, with_payload=True).collect()
    assert {r.record_type for r in found} == {"response"}
    assert {int(r.record_id): (r.target, bytes(r.payload).decode()) for r in found} == {i: (f"u{i}", f"<b>{i % 3}</b>" * 50) for i in range(40)}
