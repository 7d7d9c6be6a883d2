import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from separatrix.llm import archives
from separatrix.llm.queries.archives import op6_arc_to_warc

V1 = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 20\n1 0 Example\nmore..\n\n\n"


def record(url, body, version=1):
    block = b"HTTP/1.0 200 OK\r\nX-Place: 7\r\n\r\n" + body
    fields = [url, b"1.2.3.4", b"20010203040506", b"text/html"]
    if version == 2:
        fields += [b"200", b"-", b"-", b"0", b"a.arc"]
    return b" ".join([*fields, b"%d" % len(block)]) + b"\n" + block + b"\n"


def test_versions_lengths_and_compression():
    one = V1 + record(b"http://a/", b"line\n\nhttp://b/ 1.2.3.4 2001 text/html 5\n")
    for data in (one, gzip.compress(one), gzip.compress(V1) + gzip.compress(one[len(V1) :])):
        (got,) = archives.parse_arc(data)
        assert got["version"] == 1 and got["url"] == "http://a/" and got["block"].endswith(b"text/html 5\n") and got["problem"] is None
    (two,) = archives.parse_arc(record(b"http://c/", b"x" * 200_000, 2))
    assert two["version"] == 2 and two["status"] == 200 and len(two["block"]) == two["length"]


def test_damaged_archives():
    short = list(archives.parse_arc(record(b"http://a/", b"abc")[:-3]))
    assert len(short) == 1 and "declared" in short[0]["problem"]
    bad = list(archives.parse_arc(record(b"http://a/", b"abc") + b"what is this\n" + record(b"http://b/", b"d")))
    assert [r["problem"] is None for r in bad] == [True, False]
    assert list(archives.parse_arc(b"")) == [] and list(archives.parse_warc(b"\r\n")) == []
    assert [bool(r["problem"]) for r in archives.parse_warc(b"WARC/1.0\r\nContent-Length: x\r\n\r\n")] == [True]


def test_round_trip_of_pages(spark, tmp_path):
    same, small = "é" * 60, "s" * 99
    pages = [(5, "http://a b/\n", same), (2, None, same), (9, "u", same + "\r\n\r\n"), (1, "u", small), (3, "u", small), (4, "u", None), (6, "u", ""), (7, "u", "x" * 300_000), (8, "u", "x" * 300_000), (-3, "u", "x" * 300_000), (None, "u", "n\r\nX-Place: 5\r\n" + same)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, block string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in op6_arc_to_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        raw = (html or "").encode()
        same_ones = [p for p, _, h in pages if p is not None and (h or "") == (html or "")]
        first = min(same_ones) if len(raw) >= 100 and page is not None else page
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if page is not None and first < page else ("response", None))
    frame.limit(0).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert op6_arc_to_warc(spark, f"{tmp_path}/none").count() == 0


def test_converted_fields(spark, tmp_path):
    (tmp_path / "in").mkdir()
    plain = b"dns:a 1.1.1.1 2001 text/dns 3\nabc\n"
    (tmp_path / "in" / "a.arc.gz").write_bytes(gzip.compress(V1 + record(b"http://a/", b"p" * 120) + plain))
    converted = archives.mark_revisits(archives.convert(archives.read_arc(spark, str(tmp_path / "in"))))
    rows = {r["uri"]: r for r in converted.collect()}
    assert rows["http://a/"]["moment"] == "2001-02-03T04:05:06Z" and rows["http://a/"]["place"] == 7 and rows["http://a/"]["warc_type"] == "response"
    assert rows["dns:a"]["moment"] == "2001-01-01T00:00:00Z" and rows["dns:a"]["warc_type"] == "resource" and rows["dns:a"]["place"] is None
    archives.write_warc(converted, str(tmp_path / "out"))
    back = archives.read_warc(spark, str(tmp_path / "out")).withColumn("id", F.col("headers")["WARC-Record-ID"]).collect()
    assert {r["id"] for r in back} == {r["record_id"] for r in rows.values()} and all(r["problem"] is None for r in back)
    assert {bytes(r["block"])[-3:] for r in back} == {b"ppp", b"abc"}


def test_urls_like_version_blocks_and_a_version_block_in_each_file(spark, tmp_path):
    pages = [(i, f"filedesc://{i} x", f"page {i}") for i in range(7)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["page_id"] for r in op6_arc_to_warc(spark, str(tmp_path)).collect()) == list(range(7))
    rows = frame.select("url", F.lit("1.1.1.1").alias("ip"), F.lit("2001").alias("date"), F.lit("text/html").alias("mime"), F.col("html").alias("block"))
    for version in (1, 2):
        archives.write_arc(rows, f"{tmp_path}/arc{version}", version, 3)
        files = [gzip.open(f).read() for f in glob.glob(f"{tmp_path}/arc{version}/*.gz")]
        assert len(files) == 3 and all(f.startswith(b"filedesc://separatrix.arc ") and f.split(b"\n")[1].startswith(b"%d 0 " % version) for f in files)
        back = archives.sound(archives.read_arc(spark, f"{tmp_path}/arc{version}")).collect()
        assert sorted((r["url"], bytes(r["block"]).decode(), r["version"]) for r in back) == [(f"filedesc://{i}%20x", f"page {i}", version) for i in range(7)]


def test_query_fails_on_an_unreadable_file(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(archives, "write_arc", lambda rows, path: rows.select(F.lit("what is this").alias("value")).write.text(path))
    with pytest.raises(Exception, match="header line: what is this"):
        op6_arc_to_warc(spark, str(tmp_path)).collect()


def test_urls_with_spaces():
    for version, names in ((1, archives.VERSION_1), (2, archives.VERSION_2)):
        opening = V1 if version == 1 else b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 a.arc 20\n2 0 Example\nmore..\n\n\n"
        for start in (opening, b""):
            data = start + record(b"http://a/one two  three?4 5", b"abc", version) + record(b"http://b/", b"d", version)
            got = list(archives.parse_arc(data))
            assert [r["url"] for r in got] == ["http://a/one two  three?4 5", "http://b/"] and all(r["version"] == version and r["problem"] is None for r in got)


def test_padding_behind_members():
    one, two = record(b"http://a/", b"x" * 100), record(b"http://b/", b"y")
    for zeros in (1, 511, 1 << 17):
        padded = gzip.compress(V1) + gzip.compress(one) + b"\0" * zeros + gzip.compress(two) + b"\0" * zeros
        assert [(r["url"], r["problem"]) for r in archives.parse_arc(padded)] == [("http://a/", None), ("http://b/", None)]
    broken = [gzip.compress(one) + b"what is this", gzip.compress(one)[:-12], gzip.compress(one)[:30]]
    for data in broken:
        assert list(archives.parse_arc(data))[-1]["problem"].startswith(("gzip", "block", "header"))
    assert list(archives.parse_warc(gzip.compress(b"WARC/1.1\r\nContent-Length: 1\r\n\r\na\r\n\r\n") + b"?"))[-1]["problem"].startswith("gzip")


def test_header_bytes_are_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    block = b"HTTP/1.0 200 OK\r\nServer: caf\xe9\r\nX-Place: 3\r\n\r\n\xff\xfe body"
    (tmp_path / "in" / "a.arc").write_bytes(V1 + b"http://a/ 1.2.3.4 20010203040506 text/html %d\n" % len(block) + block + b"\n")
    converted = archives.mark_revisits(archives.convert(archives.read_arc(spark, str(tmp_path / "in"))))
    archives.write_warc(converted, str(tmp_path / "out"))
    (back,) = archives.read_warc(spark, str(tmp_path / "out")).collect()
    assert bytes(back["block"]) == block


def test_large_records_go_to_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "LARGE", 100)
    monkeypatch.setattr(archives, "FILE_BYTES", 1000)
    pages = [(f"u{i}", "1.1.1.1", "2001", "text/html", "x" * (450 if i % 5 == 0 else 10)) for i in range(20)]
    rows = spark.createDataFrame(pages, "url string, ip string, date string, mime string, block string").coalesce(1)
    archives.write_arc(rows, f"{tmp_path}/arc")
    files = {f: len(gzip.open(f).read()) for f in glob.glob(f"{tmp_path}/arc/**/*.gz", recursive=True)}
    # Two of 450 bytes in a file, and ten small ones; header lines and version blocks come on top.
    assert len(files) == 4 and max(files.values()) < 1400
    back = archives.sound(archives.read_arc(spark, f"{tmp_path}/arc")).collect()
    assert sorted((r["url"], r["length"]) for r in back) == sorted((p[0], len(p[4])) for p in pages)
