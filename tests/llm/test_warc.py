import base64
import gzip
import hashlib

import pytest

from netsentry.llm import warc as A


def arc(version, records, ending=b"\n"):
    about = f"{version} 0 Someone\n{' '.join(A.FIELDS[version])}\n".encode()
    middle = "" if version == 1 else "200 - - 0 x.arc "
    out = f"filedesc://x.arc 0.0.0.0 20200102030405 text/plain {middle}{len(about)}\n".encode() + about + b"\n"
    for url, date, content in records:
        out += f"{url} 1.2.3.4 {date} text/html {middle}{len(content)}\n".encode() + content + ending
    return out


PAGE = b"HTTP/1.1 200 OK\r\nX-Record-Key: 7\r\n\r\n<p>\n\r\n\r\nfiledesc://not a record</p>"


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_both_versions(version, pack):
    raw = arc(version, [("http://a.b/c d", "20240506070809", PAGE), ("dns:a.b", "202405060708", b""), ("http://x/", "20240506070809", PAGE)])
    records = list(A.parse_arc(pack(raw)))
    assert [r.fields["URL"] for r in records] == ["http://a.b/c d", "dns:a.b", "http://x/"]
    assert records[0].payload == PAGE.split(b"\r\n\r\n", 1)[1] and records[0].key == 7
    assert records[1].payload == b"" and records[1].key is None and records[1].header == b""
    assert {r.version for r in records} == {version}
    assert A.iso_date(records[1].fields["Archive-date"]) == "2024-05-06T07:08:00Z"


def test_members_of_one_gzip_file():
    raw = arc(1, [("http://a/", "20240506070809", PAGE)])
    assert len(list(A.parse_arc(gzip.compress(raw[:90]) + gzip.compress(raw[90:])))) == 1


@pytest.mark.parametrize("change", [
    lambda raw: raw[:-10], lambda raw: raw[100:], lambda raw: raw.replace(b"1 0 Someone", b"3 0 Someone"),
    lambda raw: raw + b"no header line\n",
])
def test_broken_files_are_refused(change):
    with pytest.raises(ValueError):
        list(A.parse_arc(change(arc(1, [("http://a/", "20240506070809", PAGE)]))))


def test_round_trip_of_a_record():
    record = next(A.parse_arc(arc(2, [("http://a/", "20240506070809", PAGE)])))
    raw = A.to_warc(record, "x.arc", None) + b"\n" + A.to_warc(record, "x.arc", {"archive": "y", "offset": 5, "key": 3}) + b"\n"
    (first, block), (second, short) = A.parse_warc(raw)
    assert block == PAGE and short == PAGE.split(b"\r\n\r\n", 1)[0] + b"\r\n\r\n"
    assert first["warc-type"] == "response" and second["warc-type"] == "revisit"
    assert first["warc-date"] == "2024-05-06T07:08:09Z" and first["warc-ip-address"] == "1.2.3.4"
    assert second["warc-refers-to"] == A.record_id("y", 5) and second["x-refers-to-key"] == "3"
    assert first["warc-record-id"] == A.record_id("x.arc", record.offset) != A.record_id("x.arc", 0)
    with pytest.raises(ValueError):
        list(A.parse_warc(raw[:-6]))


PAGES = [
    (3, "http://a/ b", "<p>same</p>"), (1, "http://b/\nc", "<p>same</p>"), (2, None, "<p>other ü 日本</p>\r\n\r\nWARC/1.1\r\n"),
    (4, "", None), (5, "x", ""), (5, "x", ""), (None, "y", "<p>same</p>"), (None, "z", "alone"), (6, "long", "<b>x</b>\n" * 50_000),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5, 10**9])
def test_pages(spark, least):
    pages = spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id bigint, url string, html string, payload_bytes int, digest string")
    rows = A.pages_through_archives(pages.repartition(3), least).collect()
    assert len(rows) == len(PAGES)
    want = []
    for number, (page, _, html) in enumerate(PAGES):
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        size = len((html or "").encode())
        first = size < least or page is not None and page == min(same) and (page, html) not in [(p, h) for p, _, h in PAGES[:number]]
        first = first or not same
        want.append((page, size, digest(html), "response" if first else "revisit", None if first else min(same)))
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_many_shares_give_what_one_gives(spark, tmp_path, monkeypatch):
    """Bitmaps of several buckets and shares of few archives; names of files that look like patterns."""
    html = [(k, "u", f"<p>{k % 40}</p>") for k in range(400)]
    pages = spark.createDataFrame(html, "page_id bigint, url string, html string")
    A.write_arc(pages.filter("page_id < 200"), str(tmp_path / "in" / "a[1]{b}"))
    A.write_arc(pages.filter("page_id >= 200"), str(tmp_path / "in" / "c*?"))
    files = [f"{tmp_path}/in/a\\[1\\]\\{{b\\}}/*.gz", f"{tmp_path}/in/c\\*\\?/*.gz"]
    found = []
    for bits in (1 << 25, 8192):
        A.convert(spark, files, str(tmp_path / f"out{bits}"), 0, bits)
        found.append(sorted(map(tuple, A.read_warc(spark, str(tmp_path / f"out{bits}")).collect())))
    assert found[0] == found[1] and len(found[0]) == 400
    assert sum(row[1] == "response" for row in found[0]) == 40
    assert all(row[8] == row[4] % 40 for row in found[0] if row[1] == "revisit")


def test_records_beyond_one_bitmap(spark, tmp_path):
    many = [(f"http://a/{k}", "20240506070809", b"x" if k % 2 else b"%d" % k) for k in range(A.BITMAP + 10)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.arc").write_bytes(arc(1, many))
    A.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = A.read_warc(spark, str(tmp_path / "out")).select("record_type", "url").collect()
    assert len(rows) == A.BITMAP + 10
    # Without keys the first by offset is the one to keep.
    assert {r.url for r in rows if r.record_type == "resource"} == {"http://a/1"} | {f"http://a/{k}" for k in range(0, A.BITMAP + 10, 2)}


def test_no_pages(spark):
    assert A.pages_through_archives(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_query_equals_sql(spark):
    from compare import database, difference

    from netsentry.llm.catalog import SQL, op8_warc

    folder = "/root/testdata/sf0.001"
    assert difference(spark, database(folder), op8_warc, SQL["op8_warc"], folder) is None
