import base64
import hashlib

from utterloom.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def expected(pages):
    out, top = [], {}
    for page, _, html in pages:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    for page, _, html in pages:
        data = (html or "").encode()
        response = page == top.get(html or "")
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else top.get(html or "")))
    return sorted(out, key=repr)


def check(spark, tmp_path, pages, split="128m"):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "warc"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert sorted(map(tuple, warc.read(spark, str(tmp_path / "warc")).collect()), key=repr) == expected(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_copies_nulls_and_empty_payloads(spark, tmp_path):
    check(spark, tmp_path, [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "http://b", ""), (7, "http://a/", "é日"), (None, "q", "x")])


def test_magic_in_payloads_and_many_splits(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"page {i} " + ("filler " * (i % 7)) + (FAKE * (i % 4) if i % 3 == 0 else "") + "WARC/1.0\r\n" * (i % 5 == 0) + f" tail {i}") for i in range(200)]
    pages.append((500, "http://long", "WARC/1.0\r\nContent-Length: 7000\r\n\r\n" + "y" * 20_000 + FAKE + "z" * 9_000))
    check(spark, tmp_path, pages, "4k")


def test_no_pages(spark, tmp_path):
    check(spark, tmp_path, [])


def test_foreign_payload_bytes():
    data = b"\xff\x00\xfe" * 10
    made = warc.record(5, "u", data, warc.base32_sha1(data), len(data), 5, False)
    span, need = warc.span_of(made[len(warc.MAGIC) :])
    assert span == len(made) + len(warc.END) and need == len(made) - len(warc.MAGIC)
    assert warc.parse(made[len(warc.MAGIC) :]) == (5, 30, warc.base32_sha1(data), "response", None)
