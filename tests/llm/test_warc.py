import base64
import hashlib

from uqframe.llm import warc
from uqframe.sources.session import new_path

SCHEMA = "page_id long, url string, html string, payload string"
ROWS = [(1, "http://a/1", "<p>x</p>", "c"), (2, None, "<p>x</p>", "c"), (3, "http://a/\r\nb é", "", "c"),
        (4, "u", None, "c"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9, "c"), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 9, "c"),
        (None, "u", "<p>x</p>", "c"), (7, "u", "<p>x</p>", "c"), (8, "u", "y" * 300_000, "c")]


def brute(rows):
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, _ in rows if (h or "") == (html or "") and p is not None]
        last = max(same, default=None)
        revisit = page is not None and page != last
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_report_and_empty(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert sorted(map(tuple, warc.archive_report(df).collect()), key=str) == brute(ROWS)
    assert warc.archive_report(df.where("false")).count() == 0


def test_selected_records_by_ranges(spark):
    rows = [(k, f"http://h/{k}", f"page {k} " * (k % 50), "c") for k in range(400)]
    folder = new_path(spark, "archives")
    index = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), folder)
    some = warc.read_records(index.where("page_id % 7 = 0"), folder).collect()
    assert {r.page_id for r in some} == set(range(0, 400, 7))
    text = {k: h for k, _, h, _ in rows}
    assert all(r.payload.decode() == text[r.page_id] for r in some if r.record_type == "response")


def test_min_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = warc.archive_report(df, min_bytes=9).collect()
    assert {r.page_id for r in got if r.record_type == "revisit"} == set()
