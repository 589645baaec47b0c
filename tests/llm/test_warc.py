import hashlib

import pytest

from quillspark.llm import warc
from quillspark.llm.common import new_path

PAGES = "page_id bigint, url string, html string, digest string, payload string"
BIG = "é" * 700
ROWS = [
    (1, "http://a/1", BIG, "", ""),
    (5, "http://a/5", BIG, "", ""),
    (3, "http://a/3\r\nX: y", BIG, "", ""),
    (2, None, None, "", ""),
    (4, "http://a/4", "", "", ""),
    (6, "http://a/6", "short", "", ""),
    (7, "http://a/7", "short", "", ""),
    (8, "http://a/8", "tricky\r\n\r\nWARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "x" * 1000, "", ""),
    (9, "http://a/9", "y" * 1000, "", ""),
    (9, "http://a/9", "y" * 1000, "", ""),
    (None, "http://a/n", "y" * 1000, "", ""),
]


@pytest.fixture(scope="module")
def folder(spark):
    path = new_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    return path


def test_round_trip(spark, folder):
    got = sorted(warc.parse_records(warc.read_records(spark, folder)).collect(), key=str)
    want = []
    for page_id, _, html, _, _ in ROWS:
        b = (html or "").encode()
        ids = [r[0] for r in ROWS if (r[2] or "").encode() == b and r[0] is not None]
        revisit = len(b) >= 1000 and page_id != max(ids)
        want.append((page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)


def test_payloads_are_stored_once(spark, folder):
    assert spark.read.parquet(f"{folder}/payloads").count() == len({r[2] or "" for r in ROWS})


def test_files(spark, folder):
    out = new_path(spark, "warc-files")
    records = warc.read_records(spark, folder)
    warc.export_warc(records, out, per_file=3)
    got = [(r.fields["warc-type"], bytes(r.payload)) for r in warc.import_warc(spark, out).collect()]
    assert len(got) == len(ROWS)
    assert sorted(p for k, p in got if k == "response") == sorted(bytes(r.payload) for r in records.collect() if b"\r\nWARC-Type: response" in bytes(r.record)[:60])


def test_damage_is_found(spark):
    path = new_path(spark, "warc-bad")
    warc.write_archive(spark.createDataFrame(ROWS[:2], PAGES), path)
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('other' AS binary) AS payload").collect()
    spark.createDataFrame(bad, "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, path).collect()


def test_empty(spark):
    path = new_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], PAGES), path)
    assert warc.parse_records(warc.read_records(spark, path)).count() == 0
