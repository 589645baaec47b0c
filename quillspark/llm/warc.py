"""A content-addressed WARC archive.

An archive is two tables in one folder:

* ``payloads`` (digest, payload): the bytes once by SHA-256;
* ``headers`` (page_id, digest, header): each record's exact WARC and HTTP header.

A record is its header, its payload (response records only) and two line ends;
:func:`read_records` puts them together by joining on the digest.  The digest is
verified twice: writing, all payloads under one digest must agree in length and
SHA-1; reading, the digest is computed again from the stored bytes.

Copies fold before any exchange: payloads by ``dropDuplicates`` with a partial step
in each task, digests by an aggregation without the bytes.  A digest that a third of
all pages share is a skewed side of a sort-merge join against one row, which
adaptive execution splits.

Defined cases: a null html is an empty payload, a null url an empty target.  Of equal
payloads of ``REVISIT`` bytes or more the largest page_id is the response; pages
without id revisit it, or are all responses when none has one.  Repeated rows are
repeated records.  An empty table gives an empty archive.  Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_columns

#: Least payload, in bytes, that is stored as a revisit of an equal one.
REVISIT = 1000
#: WARC-Date of records whose capture time isn't known.
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_PAYLOAD, _HEADER = "digest string, payload binary", "page_id bigint, digest string, header binary"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _lines(*lines) -> Column:
    return F.concat(*(F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in line), F.lit("\r\n")) for line in lines))


def _header(revisit: Column) -> Column:
    """The WARC header, the HTTP header and the empty lines behind both."""
    size = F.col("n").cast("string")
    http = _lines(("HTTP/1.1 200 OK",), ("Content-Type: text/html; charset=utf-8",), ("Content-Length: ", size), ("",))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    kind = F.when(revisit, F.lit("revisit")).otherwise("response")
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    revisited = F.when(revisit, _lines(("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",), ("WARC-Refers-To: ", _id(F.col("last"))))).otherwise("")
    return F.concat(
        _lines(("WARC/1.1",), ("WARC-Type: ", kind), ("WARC-Record-ID: ", _id(F.col("page_id"))), ("WARC-Date: ", DATE), ("WARC-Target-URI: ", target)),
        revisited,
        _lines(("WARC-Payload-Digest: sha1:", F.col("sha1")), ("Content-Type: application/http;msgtype=response",), ("Content-Length: ", block.cast("string")), ("",)),
        http,
    )


def write_archive(pages: DataFrame, folder: str, least: int = REVISIT) -> None:
    """A record per page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = doc_columns(pages, ("page_id", "bigint"), ("url", "string"), ("html", "string"))
    each = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    heads = each.drop("payload")
    groups = heads.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"))
    sound = (F.col("n0") == F.col("n1")) & (F.col("s0") == F.col("s1"))
    groups = groups.filter((F.col("copies") > 1) & (F.col("n1") >= least)).select("digest", F.when(sound, F.col("last")).otherwise(F.raise_error(F.concat(F.lit("unlike payloads under "), "digest")).cast("bigint")).alias("last"))
    named = heads.join(groups, "digest", "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    each.select("digest", "payload").dropDuplicates(["digest"]).write.mode("overwrite").parquet(f"{folder}/payloads")
    named.select("page_id", "digest", F.encode(_header(revisit), "utf-8").alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, payload): every record's bytes, and its full payload, of revisits too."""
    payloads = spark.read.schema(_PAYLOAD).parquet(f"{folder}/payloads")
    headers = spark.read.schema(_HEADER).parquet(f"{folder}/headers")
    revisit = F.col("header").contains(F.lit(b"\r\nWARC-Type: revisit\r\n"))
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), "digest")).cast("binary")
    payload = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong)
    joined = headers.join(payloads, "digest").withColumn("payload", payload)
    return joined.select(F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(_END)).alias("record"), "payload")


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields by lower-case name, the block's payload behind its HTTP header, where the record ends)."""
    end = data.index(_END, at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    start = end + len(_END)
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != _END:
        raise ValueError(f"the record at {at} doesn't end where its length says")
    block = data[start:stop]
    return fields, block[block.index(_END) + len(_END) :], stop + 4


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def parse_records(records: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) from
    :func:`read_records`; the digest is computed from the bytes and held against the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record, payload in zip(batch.column(0), batch.column(1)):
                payload = payload.as_py()
                fields, own, _ = parse_record(record.as_py())
                sha1 = hashlib.sha1(payload).hexdigest()
                kind = fields["warc-type"]
                if fields["warc-payload-digest"] != f"sha1:{sha1}" or own != (payload if kind == "response" else b""):
                    raise ValueError(f"record {fields['warc-record-id']} doesn't hold its payload")
                out.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], len(payload), sha1, kind, _page(fields.get("warc-refers-to"))))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, types)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return records.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def export_warc(records: DataFrame, folder: str, per_file: int = 20_000) -> None:
    """The records as .gz files of plain WARC, for text payloads; per_file bounds a reader's memory."""
    body = F.decode(F.expr(f"substring(record, 1, length(record) - {len(_END)})"), "utf-8")
    records.select(body.alias("value")).write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).mode("overwrite").text(folder)


def import_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(fields, payload) of every record in a folder of .gz or plain WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                at, fields, payloads = 0, [], []
                while at < len(data):
                    head, payload, at = parse_record(data, at)
                    fields.append(list(head.items()))
                    payloads.append(payload)
                    if len(fields) == 500 or at >= len(data):
                        yield pa.RecordBatch.from_arrays([pa.array(fields, kind), pa.array(payloads, pa.binary())], ["fields", "payload"])
                        fields, payloads = [], []

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(run, "fields map<string,string>, payload binary")
