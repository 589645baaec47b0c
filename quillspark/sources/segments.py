"""Indexes on disk: immutable versioned folders and a manifest that names the current one.

A segment is a folder of Parquet tables named by the corpus' fingerprint.  It is
written beside the others and becomes visible when the manifest changes; readers resolve
the manifest once per query, so a swap never mixes two versions.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.index import STORED, Field, Index
from quillspark.operators.records import fingerprints
from quillspark.operators.search import local_rows

FORMAT = "1"
#: Segments that are kept at most.
MOST = 32
_TABLES = ("postings", "documents", "field_stats", "vocabulary")


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where it is unset, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def segment_id(records: DataFrame, fields: Sequence[Field], key: str = "doc_id") -> str:
    """SHA-256 over the format, the schema and all documents: equal input, equal id."""
    have = set(records.columns)
    names = [f.name for f in fields if f.name in have]
    form = json.dumps([FORMAT, [asdict(f) for f in fields]], sort_keys=True)
    # Two levels: a digest per group of documents, then one over those, so nothing unbounded is gathered.
    rows = records.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(1024)))
    groups = fingerprints(rows, "__group", key, names)
    row = groups.agg(F.sha2(F.concat(F.lit(form), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__group", "fingerprint"))), lambda x: x.fingerprint), "\n")), 256)).first()
    return row[0]


def manifest(spark: SparkSession, folder: str) -> dict | None:
    fs, p = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a file in place by one rename over the old one: readers see the old or the new text."""
    jvm = spark._jvm
    part, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.{uuid.uuid4().hex}", path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()), spark._jsc.hadoopConfiguration())
    fs, _ = _fs(spark, path)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    option = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    option[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, target, option)


def index_fields(index: Index) -> list[str]:
    return [f.name for f in index.schema if f.kind != STORED]


def save(index: Index, folder: str, name: str, created: str, provenance: dict[str, str] | None = None) -> bool:
    """Write a segment unless it is there; then point the manifest at it.  True if it was written.

    A segment written in part (no ``_complete`` mark) is written again.
    """
    spark = index.postings.sparkSession
    fs, mark = _fs(spark, f"{folder}/{name}/_complete")
    new = not fs.exists(mark)
    if new:
        # Ordered by term, so a point read opens the files and row groups of its terms; the field is the same word's.
        index.postings.repartitionByRange("term", "field", "doc_id").sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{folder}/{name}/postings")
        index.documents.write.mode("overwrite").parquet(f"{folder}/{name}/documents")
        # The corpus is analyzed once: what follows comes from the written postings.
        postings = spark.read.parquet(f"{folder}/{name}/postings")
        vocabulary = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
        vocabulary.repartitionByRange("term", "field").sortWithinPartitions("term", "field").write.mode("overwrite").parquet(f"{folder}/{name}/vocabulary")
        names = index_fields(index)
        count = spark.read.parquet(f"{folder}/{name}/documents").count()
        totals = {r.field: r.total for r in spark.read.parquet(f"{folder}/{name}/vocabulary").groupBy("field").agg(F.sum("total").alias("total")).collect()}
        stats = [(f, count, totals.get(f, 0), totals.get(f, 0) / count) for f in names] if count else []
        spark.createDataFrame(stats, "field string, documents bigint, total_terms bigint, average double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/field_stats")
        write_text(spark, f"{folder}/{name}/schema.json", json.dumps([asdict(f) for f in index.schema]))
        write_text(spark, f"{folder}/{name}/_complete", created)
    old = manifest(spark, folder) or {}
    at = old.get("created_at") if old.get("latest_segment_id") == name else created
    count = spark.read.parquet(f"{folder}/{name}/documents").count()
    write_text(spark, f"{folder}/manifest.json", json.dumps({"latest_segment_id": name, "created_at": at, "doc_count": count, "provenance": provenance or {}}))
    return new


def load(spark: SparkSession, folder: str, name: str | None = None) -> Index | None:
    """A segment by name, or the manifest's; None where there is none."""
    name = name or (manifest(spark, folder) or {}).get("latest_segment_id")
    if not name:
        return None
    fs, mark = _fs(spark, f"{folder}/{name}/_complete")
    if not fs.exists(mark):
        return None
    schema = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{name}/schema.json").collect()))
    tables = {t: spark.read.parquet(f"{folder}/{name}/{t}") for t in _TABLES}
    # A row a field of the schema: kept at hand, so that no search reads a file for it.
    stats = [tuple(r) for r in tables["field_stats"].collect()]
    tables["field_stats"] = local_rows(spark, stats, "field string, documents bigint, total_terms bigint, average double")
    tables["vocabulary"] = tables["vocabulary"].select("field", "term", "df")
    return Index(tuple(Field(**f) for f in schema), **tables)


def segments(spark: SparkSession, folder: str) -> list[str]:
    """Complete segments, the newest first."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{s.getPath().getName()}/_complete"))]
    return [name for _, name in sorted(found, reverse=True)]


def prune(spark: SparkSession, folder: str, keep: Sequence[str] | None = None, most: int = MOST) -> list[str]:
    """Delete segments that aren't among ``keep``, or beyond the newest ``most``; the current one stays."""
    current = (manifest(spark, folder) or {}).get("latest_segment_id")
    names = segments(spark, folder)
    stay = set(keep if keep is not None else names[:most]) | {current}
    gone = [n for n in names if n not in stay]
    for n in gone:
        fs, p = _fs(spark, f"{folder}/{n}")
        fs.delete(p, True)
    return gone


def merge(old: Index, changed: DataFrame, build, key: str = "doc_id") -> Index:
    """``old`` with the documents of ``changed`` replaced or added; other postings stay as they are."""
    new = build(changed)
    ids = new.documents.select("doc_id")
    postings = old.postings.join(ids, "doc_id", "left_anti").unionByName(new.postings)
    documents = old.documents.join(ids, "doc_id", "left_anti").unionByName(new.documents, allowMissingColumns=True)
    lengths = postings.groupBy("field", "doc_id").agg(F.max("doc_length").alias("n")).groupBy("field").agg(F.sum("n").alias("total_terms"))
    count = documents.agg(F.count("*").alias("documents"))
    stats = lengths.crossJoin(count).select("field", "documents", "total_terms", (F.col("total_terms") / F.greatest("documents", F.lit(1))).alias("average"))  # one row
    return Index(old.schema, postings, documents, stats, postings.groupBy("field", "term").agg(F.count("*").alias("df")))
