"""Documents from folders, metadata files, sitemaps and archives of a repository.

Fetching (HTTP, git, browsers) isn't a data engine's work: these start from what has
been fetched.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text, urls
from quillspark.sources.segments import manifest, write_text

# Endings of documents, and folders that hold none.
EXTENSIONS = "md mdx markdown mdown mkd mkdn mdwn mdtxt mdtext rst rest txt text adoc asciidoc asc org".split()
SKIPPED = "__docs_metadata __search_segments __crawl_state .staging .git .hg .svn".split()
METADATA = "url string, title string, metadata struct<markdown_rel_path:string, document_key:string, status:string, last_fetched_at:string, indexed_at:string, next_due_at:string, retry_count:int>"


def relative(path: Column, folder: str) -> Column:
    """A file's path below a folder, whatever the scheme is written like."""
    bare = folder.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/")
    plain = F.regexp_replace(F.url_decode(F.regexp_replace(path, r"\+", "%2B")), r"^[a-z]+:/*", "")
    return F.substring(plain, F.instr(plain, bare) + len(bare) + 1, F.length(plain))


def _inside(rel: Column) -> Column:
    parts = F.split(rel, "/")
    return ~F.exists(parts, lambda p: p.isin(*SKIPPED) | p.startswith(".staging_"))


def document_files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(rel_path, modified, size, content) of every document below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(folder)
    rel = relative(F.col("path"), folder)
    return files.select(rel.alias("rel_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.decode("content", "utf-8").alias("content")).filter(_inside(F.col("rel_path")))


def metadata_files(spark: SparkSession, folder: str, below: str = "__docs_metadata") -> DataFrame:
    """(meta_path, modified, url, title, metadata) of every metadata file; unreadable ones have a null url.

    The folder of metadata is named itself: Spark's listing passes over names that
    begin with an underscore, in it and among documents.
    """
    folder = f"{folder.rstrip('/')}/{below}"
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").option("wholetext", True).text(folder)
    row = F.from_json("value", METADATA)
    return files.select(relative(F.col("_metadata.file_path"), folder).alias("meta_path"), F.col("_metadata.file_modification_time").alias("modified"), row.alias("r")).select("meta_path", "modified", "r.*")


def with_metadata(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row a document: a metadata row with its file, and files without metadata.

    ``error`` tells of metadata whose file is missing.  A file that metadata names isn't
    read a second time on its own.
    """
    target = F.coalesce("metadata.markdown_rel_path", F.regexp_replace("meta_path", r"\.meta\.json$", ".md"))
    named = metadata.select(target.alias("target"), "url", "title", F.col("metadata.last_fetched_at").alias("last_fetched_at"), F.col("metadata.indexed_at").alias("indexed_at"))
    joined = named.join(files, named["target"] == files["rel_path"], "left")
    first = joined.select(F.coalesce("rel_path", "target").alias("rel_path"), "url", "title", "last_fetched_at", "indexed_at", "modified", "content", F.when(F.col("rel_path").isNull(), "missing file").alias("error"))
    none = F.lit(None).cast("string")
    rest = files.join(named.select(F.col("target").alias("rel_path")), "rel_path", "left_anti")
    return first.unionByName(rest.select("rel_path", none.alias("url"), none.alias("title"), none.alias("last_fetched_at"), none.alias("indexed_at"), "modified", "content", none.alias("error")))


def records(documents: DataFrame) -> DataFrame:
    """Index records: front matter, headings, excerpt, language and time out of each document."""
    parsed = documents.filter("error IS NULL").withColumn("f", text.front_matter(F.coalesce("content", F.lit(""))))
    body = F.col("f.body")
    url = F.coalesce("url", F.try_element_at("f.fields", F.lit("url")), F.concat(F.lit("file://"), F.col("rel_path")))
    stem = F.regexp_replace(F.regexp_replace("rel_path", "^.*/", ""), r"\.[^.]*$", "")
    given = F.coalesce(F.try_element_at("f.fields", F.lit("language")), F.try_element_at("f.fields", F.lit("lang")), F.lit(""))
    stamp = F.coalesce(F.try_to_timestamp("last_fetched_at"), F.try_to_timestamp("indexed_at"), F.col("modified").cast("timestamp"))
    levels = {"headings_h1": (1,), "headings_h2": (2,), "headings": (3, 4, 5, 6)}
    return parsed.select(
        F.col("rel_path").alias("doc_id"),
        url.alias("url"),
        urls.url_path(url).alias("url_path"),
        text.title(F.col("title"), F.try_element_at("f.fields", F.lit("title")), body, stem).alias("title"),
        *(F.array_join(text.headings(body, n), "\n").alias(c) for c, n in levels.items()),
        body.alias("body"),
        F.col("rel_path").alias("path"),
        F.array_join(text.tags(F.try_element_at("f.fields", F.lit("tags"))), " ").alias("tags"),
        text.excerpt(body).alias("excerpt"),
        text.language(url, given).alias("language"),
        F.unix_timestamp(stamp).alias("timestamp"),
        stamp.alias("updated"),
    )


def changed_since(files: DataFrame, since: Column) -> DataFrame:
    return files.filter(F.col("modified") > since)


def repository_files(files: DataFrame, prefix: str = "", extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """The documents of an exported tree below ``prefix``, which is taken off their paths."""
    kept = files.filter(F.startswith("rel_path", F.lit(prefix)) & F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).isin(*extensions))
    return kept.withColumn("rel_path", F.regexp_replace(F.substring("rel_path", F.lit(len(prefix) + 1), F.length("rel_path")), "^/+", ""))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod): the entries of sitemap files; the last entry of a url wins.  Indexes of sitemaps have none."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    rows = rows.filter(F.col("loc").isNotNull()).select(F.trim("loc").alias("url"), F.try_to_timestamp("lastmod").alias("lastmod"), F.monotonically_increasing_id().alias("__n"))
    return rows.groupBy("url").agg(F.max_by("lastmod", "__n").alias("lastmod"))


def changed_sitemaps(spark: SparkSession, path: str, seen: DataFrame) -> DataFrame:
    """(path, sha256): sitemap files that differ from the snapshot ``seen``."""
    now = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    return now.join(seen.select("path", "sha256"), ["path", "sha256"], "left_anti")


# Statuses of a reader turned away, of a server in trouble, and the marks of a page that says so.
BLOCKED_STATUSES = (403, 407, 408, 425, 429)
TROUBLE_STATUSES = (500, 502, 503, 504)
TRAFFIC_MARKS = ("google.com/sorry", "our systems have detected unusual traffic", "unusual traffic from your computer network", "to continue, please type the characters below")


def blocked_body(body: Column) -> Column:
    """Whether a page's first 8192 characters say that the reader is taken for a machine."""
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 8192))

    def has(*marks):
        return reduce(lambda a, b: a | b, (F.contains(head, F.lit(m)) for m in marks))

    sorry = has(*TRAFFIC_MARKS) | (has("<title>sorry") & has("google"))
    attention = has("attention required! | cloudflare") & has("ray id")
    return sorry | attention | (has("recaptcha") & has("unusual traffic", "automated queries"))


def blocked(status: Column, body: Column) -> Column:
    """Whether a response asks for another way to the page: by its status, or by what it says."""
    return F.coalesce(status.isin(*BLOCKED_STATUSES, *TROUBLE_STATUSES), F.lit(False)) | blocked_body(body)


def usable_probe(status: Column, body: Column, least: int = 100) -> Column:
    """Whether a response shows that the way works: status 200, more than ``least`` bytes, not turned away."""
    return F.coalesce((status == 200) & (F.octet_length(body) > least), F.lit(False)) & ~blocked_body(body)


def write_documents(rows: DataFrame, folder: str, key: str = "url") -> None:
    """Add or replace documents by key: written beside, then swapped in by a new version folder."""
    spark = rows.sparkSession
    at = manifest(spark, folder)
    old = spark.read.parquet(f"{folder}/{at['latest_segment_id']}") if at else None
    version = f"v{int(at['latest_segment_id'][1:]) + 1}" if at else "v1"
    newest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*sorted(rows.columns)))).filter("__n = 1").drop("__n")
    kept = newest if old is None else old.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)
    kept.write.mode("overwrite").parquet(f"{folder}/{version}")
    write_text(spark, f"{folder}/manifest.json", json.dumps({"latest_segment_id": version}))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{manifest(spark, folder)['latest_segment_id']}")


def delete_documents(spark: SparkSession, folder: str, gone: DataFrame, key: str = "url") -> None:
    """A new version without the documents whose key is in ``gone``."""
    import json

    at = manifest(spark, folder)["latest_segment_id"]
    version = f"v{int(at[1:]) + 1}"
    spark.read.parquet(f"{folder}/{at}").join(gone.select(key).distinct(), key, "left_anti").write.parquet(f"{folder}/{version}")
    write_text(spark, f"{folder}/manifest.json", json.dumps({"latest_segment_id": version}))
